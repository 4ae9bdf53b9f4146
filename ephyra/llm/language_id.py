"""Language identification of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import field, join_checked, materialize, table, with_arrow
from .crf import CRF, Tagger, batches, words_of

#: The model is fitted on the whole texts of so many training documents of each language at most (the first by a hash of doc_id).
FIT_DOCS = 150
#: And on so many code points of them for each label at most; the driver holds no more of the texts.
FIT_CHARS = 8_000_000


def sample(docs: DataFrame, label: str, per_label: int, chars: int = FIT_CHARS) -> list:
    """[(label, text)] of training rows: per_label rows of each label, by the order of a hash of doc_id, as long as their texts have no
    more than `chars` code points for each label; a text that is longer than what is left is passed over whole. Rows that share a doc_id
    count once, with the least text. Lengths come to the driver first, and then the texts that were taken."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col(label).alias("y"), "text")
    got = materialize(chosen(rows, per_label).groupBy("y", "h").agg(F.min("text").alias("text")))
    seen, room, taken = Counter(), Counter(), []
    for y, h, n in sorted(tuple(r) for r in got.select("y", "h", F.length("text")).collect()):
        if seen[y] < per_label and room[y] + n <= chars:
            seen[y] += 1
            room[y] += n
            taken.append((y, h))
    if not taken:
        return []
    keys = docs.sparkSession.createDataFrame(taken, got.select("y", "h").schema)
    return sorted(tuple(r) for r in got.join(F.broadcast(keys), ["y", "h"]).select("y", "text").collect())


def chosen(rows: DataFrame, per_label: int) -> DataFrame:
    """Rows of each label `y` whose hash `h` of doc_id is least: per_label and some more, by a bound on the hash that follows from the
    label's count. No label's rows are ordered or gathered for it, and every label has its rows, however rare."""
    top = (1 << 62) - 1
    rows = rows.where("y is not null").withColumn("h", F.xxhash64("doc_id", F.lit(11)).bitwiseAND(F.lit(top)))
    counts = materialize(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")))
    bound = F.least(F.lit(1.0), (per_label + 4 * per_label**0.5 + 20) / F.col("n")) * float(top)
    return join_checked(rows, counts.select("y", bound.cast("long").alias("bound")), "y", "inner").where("h <= bound").drop("bound")


class LanguageModel:
    """labels: the learned languages in order; crf: None if there are fewer than two."""

    def __init__(self, labels: list[str], crf: CRF | None):
        self.labels, self.crf = labels, crf

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], seed: int = 0) -> LanguageModel:
        """Each word of a training text has the text's language. Texts are cut in runs of words and runs of different languages
        are laid end to end, so that switches inside a text are seen and their rate is learned."""
        labels = sorted({y for y, _ in rows})
        if len(labels) < 2:
            return cls(labels, None)
        rng = np.random.default_rng(seed)
        runs = []
        for y, text in rows:
            w = words_of(text)
            i = 0
            while i < len(w):
                n = int(rng.integers(8, 60))
                runs.append((w[i : i + n], labels.index(y)))
                i += n
        order = rng.permutation(len(runs))
        seqs, at = [], 0
        while at < len(order):
            n = 1 + int(rng.integers(0, 3))
            own = [runs[i] for i in order[at : at + n]]
            seqs.append(([w for ws, _ in own for w in ws], [y for ws, y in own for _ in ws]))
            at += n
        return cls(labels, CRF(len(labels)).fit(seqs, epochs=2, seed=seed))

    def tagger(self):
        tag = Tagger(self.crf) if self.crf else None

        def of(texts):
            lang, score, shares = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            for own in batches(texts):
                words = [w for _, w in own]
                m = tag.marginals(words) if tag else np.ones((sum(map(len, words)), len(self.labels)))
                at = 0
                for i, w in own:
                    if w and self.labels:
                        mean = m[at : at + len(w)].mean(axis=0)
                        best = int(mean.argmax())
                        lang[i], score[i], shares[i] = self.labels[best], float(min(1.0, mean[best])), mean.tolist()
                    at += len(w)
            return lang, score, shares

        return of


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(4, 2) & F.col("lang").isNotNull())


def held_out(mod: int, rest: int):
    """doc_id's checksum (of no text for a null) leaves this rest."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def fit(train: DataFrame, per_label: int = FIT_DOCS) -> LanguageModel:
    """A model from training rows (doc_id, text, lang), fitted on the driver on a bounded sample of them."""
    return LanguageModel.fit(sample(train, "lang", per_label))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score (the mean marginal of that language over the words) and lang_shares (of all learned ones).

    Whole texts, row by row, with no shuffle. A null text, or one without a letter: 'und', score 0. Ties go to the
    language that sorts first. Repeated rows are done each; clashing columns are replaced. Only text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = [field("lang_pred", T.StringType()), field("score", T.DoubleType()), field("lang_shares", T.ArrayType(T.DoubleType()))]
    return with_arrow(docs, lambda: shared.value.tagger(), ["text"], out)


def spans(text: str, model: LanguageModel) -> list[tuple[str, str]]:
    """(word, language) of a code-switched text: the label of the largest marginal."""
    w = words_of(text)
    return [(x, model.labels[int(i)]) for x, i in zip(w, Tagger(model.crf).marginals([w]).argmax(axis=1))]


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training(docs))
    return identify(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "lang_shares")
