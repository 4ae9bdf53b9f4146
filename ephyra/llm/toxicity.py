"""Toxic spans by a linear-chain conditional random field, and document scores from their marginals."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import field, join_checked, materialize, table, with_arrow
from .crf import CRF, Tagger, batches, places_of, words_of
from .language_id import chosen, held_out, sample

#: The model is fitted on so many labelled documents of each label at most, on their whole texts.
FIT_DOCS = 1500
#: A form (a word, or its first or last letters of these lengths) marks tokens as toxic if its share of toxic documents is so
#: many times that of the others, and chance would give none of all forms that occur as often such a count: with a
#: logarithm of SURE to spare.
RATIO, SURE, PREFIXES, SUFFIXES = 20, 4.0, (4, 5, 6, 7, 8), (4, 5, 6)
#: A span is a run of words whose marginals reach this.
SPAN = 0.5


def forms(word: str) -> list[str]:
    n = len(word)
    return [word, *["^" + word[:k] for k in PREFIXES if n > k], *[word[-k:] + "$" for k in SUFFIXES if n > k]]


def toxic_forms(rows: list[tuple[int, list[str]]]) -> set[str]:
    """Forms that set the toxic documents apart: the labels of tokens follow from these and the documents' labels.
    Documents between whose first uses of a form the neighbours don't differ count once, so that copies add nothing.
    Rarer words, as of a language with few documents, are found in further rounds: in each, the toxic documents that hold no form
    so far are set against the others, which makes chance much less likely."""
    texts = {(bool(y), tuple(w)) for y, w in rows}
    first: list[dict[str, tuple]] = []  # of each toxic document, the neighbours of each form's first use
    for y, w in sorted(texts):
        if y:
            first.append({})
            for i, x in enumerate(w):
                for f in forms(x):
                    first[-1].setdefault(f, (*w[max(0, i - 1) : i], "|", *w[i + 1 : i + 2]))
    other = dict.fromkeys((f for d in first for f in d), 0)
    for y, w in texts:
        if not y:
            for f in {f for x in set(w) for f in forms(x)} & other.keys():
                other[f] += 1
    n0, good = max(1, len(texts) - len(first)), set()
    while first:
        share = min(0.9, len(first) / (len(first) + n0))
        contexts: dict[str, set] = defaultdict(set)
        for d in first:
            for f, c in d.items():
                contexts[f].add(c)
        held = {f: len(c) for f, c in contexts.items() if len(c) >= 3}
        # only forms that occur often enough to stand out at all are tests that chance could win
        often = np.sort([c + other[f] for f, c in held.items()])
        least = 3
        while least <= (often[-1] if len(often) else 0) and math.log(max(1, len(often) - np.searchsorted(often, least))) + SURE > -least * math.log(share):
            least += 1
        tests = math.log(max(1, len(often) - np.searchsorted(often, least))) + SURE
        new = {f for f, c in held.items() if c / len(first) >= RATIO * (other[f] + 0.5) / n0 and chance(c, other[f], share) <= -tests}
        if not new:
            break
        good |= new
        first = [d for d in first if new.isdisjoint(d)]
    return good


def chance(hits: int, misses: int, share: float) -> float:
    """A bound on the logarithm of the probability of so many hits or more where each is one with probability `share`."""
    n = hits + misses
    if hits <= share * n:
        return 0.0
    return -(hits * math.log(hits / n / share) + (misses * math.log(misses / n / (1 - share)) if misses else 0.0))


class ToxicModel:
    """crf: labels 0 (clean) and 1 (toxic); curve: a logistic function of two marginals' aggregates; base: the score where
    nothing could be learned."""

    def __init__(self, crf: CRF | None, curve: np.ndarray, base: float):
        self.crf, self.curve, self.base = crf, curve, base

    @classmethod
    def fit(cls, rows: list[tuple[int, str]], seed: int = 0) -> ToxicModel:
        split = [(y, words_of(t)) for y, t in rows]
        positives = sum(y for y, _ in split)
        base = positives / len(split) if split else 0.0
        toxic = toxic_forms(split)
        if not toxic:
            return cls(None, np.zeros(3), base)
        bad = {x for _, w in split for x in w}
        bad = {x for x in bad if not toxic.isdisjoint(forms(x))}
        seqs = [(w, [int(bool(y) and x in bad) for x in w]) for y, w in split if w]
        own = cls(CRF(2).fit(seqs, epochs=2, seed=seed), np.zeros(3), base)
        x, y = np.array([own.signals(m) for m in own.marginals([w for _, w in split])]), np.array([y for y, _ in split], float)
        own.curve = logistic(x, y)
        return own

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        m = Tagger(self.crf).marginals(docs)[:, 1]
        return np.split(m, np.cumsum([len(d) for d in docs])[:-1])

    @staticmethod
    def signals(m: np.ndarray) -> list[float]:
        """What a document's marginals say: the largest, and the expected number of clearly toxic words."""
        return [1.0, float(m.max()), math.log1p(float(m[m >= SPAN].sum()))] if len(m) else [1.0, 0.0, 0.0]

    def scorer(self):
        tag = Tagger(self.crf) if self.crf else None

        def of(texts):
            score, spans = [0.0] * len(texts), [[] for _ in texts]
            for own in batches(texts):
                words = [w for _, w in own]
                m = tag.marginals(words)[:, 1] if tag else np.zeros(sum(map(len, words)))
                at = 0
                for i, w in own:
                    p = m[at : at + len(w)]
                    at += len(w)
                    score[i] = float(1 / (1 + math.exp(-float(np.dot(self.curve, self.signals(p)))))) if tag else self.base
                    hit = np.flatnonzero(p >= SPAN)
                    if len(hit):
                        place = places_of(texts[i])
                        runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
                        spans[i] = [v for r in runs for v in (place[r[0]][0], place[r[-1]][1])]
            return score, spans, [int(s >= 0.7) for s in score]

        return of


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_label: int = FIT_DOCS) -> ToxicModel:
    """A model from documents (doc_id, text) and labels (doc_id, toxic 0/1), fitted on the driver on a bounded sample. The
    sample's ids come from the labels, so that only their texts move; about 2 * per_label for each label are broadcast."""
    ids = materialize(chosen(labels.select("doc_id", F.col("toxic").alias("y")).where("y in (0, 1)").distinct(), 2 * per_label).select("doc_id", F.col("y").alias("toxic")))
    return ToxicModel.fit(sample(materialize(join_checked(docs.select("doc_id", "text"), ids, "doc_id", "inner")), "toxic", per_label))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """docs with score (0 to 1), spans (begin and end offsets in the text itself in turn, in code points) and predicted (score >= 0.7).

    Whole texts, row by row, with no shuffle; only text is read. Null or empty texts have the score of a text
    without a toxic word. Repeated rows are done each; clashing columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = [field("score", T.DoubleType()), field("spans", T.ArrayType(T.IntegerType())), field("predicted", T.IntegerType())]
    return with_arrow(docs, lambda: shared.value.scorer(), ["text"], out)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(3, 1)))
    return score(docs.select("doc_id", "text", held_out(3, 1).alias("held_out")), model).select("doc_id", "held_out", "score", "predicted", "spans")
