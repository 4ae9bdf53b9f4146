"""The Kneser-Ney model against its definition, its two ways of scoring, and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from fixtures import SCHEMA, docs, empty, rows

from ephyra.llm import kneser_ney, quality_classifier
from ephyra.llm.common import table

TRUSTED = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "été à la mer", "", None, "the cat sat on the mat"] * 3


def brute(texts, query, order=kneser_ney.ORDER):
    """The log probability of query's bytes by interpolated modified Kneser-Ney, straight from its definition."""
    tables = {order: Counter()}
    for t in texts:
        raw = b"\0" * (order - 1) + t.encode() if t else b""
        tables[order].update(raw[i - order + 1 : i + 1] for i in range(order - 1, len(raw)))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    d = {k: kneser_ney.discounts(*[sum(c == i for c in tables[k].values()) for i in (1, 2, 3, 4)]) for k in tables}
    ctx = {k: defaultdict(list) for k in tables}
    for k in tables:
        for g, c in tables[k].items():
            ctx[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        cs = ctx[k].get(g[:-1])
        if not cs:
            return p(g[1:])
        c, s = tables[k][g], sum(cs)
        cut = lambda c: 0 if c == 0 else d[k][min(c, 3) - 1]
        return max(c - cut(c), 0) / s + sum(map(cut, cs)) / s * p(g[1:])

    raw = b"\0" * (order - 1) + query.encode()
    return sum(math.log(p(raw[i - order + 1 : i + 1])) for i in range(order - 1, len(raw)))


@pytest.fixture(scope="module")
def model(spark):
    return kneser_ney.Model.train(kneser_ney.with_fold(spark.createDataFrame([(t,) for t in TRUSTED], "text string")))


def test_scores_equal_the_definition(spark, model):
    """Each text by the model of the other fold's trusted texts; trusted texts themselves are held out."""
    queries = ["the cat", "a dog sat", "xyz", "été", "the mat\0the", "q", *{t for t in TRUSTED if t}]
    folds = {r["text"]: r["__fold__"] for r in kneser_ney.with_fold(spark.createDataFrame([(t,) for t in {*queries, *TRUSTED}], "text string")).collect()}
    got = {r["text"]: r for r in model.score(kneser_ney.with_fold(spark.createDataFrame([(t,) for t in queries], "text string"))).collect()}
    assert {folds[t] for t in TRUSTED if t} == {0, 1}
    for q in queries:
        assert got[q]["n_bytes"] == len(q.encode())
        assert abs(-got[q]["nll"] / kneser_ney.UNIT - brute([t for t in TRUSTED if folds[t] != folds[q]], q)) < 6e-4 * len(q.encode())


@pytest.mark.parametrize("model_rows", [0, 40])
def test_shards_of_the_model_give_the_same_scores(spark, model, model_rows):
    asked = kneser_ney.with_fold(docs(spark).unionByName(spark.createDataFrame([(900 + i, t, "en", "a", 1) for i, t in enumerate(TRUSTED)], SCHEMA)))
    if model_rows == 0:
        model_rows = model.rows().count() // 3
    a = Counter((r["doc_id"], r["n_bytes"], r["nll"]) for r in model.score(asked).collect())
    assert a == Counter((r["doc_id"], r["n_bytes"], r["nll"]) for r in model.score(asked, model_rows=model_rows).collect())


def test_counts_are_whole_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SLICE", 1000)
    monkeypatch.setattr(kneser_ney, "FLUSH", 50)
    for (keys, begin), places in kneser_ney.grams(["abc" * 900, None, "", "x"]):
        assert len(begin) == len(places)
    c = {(r["f"], r["key"]): r["c"] for r in kneser_ney.counts(kneser_ney.with_fold(docs(spark))).collect()}
    assert sum(c.values()) == sum(len((t or "").encode()) for _, t, *_ in rows())


def test_a_small_cache_changes_nothing():
    import numpy as np

    g = np.random.default_rng(0)
    keys = np.unique(g.integers(0, 1 << 40, 3000))
    tables = {x: (np.zeros(0, np.int64), np.zeros(0, np.int32)) for x in range(2, 12)}
    tables[10] = keys, g.integers(-90000, 0, len(keys)).astype(np.int32)
    asked = g.choice(np.concatenate([keys, g.integers(0, 1 << 40, 500)]), 20_000)
    look = kneser_ney.Lookup(tables, -5, bits=4)
    assert (look(asked) == look.exact(asked)).all() and (look(asked) == look.exact(asked)).all()


def test_classifier_keeps_clean_and_drops_noise(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.op1_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    clean, junk = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.3 * len(junk)


def test_limits_are_the_quantile_of_held_out_scores(spark):
    """Each language's limit is the quantile of its trusted texts' own held-out scores, so that limits move with the language."""
    r = random.Random(8)
    say = lambda a, n: " ".join("".join(r.choice(a) for _ in range(r.randrange(2, 9))) for _ in range(n))
    data = [(1000 * k + i, say(a, 60), lang, "s", 1) for k, (lang, a) in enumerate((("aa", "abcd"), ("bb", "ghijklmnopqrstuv"))) for i in range(250)]
    d = spark.createDataFrame(data, SCHEMA)
    got = quality_classifier.quality_classifier(d, d).collect()
    low, high = ({x["max_millinats"] for x in got if x["lang"] == lang} for lang in ("aa", "bb"))
    assert len(low) == len(high) == 1 and min(high) > 1.2 * max(low)
    for lang, most in (("aa", low), ("bb", high)):
        own = sorted(x["millinats"] for x in got if x["lang"] == lang)
        exact = own[math.ceil(quality_classifier.LIMIT_AT * len(own)) - 1]
        assert exact - exact / 32 <= min(most) <= exact
    assert {x["kept"] for x in got if x["millinats"] > 1.05 * x["max_millinats"]} <= {False}


def test_classifier_edge_tables(spark):
    d = docs(spark).withColumn("kept", F.lit(0)).withColumn("NLL", F.lit("x"))
    out = quality_classifier.quality_classifier(d, d.where("lang = 'en'")).collect()
    assert len(out) == len(rows()) and all(r["kept"] for r in out if not r["text"])
    assert all(r["kept"] for r in quality_classifier.quality_classifier(d, empty(spark)).collect())
    assert quality_classifier.quality_classifier(empty(spark), d).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    d = table(spark, sf, "documents")
    from ephyra.llm.common import materialize

    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    seen = [d.count()]
    for _, stage in pipeline.STAGES[:-1]:
        new = materialize(stage(spark, d, sf))
        assert new.columns == d.columns and new.count() == new.dropDuplicates().count()
        d = new
        seen.append(d.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    left = {r["doc_id"] for r in d.select("doc_id").collect()}
    assert sum(labels[i] == 0 for i in left if i in labels) <= 0.02 * len(left)
    pieces = pipeline.run(spark, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == left
    odd = docs(spark).withColumns({c: F.lit(f"own {c}") for c in ("_fp", "kept", "n_words", "component_id", "_lang", "most", "nll", "__copies__", "score")})
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns and got.where("kept <> 'own kept' or _fp <> 'own _fp' or most <> 'own most'").count() == 0
        assert stage(spark, empty(spark), sf).count() == 0
    assert SCHEMA
