"""Conditional random fields against enumeration, and held-out accuracy of what they learn."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from fixtures import docs, empty, rows

from ephyra.llm import crf, language_id, toxicity
from ephyra.llm.common import table

SF = "/root/testdata/sf0.01"


def random_model(k, seed=0):
    g = np.random.default_rng(seed)
    m = crf.CRF(k)
    m.weight[:] = g.standard_normal(m.weight.shape) * 0.3
    m.trans, m.first = g.standard_normal((k, k)), g.standard_normal(k)
    return m


def brute(m, words):
    """Marginals of one text by a sum over all label sequences."""
    e = []
    for w in words:
        r, _ = crf.features([w])
        e.append(m.weight[r].sum(axis=0, dtype=np.float64))
    out, total = np.zeros((len(words), m.k)), 0.0
    for ys in itertools.product(range(m.k), repeat=len(words)):
        p = np.exp(m.first[ys[0]] + sum(e[i][y] for i, y in enumerate(ys)) + sum(m.trans[a, b] for a, b in zip(ys, ys[1:])))
        total += p
        for i, y in enumerate(ys):
            out[i, y] += p
    return out / total


@pytest.mark.parametrize("block", [1, 3, 64])
def test_marginals_equal_enumeration(block):
    m = random_model(3)
    texts = [["ab", "cde", "ab", "été"], [], ["x"], ["longer", "b", "c", "d", "ab", "x"]]
    got = crf.Tagger(m, block).marginals(texts)
    assert np.allclose(got, np.concatenate([brute(m, t) for t in texts if t]), atol=1e-6)


def test_marginals_stay_finite_on_a_very_long_text():
    m = random_model(2)
    m.weight *= 50
    got = crf.Tagger(m).marginals([["a", "bb", "ccc"] * 30_000])
    assert np.isfinite(got).all() and np.allclose(got.sum(axis=1), 1)


def test_batching_and_memo_change_nothing(monkeypatch):
    m = random_model(3)
    texts = [[f"w{i * j % 17}" for j in range(i % 9)] for i in range(60)]
    whole = crf.Tagger(m).marginals(texts)
    monkeypatch.setattr(crf, "MEMO", 5)
    tag = crf.Tagger(m)
    assert np.allclose(whole, np.concatenate([tag.marginals([t]) for t in texts]))


def test_training_learns_transitions_and_words():
    g = np.random.default_rng(1)
    seqs = []
    for _ in range(200):
        y, ws, ys = int(g.integers(2)), [], []
        for _ in range(20):
            y = y if g.random() < 0.9 else 1 - y
            ws.append(("pa", "po")[y] + "tik"[int(g.integers(3))] if g.random() < 0.8 else "zz")
            ys.append(y)
        seqs.append((ws, ys))
    m = crf.CRF(2).fit(seqs)
    assert m.trans[0, 0] > m.trans[0, 1] and m.trans[1, 1] > m.trans[1, 0]
    p = crf.Tagger(m).marginals([["pat", "pai", "zz", "zz", "pak"], ["pot", "zz", "poi"]])
    assert (p[:5, 0] > 0.7).all() and (p[5:, 1] > 0.7).all()


def test_language_id_on_held_out_rows(spark):
    d = table(spark, SF, "documents")
    got = language_id.op2_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_code_switched_text_and_edge_rows(spark):
    train = [(i, "the cat and the dog were in the house", "en") for i in range(20)] + [(100 + i, "der hund und die katze sind im haus", "de") for i in range(20)] + [(200, None, "en"), (201, "x", None)]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert [y for _, y in language_id.spans("the dog and the cat der hund und die katze", model)] == ["en"] * 5 + ["de"] * 5
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark).withColumn("SCORE", F.lit("x")), model).collect()}
    assert len(got) == len({i for i, *_ in rows()}) and got[0]["lang_pred"] == got[1]["lang_pred"] == got[3]["lang_pred"] == "und" and got[0]["score"] == 0.0
    assert language_id.identify(empty(spark), model).count() == 0
    rare = language_id.fit(spark.createDataFrame(train + [(300 + i, f"{w} {w}a", f"l{i:03d}") for i, w in enumerate("".join(c) for c in itertools.product("kptz", "aeiou", "kptz"))], "doc_id long, text string, lang string"))
    assert len(rare.labels) == 82
    none = language_id.fit(empty(spark))
    assert {r["lang_pred"] for r in language_id.identify(docs(spark), none).collect()} == {"und"}
    one = language_id.fit(spark.createDataFrame(train[:20], "doc_id long, text string, lang string"))
    assert language_id.identify(docs(spark).where("doc_id = 4"), one).first()["lang_pred"] == "en"


def test_toxicity_on_held_out_rows_of_each_language(spark):
    """Some labelled toxic documents hold no word that any other toxic document holds: 0.8 of a language's rows, 0.88 of all."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.op6_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").join(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    toxic = [r for r in held if r["toxic"]]
    for lang in ("en", "de", "fr", "es"):
        own = [r["predicted"] for r in toxic if r["lang"] == lang]
        assert len(own) > 10 and sum(own) >= 0.8 * len(own)
    assert sum(r["predicted"] for r in toxic) >= 0.88 * len(toxic)
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.005 * len(held)
    r = next(r for r in toxic if r["predicted"])
    assert r["spans"] and all(r["text"][a:b].isalpha() or " " in r["text"][a:b] for a, b in zip(r["spans"][::2], r["spans"][1::2]))


def test_places_are_those_of_the_text_itself():
    for text in ("\u0130stanbul \u0130\u0130 x, Stra\xdfe", "A b-C", "", "\u0130", "x\u0130y z"):
        places = crf.places_of(text)
        assert len(places) == len(crf.words_of(text))
        for (a, b), w in zip(places, crf.words_of(text)):
            assert w in text[a:b].lower()
    assert crf.places_of("\u0130\u0130 bad")[-1] == (3, 6)


def test_toxicity_finds_inflected_forms_and_edge_rows(spark):
    g = np.random.default_rng(3)
    word = lambda: "".join(g.choice(list("bcdfghklmn")) + g.choice(list("aeiou")) for _ in range(3))
    train = [(i, " ".join([word() for _ in range(15)] + ["snarkl" + word()] + [word() for _ in range(5)]), 1) for i in range(80)] + [(1000 + i, " ".join(word() for _ in range(20)), 0) for i in range(200)]
    train = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.fit(train.drop("toxic"), train.drop("text"))
    test = spark.createDataFrame([(1, "a snarklzuzu here", 5), (2, "bacodu mekife", 5), (3, None, 5), (4, "", 5), (4, "", 5), (None, "SNARKLbaba " * 4000, 5)], "doc_id long, text string, predicted int")
    got = {r["doc_id"]: r for r in toxicity.score(test, model).collect()}
    assert got[1]["predicted"] == 1 and got[1]["spans"] == [2, 12] and got[None]["predicted"] == 1
    assert got[2]["predicted"] == got[3]["predicted"] == got[4]["predicted"] == 0 and 0 <= got[3]["score"] <= 1
    assert toxicity.score(test.limit(0), model).count() == 0
    none = toxicity.fit(train.limit(0).drop("toxic"), train.limit(0).drop("text"))
    assert toxicity.score(test, none).where("score = 0").count() == 6


def test_the_sample_is_bounded_in_rows_and_characters(spark):
    some = [(i, f"text {i} of one language", "en") for i in range(300)] + [(i, "x" * 4000, "de") for i in range(300, 400)]
    hot = [(7, f"another text of the id {i}", "en") for i in range(3000)] + [(None, f"no id {i}", "fr") for i in range(50)] + [(401, None, "fr"), (402, "no label", None), (500, "y" * 90_000, "es"), (501, "short", "es")]
    d = spark.createDataFrame(some + hot, "doc_id long, text string, lang string")
    got = language_id.sample(d, "lang", 40, chars=50_000)
    by = {y: [t for l, t in got if l == y] for y in {l for l, _ in got}}
    assert set(by) == {"en", "de", "fr", "es"} and by["fr"] == ["no id 0"] and by["es"] == ["short"]
    assert len(by["de"]) == 12 and sum(t.startswith("another") for t in by["en"]) <= 1 and len(by["en"]) <= 40
    assert got == language_id.sample(d.orderBy(F.rand(1)).repartition(5), "lang", 40, chars=50_000)
    assert language_id.sample(d.limit(0), "lang", 40) == []
