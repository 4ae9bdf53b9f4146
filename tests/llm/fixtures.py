"""A small table of documents with the awkward cases: nulls, empty and long texts, copies, repeated rows, odd columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=0):
    r = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta's", "épée", "naïve", "42", "x", "über", "señor", "…", "日本"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(300)
    out = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "one two", None, "a", 7)]
    out += [(10 + i, base, "en", "hot", len(base)) for i in range(40)]
    out += [(60 + i, base.replace("42", f"n{i}", 1), "en", "hot", 1) for i in range(40)]
    out += [(200 + i, text(r.randrange(1, 200)), r.choice(["en", "de", None]), r.choice("abc"), 1) for i in range(60)]
    out += [(400, text(20_000), "en", "a", 1), (401, "a" * 5000, "en", "a", 1), (402, "word " * 3000, "de", "b", 1), (None, "no id here at all", "en", "a", 1)]
    return out + [out[20]] * 2 + [out[-1]]


def docs(spark, **kw):
    return spark.createDataFrame(rows(**kw), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
