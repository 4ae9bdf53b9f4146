"""Exact duplicates by perfect hash, divergence of sources, vector codes: against brute force on awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SCHEMA, empty, rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ephyra.llm import exact_dedup as ed, source_audit as sa, vector_codes as vc


@settings(max_examples=30, deadline=None)
@given(st.sets(st.binary(min_size=32, max_size=32), max_size=300), st.sets(st.binary(min_size=32, max_size=32), max_size=50))
def test_perfect_hash_is_minimal_and_perfect(keys, others):
    matrix = lambda ks: np.frombuffer(b"".join(ks), np.uint8).reshape(-1, 32)
    keys = list(keys)
    mph = ed.PerfectHash.build(matrix(keys))
    assert sorted(mph.slots(matrix(keys)).tolist()) == list(range(len(keys)))
    assert all(-1 <= s < len(keys) for s in mph.slots(matrix(list(others - set(keys)))).tolist())


def best(ids):
    return max((i for i in ids if i is not None), default=None)


@pytest.mark.parametrize("earlier", ["doc_id <= 100", "true", "false", "doc_id % 2 = 0"])
def test_exact_dedup_equals_grouping(spark, earlier, monkeypatch):
    monkeypatch.setattr(ed, "SHARD", 50)
    monkeypatch.setattr(ed, "HOT_LEAST", 5)
    data = rows() + [(None, "null ids alone", "en", "a", 1)] * 3
    clash = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "row", "keep_id", "shard", "kept", "n")})
    got = ed.exact_dedup(ed.digested(clash), F.expr(earlier)).collect()
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        for i in ids:
            want[(i, best(ids), len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    assert ed.exact_dedup(ed.digested(empty(spark)), F.expr(earlier)).count() == 0


def test_index_outlives_its_table_and_finds_members(spark, tmp_path):
    old, new = (spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string") for ids in (range(0, 500), range(400, 700)))
    ed.build_index(ed.digested(old), 3).write.parquet(str(tmp_path / "index"))
    got = ed.look_up(spark.read.parquet(str(tmp_path / "index")), ed.digested(new), 3).collect()
    assert len(got) == 700 and sum(r.member for r in got) == 500 and sorted(r.keep_id for r in got if r.group_size == 2) == list(range(400, 500))


def audit(data, least, top):
    by = defaultdict(list)
    for _, text, lang, source, _ in data:
        by[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))))
    out = set()
    for lang, ds in by.items():
        seen = Counter(t for _, ws in ds for t in set(ws))
        kept = sorted((t for t in seen if seen[t] >= least), key=str.encode)
        n = defaultdict(Counter)
        for s, ws in ds:
            n[s].update(w for w in ws if w in set(kept))
        p = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))
        tot, whole = {s: sum(c.values()) for s, c in n.items()}, sum(n.values(), Counter())
        for s in n:
            pairs = [(o, sum(abs(p(n[s][t], tot[s]) - p(n[o][t], tot[o])) for t in kept)) for o in n if o != s]
            terms = [(t, d) for t in kept if n[s][t] and (d := p(n[s][t], tot[s]) - p(whole[t], sum(tot.values()))) > 0]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize(("least", "chunk", "held"), [(3, 4096, 300_000), (2, 3, 5), (10_000, 4, 9)])
def test_source_audit_equals_counting(spark, monkeypatch, least, chunk, held):
    for k, v in {"LEAST_DOCS": least, "CHUNK": chunk}.items():
        monkeypatch.setattr(sa, k, v)
    r = random.Random(3)
    data = rows() + [(900 + i, " ".join(r.choice(["Éa", "éa", "zz", "ZZ", "ʼn", "𝔸", "a1b", "q"]) for _ in range(9)), "xx", r.choice(["s", "S", "é", None]), 0) for i in range(40)]
    given = spark.createDataFrame(data, SCHEMA).withColumn("term", F.lit(1)).withColumn("chunk", F.lit(2)).repartition(5)
    got = [tuple(x) for x in sa.source_audit(given).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert set(got) == audit(data, least, sa.TOP) and len(got) == len(set(got))
    assert sa.source_audit(empty(spark)).count() == 0


def test_tasks_hand_on_counts_before_they_hold_too_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sa, "HELD", 3)
    texts = [b"a b c a", b"D e f", b"a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["x"] * 3), pa.array(["y"] * 3)], names=["text", "lang", "source"])
    out = [r for b in sa._counted([batch]) for r in b.to_pylist()]
    n, d = Counter(), Counter()
    for r in out:
        n[r["term"]] += r["n"]
        d[r["term"]] += r["docs"]
    assert n[b"a"] == 3 and d[b"a"] == 2 and n[b"d"] == 1 and sum(r["term"] is None for r in out) == 2


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randrange(1, 1 << r.randrange(1, 53))
        count = r.randrange(0, total + 1)
        assert int(sa.shares(np.array([count]), total)[0]) == 1 + 10**9 * count // total


def lloyd(vectors, rounds, kept=16):
    """Codes, errors and entries by plain rounds in Python's whole numbers; ties to the lower index."""
    big = lambda v: math.floor(v * 4096) if abs(v) < 2**53 else int(v) * 4096
    xs = [[big(float(v)) for v in e] for _, e in vectors]
    w = len(xs[0]) // 8
    parts = [[x[p * w : p * w + w] for x in xs] for p in range(8)]
    books = [[list(v) for v in part[:kept]] for part in parts]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            own = [near(v, books[p])[1] for v in parts[p]]
            for i in range(len(books[p])):
                mine = [v for v, o in zip(parts[p], own) if o == i]
                books[p][i] = [sum(c) // len(mine) for c in zip(*mine)] if mine else books[p][i]
    got = [[near(v, books[p]) for p in range(8) for v in [parts[p][k]]] for k in range(len(xs))]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [("".join(f"{i:02x}" for _, i in g), sum(d for d, _ in g)) for g in got], digest


def coded(spark, vectors, kind, watch=None, rounds=6):
    df = spark.createDataFrame([(i, e, i % 3 if i is not None and i % 5 else None) for i, e in vectors], f"vec_id long, embedding array<{kind}>, label int").withColumn("own", F.lit("x")).repartition(4)
    return vc.vector_codes(df, rounds, watch).collect()


@pytest.mark.parametrize(("kind", "values"), [("float", "ties"), ("double", "real"), ("double", "few"), ("double", "huge")])
def test_vector_codes_equal_plain_lloyd(spark, kind, values):
    r = random.Random(5)
    draw = {"ties": lambda: r.choice([-1, 0, 1]) / 4096, "real": lambda: r.gauss(0, 1), "few": lambda: r.gauss(0, 1), "huge": lambda: r.choice([0.5, -3.0, 1e30, -2e18, 7e5])}[values]
    vectors = [(i, [draw() for _ in range(16)]) for i in range(5 if values == "few" else 150)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(30)]
    bad = [(-1, None), (-2, [None] * 16), (-3, [math.nan] * 16), (-4, [math.inf] + [0.0] * 15), (5000, [1.0] * 8), (5001, [1.0] * 3), (5002, [])]
    watch = []
    got = coded(spark, vectors + bad, kind, watch)
    want, digest = lloyd(vectors, 6)
    assert {r.codebooks_sha256 for r in got} == {digest} and len(got) == len(vectors)
    assert {r.vec_id: (r.code, r.error) for r in got} == {i: (c, e if e < 2**63 else None) for (i, _), (c, e) in zip(vectors, want)}
    by = defaultdict(list)
    for r_ in got:
        by[r_.vec_id % 3 if r_.vec_id % 5 else None].append(r_)
    for rs in by.values():
        total = None if any(x.error is None for x in rs) else sum(x.error for x in rs)
        assert {x.label_error for x in rs} == {total}
    if values == "real":
        assert watch[0] == 8 * len(vectors) and watch[-1] < watch[0] / 2


def test_vector_codes_of_odd_tables(spark):
    assert coded(spark, [], "float") == [] and coded(spark, [(1, None)], "float") == []
    one = coded(spark, [(None, [0.25] * 8), (None, [0.25] * 8)], "float")
    assert [(r.vec_id, r.code, r.error) for r in one] == [(None, "00" * 8, 0)] * 2


def test_bounds_never_skip_a_tie():
    """An entry that comes as near as the own one takes over if its index is lower."""
    x = np.array([[4] + [0] * 7])
    books = [np.array([[20], [5]])] + [np.zeros((2, 1), np.int64)] * 7
    own, upper, lower = np.zeros((1, 8), np.uint8), np.zeros((1, 8)), np.zeros((1, 8))
    vc.step(x, books, None, own, upper, lower)
    assert own[0, 0] == 1
    books = [np.array([[3], [5]]), *books[1:]]
    vc.step(x, books, [np.array([17.0, 0.0])] + [np.zeros(2)] * 7, own, upper, lower)
    assert own[0, 0] == 0
