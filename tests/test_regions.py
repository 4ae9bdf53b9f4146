"""Regions over tiles, clusters in rounds and neighbour correlations in blocks, against the same on whole arrays."""

import numpy as np
import pytest

from ephyra.operators import pixels, regions, segment


def flood(mask, eight):
    lab, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if not lab[y, x]:
            n, stack = n + 1, [(y, x)]
            lab[y, x] = n
            while stack:
                a, b = stack.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (eight or not dy * dx) and 0 <= a + dy < mask.shape[0] and 0 <= b + dx < mask.shape[1] and mask[a + dy, b + dx] and not lab[a + dy, b + dx]:
                            lab[a + dy, b + dx] = n
                            stack.append((a + dy, b + dx))
    return lab


@pytest.mark.parametrize(("eight", "stretch"), [(True, 3), (False, 256)])
def test_labels_equal_a_flood(spark, monkeypatch, eight, stretch):
    monkeypatch.setattr(regions, "STRETCH", stretch)
    masks = {"a": np.random.default_rng(0).random((14, 19)) < 0.5, "b": np.ones((3, 20), bool), "c": np.zeros((5, 5), bool)}
    df = spark.createDataFrame([(k, int(y), int(x)) for k, m in masks.items() for y, x in np.argwhere(m)], "k string, y int, x int").repartition(5)
    got = {k: np.zeros(m.shape, int) for k, m in masks.items()}
    for r in regions.labelled(df, ["k"], eight).collect():
        got[r["k"]][r["y"], r["x"]] = r["region"]
    for k, m in masks.items():
        assert (got[k] == flood(m, eight)).all(), k
    big = {(r["k"], r["y"], r["x"]) for r in regions.largest(df, ["k"], eight).collect()}
    for k, m in masks.items():
        lab = flood(m, eight)
        want = {(k, int(y), int(x)) for y, x in np.argwhere(lab == np.bincount(lab.ravel())[1:].argmax() + 1)} if m.any() else set()
        assert {b for b in big if b[0] == k} == want


def test_clipped_rois(spark):
    m = np.zeros((12, 12), int)
    m[1:4, 1:4], m[6, 1], m[8:10, 2:4], m[5, 8:11], m[7, 8] = 1, 1, 2, 3, 3
    df = spark.createDataFrame([(int(y), int(x), int(m[y, x])) for y, x in np.argwhere(m >= 0)], "y int, x int, label int")
    kept, dropped = regions.drop_clipped(df, 4)
    assert {(r["y"], r["x"], r["label"]) for r in kept.collect()} == {(y, x, 1) for y in (1, 2, 3) for x in (1, 2, 3)} | {(y, x, 2) for y in (8, 9) for x in (2, 3)}
    assert [(r["label"], r["area"]) for r in dropped.collect()] == [(3, 3)]
    assert regions.drop_clipped(df.limit(0), 4)[0].count() == 0


@pytest.mark.parametrize(("linkage", "ties"), [("complete", True), ("complete", False), ("average", False), ("single", True)])
def test_clusters_equal_one_after_another(spark, linkage, ties):
    g = np.random.default_rng(7)
    n = 24
    o = np.zeros((n, n))
    for a in range(n):
        for b in range(a + 1, n):
            if abs(a - b) < 9 and g.random() < 0.8:
                o[a, b] = o[b, a] = g.integers(1, 10) / 10 if ties else g.random()
    np.fill_diagonal(o, 1.0)
    want = segment.agglomerate(o, 0.45, linkage)
    df = spark.createDataFrame([(a, b, float(o[a, b])) for a in range(n) for b in range(a + 1, n) if o[a, b] > 0], "a long, b long, overlap double")
    got = {r["roi"]: r["cluster"] for r in regions.clusters(spark.createDataFrame([(i,) for i in range(n + 1)], "roi long"), df, 0.45, linkage).collect()}
    assert got[n] == n and len(got) == n + 1
    assert {i: int(np.flatnonzero(want == want[i])[0]) for i in range(n)} == {i: got[i] for i in range(n)}
    with pytest.raises(ValueError, match="linkage"):
        regions.clusters(df, df, 0.5, "ward")


@pytest.mark.parametrize(("tile", "span"), [(3, 4), (64, 256)])
def test_neighbour_correlations_equal_the_definition(spark, tile, span):
    g = np.random.default_rng(1)
    v = {k: g.standard_normal((11, 7, 8)).cumsum(axis=2) + g.standard_normal((11, 1, 1)) for k in (0, 1)}
    v[0][:, 2, 3] = 4.0
    gone = {(1, 4, 0, 0), (1, 5, 6, 7)}
    rows = [(k, t, y, x, None if (k, t, y, x) in gone else float(v[k][t, y, x])) for k in v for t in range(11) for y in range(7) for x in range(8) if (k, y, x) != (1, 3, 3)]
    df = spark.createDataFrame(rows, "k int, t int, y int, x int, v double").repartition(4)
    got = {(r["k"], r["y"], r["x"]): r["corr"] for r in pixels.neighbour_correlation(df, ["k"], ["t"], "v", tile=tile, span=span).collect()}
    have = {(k, t, y, x): z for k, t, y, x, z in rows if z is not None}
    for k in v:
        for y in range(7):
            for x in range(8):
                cs = []
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        both = [t for t in range(11) if (k, t, y, x) in have and (k, t, y + dy, x + dx) in have]
                        if (dy or dx) and both:
                            a, b = (np.array([have[k, t, *p] for t in both]) for p in ((y, x), (y + dy, x + dx)))
                            cs.append(np.corrcoef(a, b)[0, 1] if a.std() > 1e-9 and b.std() > 1e-9 else 0.0)
                assert ((k, y, x) in got) == bool(cs)
                if cs:
                    assert got[k, y, x] == pytest.approx(np.mean(cs), abs=1e-9)


def test_pieces_of_a_sparse_movie_are_looked_at_together(spark, monkeypatch):
    """Frames of a few pixels over many spans: the result doesn't depend on where pieces end, and no span is a piece of its own."""
    g = np.random.default_rng(5)
    rows = [(t, t % 3, int(y), int(x), float(g.standard_normal())) for t in range(4000) for y, x in {(int(a), int(b)) for a, b in g.integers(0, 4, (5, 2))}]
    df = spark.createDataFrame(rows, "t long, block long, y int, x int, v double")
    whole = {(r["y"], r["x"]): r["corr"] for r in pixels.neighbour_correlation(df, [], ["t", "block"], "v", centre_by=["block"]).collect()}
    monkeypatch.setattr(pixels, "PIECE", 100)
    cut = {(r["y"], r["x"]): r["corr"] for r in pixels.neighbour_correlation(df, [], ["t", "block"], "v", centre_by=["block"], span=7).collect()}
    assert len(whole) == 16 and cut == pytest.approx(whole, abs=1e-9)
    m = {}
    for _, b, y, x, z in rows:
        m.setdefault((b, y, x), []).append(z)
    v = {(t, y, x): z - np.mean(m[b, y, x]) for t, b, y, x, z in rows}
    for (y, x), got in whole.items():
        cs = []
        for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]:
            both = [(v[t, y, x], v[t, *q]) for t in range(4000) if (t, y, x) in v and (t, *q) in v]
            cs += [np.corrcoef(*zip(*both))[0, 1]] if both else []
        assert got == pytest.approx(np.mean(cs), abs=1e-9)


def test_shared_items_are_counted_in_packed_lists(spark, monkeypatch):
    g = np.random.default_rng(9)
    rows = sorted({(r, "ABC"[r % 3], int(i)) for r in range(40) for i in g.integers(0, 60, 25)}) + [(1, "B", None), (2, None, 5)]
    df = spark.createDataFrame(rows, "roi long, kind string, item long")
    monkeypatch.setattr(regions, "PAIRS", 50)
    items = {r: {i for q, k, i in rows if q == r and k and i is not None} for r in range(40)}
    for least in (0.0, 0.4):
        got = {(r["a"], r["b"]): r["s"] for r in regions.sharing(df, least).collect()}
        want = {(a, b): len(items[a] & items[b]) for a in range(40) for b in range(a + 1, 40) if a % 3 != b % 3 and items[a] & items[b]}
        assert got == {k: s for k, s in want.items() if s >= least * len(items[k[0]])} and got
