"""Groups found in rounds against the ordered fold; fits by sums against least squares."""

import numpy as np
import pytest

from ephyra.operators import baseline, grouping


def fold(links, soma, least):
    """Links one after another, strongest first."""
    parent, held = {}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = {}
    for a, b, c, g in sorted((x for x in links if x[2] is not None and x[2] >= least), key=lambda x: (-x[2], x[3], x[0], x[1])):
        for x in (a, b):
            held.setdefault(find(x), x in soma)
        ra, rb = sorted((find(a), find(b)))
        out[a, b] = "already_grouped" if ra == rb else "two_somas" if held[ra] and held[rb] else "linked"
        if out[a, b] == "linked":
            parent[rb], held[ra] = ra, held[ra] or held[rb]
    least_of = {}
    for x in sorted(parent):
        least_of.setdefault(find(x), x)
    return {**{(a, b): ("below_correlation", None) for a, b, c, _ in links if c is None or c < least}, **{(a, b): (s, least_of[find(a)]) for (a, b), s in out.items()}}


def graph(kind, g):
    n = 60
    if kind == "chain":  # weights rise along the chain: one pair at a time is best at both ends
        pairs = [(i, i + 1, 0.3 + i / 100, 1.0) for i in range(n)]
    elif kind == "star":
        pairs = [(0, i, float(g.choice([0.4, 0.6])), float(i % 3)) for i in range(1, n)]
    else:
        pairs = {(min(a, b), max(a, b)) for a, b in g.integers(0, n, (170, 2)).tolist() if a != b}
        pairs = [(a, b, None if g.random() < 0.05 else round(float(g.random()), 1 if kind == "ties" else 3), float(g.integers(0, 2))) for a, b in sorted(pairs)]
    soma = set(g.choice(n, {"chain": 9, "star": 30}.get(kind, 14), replace=False).tolist())
    return pairs, soma


@pytest.mark.parametrize("kind", ["chain", "star", "random", "ties"])
def test_groups_equal_the_fold(spark, kind):
    g = np.random.default_rng({"chain": 1, "star": 2, "random": 3, "ties": 4}[kind])
    pairs, soma = graph(kind, g)
    links = spark.createDataFrame(pairs, "a long, b long, corr double, gap double").repartition(6)
    kinds = spark.createDataFrame([(i, i in soma) for i in range(61)], "roi long, soma boolean")
    got = grouping.constrained_groups(links, kinds, 0.35)
    assert {(r["a"], r["b"]): (r["status"], r["root"]) for r in got.collect()} == fold(pairs, soma, 0.35)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_groups_of_no_links(spark):
    kinds = spark.createDataFrame([(1, True)], "roi long, soma boolean")
    none = spark.createDataFrame([], "a long, b long, corr double, gap double")
    assert grouping.constrained_groups(none, kinds, 0.5).count() == 0
    weak = spark.createDataFrame([(1, 2, 0.1, 0.0), (1, 3, None, 0.0)], "a long, b long, corr double, gap double")
    assert {r["status"] for r in grouping.constrained_groups(weak, kinds, 0.5).collect()} == {"below_correlation"}


@pytest.mark.parametrize("components", [1, 2])
def test_fits_find_the_constants_that_made_the_trace(spark, components):
    t = np.arange(200) / 10
    made = {1: (2.5, None, 3.0, 0.0, 7.0), 2: (0.8, 8.0, 3.0, -1.5, 5.0)}[components]
    y = made[2] * np.exp(-t / made[0]) + (made[3] * np.exp(-t / made[1]) if made[1] else 0) + made[4]
    noise = 0.05 * np.random.default_rng(0).standard_normal(len(t))
    rows = [(k, f, None if f == 17 else float("nan") if f == 18 else float(v)) for k, x in (("clean", y), ("noisy", y + noise)) for f, v in enumerate(x)] + [("few", f, 1.0) for f in range(19)] + [("flat", f, 2.0) for f in range(40)]
    df = spark.createDataFrame(rows, "roi string, frame int, v double").repartition(5)
    got = {r["roi"]: r for r in baseline.fit_baseline(df, ["roi"], "frame", "v", 10.0, components=components).collect()}
    assert not got["few"]["ok"] and got["few"]["tau_fast"] is None
    assert got["flat"]["ok"] and got["flat"]["c"] == pytest.approx(2.0) and got["flat"]["r2"] is None
    r = got["clean"]
    assert (r["tau_fast"], r["a_fast"], r["c"]) == pytest.approx((made[0], made[2], made[4]), rel=0.02) and r["r2"] > 0.999999
    if components == 2:
        assert (r["tau_slow"], r["a_slow"]) == pytest.approx((made[1], made[3]), rel=0.02)
    else:
        assert r["tau_slow"] is None and r["a_slow"] is None
    keep = np.setdiff1d(np.arange(200), [17, 18])
    x = np.stack([np.exp(-t / got["noisy"]["tau_fast"]), *([np.exp(-t / got["noisy"]["tau_slow"])] if components == 2 else []), np.ones_like(t)], 1)[keep]
    own = ((y + noise)[keep] - x @ np.linalg.lstsq(x, (y + noise)[keep], rcond=None)[0])
    assert got["noisy"]["r2"] == pytest.approx(1 - (own**2).sum() / (((y + noise)[keep] - (y + noise)[keep].mean()) ** 2).sum(), abs=1e-9)
    best = min(search(t[keep], (y + noise)[keep], components))
    assert (own**2).sum() <= best * (1 + 1e-4)


def search(t, y, components):
    """Squares left on a fine grid over the bounds."""
    for tau in np.geomspace(*(baseline.FAST_S if components == 2 else baseline.ONLY_S), 80):
        for ratio in np.geomspace(*baseline.RATIO, 50) if components == 2 else [None]:
            x = np.stack([np.exp(-t / tau), *([np.exp(-t / tau / ratio)] if ratio else []), np.ones_like(t)], 1)
            yield float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
