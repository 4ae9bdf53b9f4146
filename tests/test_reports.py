"""Workflows on small sessions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ephyra.operators import baseline
from ephyra.plans import reports


def session(spark, n_roi=6, n_trial=12, seed=0):
    g = np.random.default_rng(seed)
    rows = []
    for r in range(n_roi):
        for k in range(n_trial):
            v = g.standard_normal(60) * 0.5 + 10
            if r == 0:
                v[30:45] += 3
            if r == 1:
                v[30:45] -= 3
            rows += [(r, k, k % 2, "pre" if k < 6 else "post", t, float(x), 30, 45) for t, x in enumerate(v)]
    return spark.createDataFrame(rows, "roi int, trial int, odor int, state string, frame int, v double, on int, off int")


def test_responders_and_calls(spark):
    s = session(spark).persist()
    got = {(r["block"], r["roi"], r["odor"]): r["sign"] for r in reports.responders(s, min_trials=3).collect()}
    assert all(got["all", 0, o] == "excited" and got["all", 1, o] == "suppressed" for o in (0, 1))
    assert sum(v != "none" for (b, r, _), v in got.items() if b == "control") <= 1 and got["pre", 0, 0] == "excited"
    for how in (None, "median", "pc1"):
        calls = reports.trial_calls(s, 10, deglobal=how)
        n = {r["roi"]: (r["e"], r["s"]) for r in calls.groupBy("roi").agg(F.count_if("excited").alias("e"), F.count_if("suppressed").alias("s")).collect()}
        assert n[0][0] >= 10 and n[1][1] >= 10 and n[2][0] <= 3, how
    r = reports.qc_report(s, 10).first()
    assert r["n_rois"] == 6 and r["n_trials"] == 12 and 0.1 < r["share_excited"] < 0.3


def test_first_component_equals_the_decomposition(spark):
    """Two close components: the result is that of the singular value decomposition, not a mixture."""
    g = np.random.default_rng(4)
    x = np.outer(g.standard_normal(9), g.standard_normal(20)) * 2.0 + np.outer(g.standard_normal(9), g.standard_normal(20)) * 1.7
    rows = [(r, 0, t, float(x[r, t])) for r in range(9) for t in range(20)]
    got = {(r["roi"], r["trial"]): r["z"] for r in reports.without_first_component(spark.createDataFrame(rows, "roi int, odor int, trial int, z double"), "z").collect()}
    res = x - x.mean(axis=1, keepdims=True)
    v = np.linalg.svd(res)[2][0]
    v = v - v.mean()
    want = x - np.outer(res @ v / (v @ v), v)
    assert max(abs(got[r, t] - want[r, t]) for r in range(9) for t in range(20)) < 1e-5


def brute_sham(x, odors, on, offsets, span, base):
    z = np.empty((len(offsets), x.shape[0], len(set(odors))))
    for i, shift in enumerate(offsets):
        at = on - shift
        sd = np.sqrt(np.mean((x[:, :, :at] - x[:, :, :at].mean(axis=2, keepdims=True)) ** 2, axis=(1, 2)))
        per = (x[:, :, at : at + span].mean(axis=2) - x[:, :, at - base : at].mean(axis=2)) / sd[:, None]
        for k in sorted(set(odors)):
            z[i, :, k] = per[:, np.array(odors) == k].mean(axis=1)
    return z


def test_sham_null_equals_brute_force(spark):
    from ephyra.plans import qc

    g = np.random.default_rng(5)
    x, odors = g.standard_normal((7, 10, 60)) + 10, [k % 2 for k in range(10)]
    t = spark.createDataFrame([(r, k, odors[k], "pre" if k < 5 else "post", i, float(x[r, k, i]), 40, 55) for r in range(7) for k in range(10) for i in range(60)], "roi int, trial int, odor int, state string, frame int, v double, on int, off int")
    null, rois = qc.thresholds(t, 4.0, 0.1, per_roi=True)
    from ephyra.operators import response

    offsets = response.sham_offsets(40, 8, 8)
    assert offsets == list(range(8, 33, 2))
    z = brute_sham(x, odors, 40, offsets, 8, 4)
    fit, held = z[0::2].ravel(), z[1::2].ravel()
    row = null.first()
    assert row["z_excited"] == pytest.approx(np.percentile(fit, 90)) and row["z_suppressed"] == pytest.approx(np.percentile(fit, 10)) and row["n_null"] == fit.size
    assert row["achieved_excited"] == pytest.approx((held >= np.percentile(fit, 90)).mean()) and row["available"] and not row["per_roi"] and rois is None
    own = {r["roi"]: r["z_excited"] for r in response.sham_null_by_roi(response.sham_responses(t, offsets, 8, 4), 0.1).collect()}
    assert all(own[r] == pytest.approx(np.percentile(z[0::2, r].ravel(), 90)) for r in range(7))
    short = qc.thresholds(t.withColumn("on", F.lit(12)), 4.0)[0].first()
    assert not short["available"] and short["z_excited"] == qc.Z_EXCITED


def test_response_qc_and_its_flags(spark):
    from ephyra.plans import qc

    s = session(spark, n_trial=12).withColumn("v", F.col("v") - F.when(F.col("trial") == 3, 200.0).otherwise(0.0))
    areas = spark.createDataFrame([(r, 5 if r == 2 else 50) for r in range(6)], "roi int, area int")
    blocks, report = qc.response_qc(s, areas, 4.0, target=0.02, outlier_sd=3.0)
    b, r = {x["block"]: x for x in blocks.collect()}, report.first()
    assert set(b) == {"pooled", "pre", "post"} and b["pooled"]["n_excited"] >= 1 and b["pooled"]["n_suppressed"] >= 1 and r["n_dead"] == 1 and r["n_tiny"] == 1
    assert any("10 pixels" in f for f in r["flags"]) and r["source"] == "calibrated"
    assert r["n_suppressed_by_all"] >= 1
    strict = qc.response_qc(s, areas, 4.0, fixed=(3.0, -3.0), outlier_sd=3.0)[1].first()
    assert strict["n_excited"] == strict["n_suppressed"] == strict["n_suppressed_by_all"] == 1 and any("suppressed by every odor" in f for f in strict["flags"])
    quiet = qc.response_qc(session(spark, n_trial=6).where("roi > 1"), areas, 4.0, fixed=(50.0, -50.0))[1].first()
    assert any("fewer than a tenth" in f for f in quiet["flags"]) and quiet["source"] == "fixed" and quiet["n_any"] == 0
    short = qc.response_qc(session(spark).withColumn("on", F.lit(10)), areas, 4.0, per_roi=True)[1].first()
    assert any("no null" in f for f in short["flags"]) and any("too few sham" in f for f in short["flags"])
    falling = session(spark).withColumn("v", F.col("v") * (1 - 0.05 * F.col("trial")) * (1 - 0.005 * F.col("frame")))
    flags = qc.response_qc(falling, areas, 4.0)[1].first()["flags"]
    assert any("within a trial" in f for f in flags) and any("first trial to the last" in f for f in flags)
    odors, trial = qc.trial_report(s, areas, 4.0, 10, outlier_sd=3.0)
    o, t = {(x["block"], x["odor"]): x for x in odors.collect()}, trial.first()
    assert t["dead_trials"] == [3] and t["n_trials"] == 11 and any("left out" in f for f in t["flags"]) and any("manipulation" in f for f in t["flags"])
    assert 0.1 < o["pooled", 0]["excited"] < 0.4 and ("pre", 1) in o
    assert not any("manipulation" in f for f in qc.trial_report(s, areas, 4.0, 10, manipulation="saline")[1].first()["flags"])


def test_first_component_goes(spark):
    g = np.random.default_rng(1)
    w, common = g.standard_normal(8), g.standard_normal(30) * 5
    rows = [(r, 0, t, float(w[r] * common[t] + g.standard_normal() * 0.1)) for r in range(8) for t in range(30)]
    z = spark.createDataFrame(rows, "roi int, odor int, trial int, z double")
    sd = lambda d: d.groupBy("roi").agg(F.stddev_pop("z").alias("s")).agg(F.max("s")).first()[0]
    assert sd(reports.without_first_component(z, "z")) < 0.2 < sd(z)


def test_group_movies_skip_trials_outside(spark):
    f = spark.createDataFrame([(k, t, 0, 0, float(t >= 5) + 0.1 * (t % 2)) for k in (1, 2) for t in range(10)], "trial int, t int, y int, x int, v double")
    t = spark.createDataFrame([(1, 5, 7), (2, 9, 7), (3, 5, 7)], "trial int, on int, odor int")
    movies, skipped = reports.group_z_movies(f, t, 4, 8, ["odor"])
    assert sorted(r[0] for r in skipped.collect()) == [2, 3]
    z = {r["t"]: r["z"] for r in movies.collect()}
    assert len(z) == 8 and z[4] > 10 and abs(sum(z[i] for i in range(4))) < 1e-9


def test_pupils_are_laid_on_frames(spark):
    m = spark.createDataFrame([("a", i * 10, float(i), i == 3, False) for i in range(6)], "k string, cam long, diameter double, blink boolean, clipped boolean")
    grid = spark.createDataFrame([("a", 0, i, i * 5) for i in range(10)], "k string, trial int, frame int, at long")
    per, trials = reports.pupil_by_trial(m, ["k"], "cam", grid, 10)
    got = {r["frame"]: r["diameter"] for r in per.collect()}
    assert got[0] == 0 and got[1] == 0 and got[2] == 1 and got[6] is None
    assert trials.first()["blink_fraction"] == pytest.approx(0.2)
    with pytest.raises(Exception, match="two camera periods"):
        reports.pupil_by_trial(m, ["k"], "cam", grid.withColumn("at", F.col("at") + 1000), 10)[0].collect()


def test_respiration_by_trial(spark):
    t = np.arange(0, 12, 1 / 240)
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(np.sin(2 * np.pi * 3 * t) + 0.01 * np.random.default_rng(0).standard_normal(len(t)))], "k string, sample long, v double")
    f = spark.createDataFrame([("a", i // 5, i, 300 + 200 * i) for i in range(10)], "k string, trial int, frame int, sample long")
    per, trials = reports.respiration_by_trial(s, ["k"], 240.0, f)
    assert trials.where("masked_fraction = 0 and not flagged").count() == 2
    mean = reports.respiration_summary(per, ["k"]).first()
    assert abs(mean["mean"] - 3) < 0.05 and mean["n"] == 10


def test_finalised_round(spark, tmp_path):
    frames = spark.createDataFrame([(k, t, y, x, 5 + 3 * float(np.exp(-t / 6)) + y) for k in (0, 1) for t in range(40) for y in range(4) for x in range(4)], "trial int, t int, y int, x int, v double")
    mask = spark.createDataFrame([(y, x, 1 + y // 2) for y in range(4) for x in range(4)], "y int, x int, label int")
    trials = spark.createDataFrame([(0, 20, 25), (1, 20, 25)], "trial int, on int, off int")
    p = str(tmp_path / "r")
    assert reports.finalize(p, frames, mask, trials, fast=6.0, group_id=1) == "ok"
    t = reports.preferred(spark.read.parquet(p + "/traces"))
    assert t.where("source = 'detrended'").count() == t.count() == 160
    assert t.groupBy("roi").agg(F.stddev_pop("v").alias("s")).agg(F.max("s")).first()[0] < 1e-6
    assert baseline.outside("a", "b", "c", 1.0) is not None


def test_autogroup(spark):
    g = np.random.default_rng(2)
    a, b = g.standard_normal(200), g.standard_normal(200)
    soma = spark.createDataFrame([(5, x, 1) for x in range(5)] + [(5, x, 2) for x in range(40, 45)], "y int, x int, label int")
    proc = spark.createDataFrame([(5, x, 1) for x in range(7, 12)] + [(5, x, 2) for x in range(33, 38)] + [(15, x, 3) for x in range(5)], "y int, x int, label int")
    tr = [("soma", 1, a), ("soma", 2, b), ("process", 1, a), ("process", 2, b), ("process", 3, a)]
    t = spark.createDataFrame([(k, l, 0, i, float(v)) for k, l, s in tr for i, v in enumerate(s)], "kind string, label int, trial int, frame int, v double")
    got = {(r["kind"], r["label"]): r["group"] for r in reports.autogroup(t, soma, proc, 0.5, 2.0, 0.5).collect()}
    assert got["soma", 1] == got["process", 1] != got["soma", 2] == got["process", 2] and ("process", 3) not in got


def test_overlay_and_manual_groups(spark):
    im = spark.createDataFrame([(0, x, float(x)) for x in range(5)], "y int, x int, v double")
    m = spark.createDataFrame([(0, 4, 2)], "y int, x int, label int")
    o = {r["x"]: (r["r"], r["g"], r["b"]) for r in reports.overlay(im, m, [(255, 0, 0), (0, 255, 0)], 0.5, 0.0, 1.0).collect()}
    assert o[0] == (0, 0, 0) and o[2] == (128, 128, 128) and o[4] == (128, 255, 128)
    rois, auto, manual = spark.range(4).toDF("roi"), spark.createDataFrame([(0, 1), (1, 1)], "roi long, group int"), spark.createDataFrame([(1, None), (3, 7)], "roi long, group int")
    assert {r["roi"]: r["group"] for r in reports.roi_groups(rois, auto, manual).collect()} == {0: 1, 1: -1, 2: -1, 3: 7}


def test_first_component_by_products_and_by_iteration(spark):
    """Both ways give what a singular value decomposition gives; empty tables and missing ids give no rows for them."""
    g = np.random.default_rng(4)
    x = np.outer(g.standard_normal(7), g.standard_normal(10)) * 3 + g.standard_normal((7, 10))
    rows = [(i, j % 2, j, float(x[i, j])) for i in range(7) for j in range(10)]
    z = spark.createDataFrame(rows, "roi int, odor int, trial int, z double")
    res = x.copy()
    for o in (0, 1):
        res[:, o::2] -= res[:, o::2].mean(axis=1, keepdims=True)
    w = np.linalg.svd(res)[2][0].copy()
    for o in (0, 1):
        w[o::2] -= w[o::2].mean()
    want = x - np.outer(res @ w / (w @ w), w)
    for bound in (1024, 3):
        got = {(r["roi"], r["trial"]): r["z"] for r in reports.without_first_component(z, "z", gram_trials=bound).collect()}
        assert len(got) == 70 and max(abs(got[i, j] - want[i, j]) for i in range(7) for j in range(10)) < 1e-6
    assert reports.without_first_component(z.limit(0), "z").count() == 0
    extra = z.unionByName(spark.createDataFrame([(None, 0, 0, 99.0), (1, None, 0, 99.0)], z.schema))
    assert reports.without_first_component(extra, "z").count() == 70


def test_responder_flags_against_counts_by_hand(spark):
    g = np.random.default_rng(5)
    rows = [(b, r, o, int(g.integers(8, 14)), None if g.random() < 0.1 else 0.5, bool(g.random() < 0.3), "excited" if g.random() < 0.5 else "suppressed") for b in ("all", "pre", "control") for r in range(20) for o in range(3)]
    rows = [(b, r, o, n, p, rej and p is not None, s if rej and p is not None else "none") for b, r, o, n, p, rej, s in rows]
    schema = "block string, roi int, odor int, n long, p double, rejected boolean, sign string"
    got = {r["block"]: r for r in reports.responder_flags(spark.createDataFrame(rows, schema), detrended=False).collect()}
    for block, r in got.items():
        own = [x for x in rows if x[0] == block]
        most = [max(x[3] for x in own if x[2] == o) for o in range(3)]
        want = (sum(x[4] is not None for x in own), *[sum(x[6] == s for x in own) for s in ("excited", "suppressed")], 20, *[len({x[1] for x in own if x[6] == s}) for s in ("excited", "suppressed")], min(most), sum(m < 10 for m in most))
        assert tuple(r[c] for c in ("n_tests", "n_excited", "n_suppressed", "n_rois", "rois_excited", "rois_suppressed", "fewest_trials", "thin_odors")) == want
    assert got["all"]["flags"] == ["traces are not detrended", "responses in the control"] and got["pre"]["flags"] == [] == got["control"]["flags"]

    def flags(rows, detrended=True):
        return {r["block"]: r["flags"] for r in reports.responder_flags(spark.createDataFrame(rows, schema), detrended).collect()}

    none = [("all", r, 0, 9, 0.9, False, "none") for r in range(10)] + [("control", r, 0, 9, 0.9, False, "none") for r in range(10)]
    assert flags(none)["all"] == ["odors with fewer than 10 trials", "nothing responds"]
    every = [("all", r, 0, 12, 0.0, True, "excited") for r in range(10)]
    assert flags(every)["all"] == ["nearly every roi is excited"] and flags(every[:9] + [("all", 9, 0, 12, 0.5, False, "none")])["all"] == []
    assert flags([("all", 1, 0, 12, None, False, "none")])["all"] == [] and flags([]) == {}


def test_first_component_by_the_fewer_side_takes_one_pass(spark, monkeypatch):
    """More trials than the bound but few rois: the products of the rois give the same, and no round moves weights."""
    g = np.random.default_rng(6)
    x = np.outer(g.standard_normal(5), g.standard_normal(40)) * 3 + g.standard_normal((5, 40))
    z = spark.createDataFrame([(i, j % 2, j, float(x[i, j])) for i in range(5) for j in range(40)], "roi int, odor int, trial int, z double")
    want = {(r["roi"], r["trial"]): r["z"] for r in reports.without_first_component(z, "z").collect()}
    made, real = [], reports.written
    monkeypatch.setattr(reports, "written", lambda df: made.append(0) or real(df))
    got = {(r["roi"], r["trial"]): r["z"] for r in reports.without_first_component(z, "z", gram_trials=8).collect()}
    assert len(made) == 1 and len(got) == 200 and max(abs(got[k] - want[k]) for k in want) < 1e-9
    extra = z.unionByName(spark.createDataFrame([(None, 0, 0, 99.0), (1, None, 0, 99.0)], z.schema))
    assert reports.without_first_component(extra, "z", gram_trials=8).count() == 200
