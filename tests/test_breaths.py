"""Chains, filters in blocks, onsets and the respiration workflow, against the definitions on whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ephyra.operators import clock, longseries, signals
from ephyra.plans import breaths


def fold(events):
    """Events that count, one after another."""
    out, ready = [], None
    for at, r in sorted(events):
        if not out or (ready is not None and at >= ready):
            out.append(at)
            ready = r
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_chain_equals_the_fold(spark, seed):
    g = np.random.default_rng(seed)
    rows, want = [], set()
    for k in [None, "a", "b", "c"]:
        at = np.unique(np.cumsum(g.integers(1, {None: 3, "a": 2, "b": 40, "c": 9}[k], 400)))
        ready = np.maximum.accumulate(at + g.integers(1, 30, len(at)))
        ready = [None if k == "c" and i > 300 else int(r) for i, r in enumerate(ready)]
        rows += [(k, int(a), r) for a, r in zip(at, ready)]
        want |= {(k, a) for a in fold(zip(at.tolist(), ready))}
    df = spark.createDataFrame(rows + rows[:5], "k string, at long, ready long").repartition(5)
    got = clock.chain(df, ["k"], "at", "ready")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    few = clock.debounced(df, ["k"], "at", 7).collect()
    by = {k: fold((a, a + 7) for kk, a, _ in rows if kk == k) for k in [None, "a", "b", "c"]}
    assert sorted(map(tuple, few), key=str) == sorted(((k, a) for k in by for a in by[k]), key=str)
    assert clock.debounced(df.limit(0), ["k"], "at", 7).count() == 0 and "collect_list" not in got._jdf.queryExecution().toString()


def test_recurrence_goes_on_from_any_state():
    b, a = signals.butterworth(1.0, 50.0, 240.0)
    x = np.random.default_rng(3).standard_normal(3000)
    whole, end = longseries.recurrence(b, a, x, np.zeros(4))
    first, z = longseries.recurrence(b, a, x[:777], np.zeros(4))
    rest, z = longseries.recurrence(b, a, x[777:], z)
    assert np.allclose(np.concatenate([first, rest]), whole, atol=1e-12) and np.allclose(z, end)
    assert np.allclose(whole, signals._filter(b, a, x, np.zeros(4)), atol=1e-12)
    alone, state = longseries.recurrence(b, a, x[777:], np.zeros(4))
    response, power = longseries._homogeneous(tuple(a), len(x) - 777)
    begin = longseries.recurrence(b, a, x[:777], np.zeros(4))[1]
    assert np.allclose(alone + response @ begin, whole[777:], atol=1e-10) and np.allclose(power @ begin + state, end, atol=1e-10)


def noisy(n, rate, seed):
    g, t = np.random.default_rng(seed), np.arange(n) / rate
    return np.sin(2 * np.pi * (2 + 0.5 * np.sin(t / 7)) * t) * (1 + 0.5 * np.sin(t / 3)) + 0.3 * np.sin(2 * np.pi * 0.1 * t) + 0.15 * g.standard_normal(n)


@pytest.fixture(scope="module")
def series(spark):
    xs = {"long": noisy(9000, 200.0, 1), "short": noisy(700, 200.0, 2), "tiny": noisy(12, 200.0, 3), "seventeen": noisy(17, 200.0, 4), "flat": np.zeros(900)}
    rows = [(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)]
    return xs, spark.createDataFrame(rows, "k string, i long, v double").repartition(7)


@pytest.mark.parametrize("block", [10, 1000, 1 << 20])
def test_bandpass_in_blocks_equals_the_whole(spark, series, block):
    xs, df = series
    if block == 10:
        xs, df = {k: x for k, x in xs.items() if len(x) < 1000}, df.where("k <> 'long'")
    got = {}
    for r in longseries.bandpassed(df, ["k"], "i", "v", 200.0, block=block).collect():
        got.setdefault(r["k"], {})[r["i"]] = r["v"]
    for k, x in xs.items():
        y = np.array([got[k][i] for i in range(len(x))])
        assert np.abs(y - signals.bandpass(x, 200.0)).max() < 1e-9, k


def test_onsets_and_quality_in_blocks_equal_the_whole(spark, series):
    xs, df = series
    got, score = {k: [] for k in xs}, {k: [] for k in xs}
    for r in longseries.inhalations(df, ["k"], "i", "v", 200.0, block=1500).collect():
        got[r["k"]].append(r["sample"])
    for r in longseries.quality(df, ["k"], "i", "v", 200.0, tiles=7).orderBy("tile").collect():
        score[r["k"]].append(r["score"])
    for k, x in xs.items():
        assert sorted(got[k]) == signals.onsets(signals.bandpass(x, 200.0), 200.0).tolist(), k
        assert np.allclose(score[k], signals.band_quality(x, 200.0)), k
    assert len(got["long"]) > 50
    with pytest.raises(ValueError, match="fewer than 8"):
        longseries.quality(df, ["k"], "i", "v", 7.0)


def test_exact_percentile(spark):
    g = np.random.default_rng(0)
    xs = {"a": g.standard_normal(30_000), "b": g.integers(0, 3, 20_000).astype(float), "c": g.standard_normal(5), "d": np.array([2.5])}
    df = spark.createDataFrame([(k, float(v)) for k, x in xs.items() for v in x] + [("a", None), ("e", None)], "k string, v double")
    for q in (0.0, 0.1, 0.5, 1.0):
        got = {r["k"]: r["p"] for r in longseries.exact_percentile(df, ["k"], "v", q).collect()}
        assert set(got) == set(xs) and all(abs(got[k] - np.percentile(x, 100 * q)) < 1e-12 for k, x in xs.items())


def test_three_onsets_hold_the_interval_that_begins_there(spark):
    """Onsets at 1, 1.5 and 2.5 s: 2 Hz, then 1 Hz, held beyond the last; none before the first. Quality lies between middles only."""
    onsets = spark.createDataFrame([("s", t) for t in (100, 150, 250)] + [("one", 5)], "k string, at long")
    scores = spark.createDataFrame([("s", i, v) for i, v in enumerate((4.0, 8.0, 2.0, 6.0))] + [("one", 0, 9.0), ("one", 1, 9.0)], "k string, tile long, score double")
    at = spark.createDataFrame([("s", t) for t in (20, 99, 100, 149, 150, 249, 250, 340, 360)] + [("one", 60)], "k string, at long")
    rated = signals.breath_rates(onsets, scores, at, ["k"], "at", 100.0, 100.0, smooth=1)
    got = {(r["k"], r["at"]): (r["frequency"], None if r["quality"] is None else round(r["quality"], 9), r["rate"]) for r in rated.collect()}
    assert got == {
        ("s", 20): (None, None, None), ("s", 99): (None, 5.96, None), ("s", 100): (2.0, 6.0, 2.0), ("s", 149): (2.0, 7.96, 2.0), ("s", 150): (1.0, 8.0, 1.0), ("s", 249): (1.0, 2.06, None),
        ("s", 250): (1.0, 2.0, None), ("s", 340): (1.0, 5.6, 1.0), ("s", 360): (1.0, None, None), ("one", 60): (None, None, None),
    }
    report = {r["k"]: r for r in signals.breath_report(onsets, scores, rated, ["k"]).collect()}
    assert (report["s"]["n_breaths"], report["s"]["median_hz"], report["s"]["fraction_good"]) == (2, 1.0, 0.5) and "50%" in report["s"]["flags"][0]
    assert (report["one"]["n_breaths"], report["one"]["median_hz"], report["one"]["fraction_good"]) == (0, None, 0.0) and "no onset" in report["one"]["flags"][0]


def recording(spark, n_trial=3, n_frame=40, rate=200, noise=None, pulses=None):
    """Trials of frames at 20 Hz, 3 s apart; the odor comes with frame 10; breaths at 3 Hz, noise in the given seconds."""
    g = np.random.default_rng(0)
    total = n_trial * (n_frame * 10 + 3 * rate) + 400
    frames, odor, rows = np.zeros(total), np.zeros(total), []
    for k in range(n_trial):
        at = 200 + k * (n_frame * 10 + 3 * rate)
        for f in range(n_frame):
            frames[at + 10 * f : at + 10 * f + 4] = 5
        if pulses is None or k in pulses:
            odor[at + 10 * 10 : at + 10 * 20] = 5
    t = np.arange(total) / rate
    breath = np.sin(2 * np.pi * 3 * t) + 0.01 * g.standard_normal(total)
    if noise:
        lo, hi = (int(s * rate) for s in noise)
        breath[lo:hi] = g.standard_normal(hi - lo)
    for name, x in zip(breaths.CHANNELS.values(), (frames, breath, odor), strict=True):
        rows += [("s", name, i, float(v)) for i, v in enumerate(x)]
    channels = spark.createDataFrame(rows, "exp string, channel string, at long, value double")
    trials = spark.createDataFrame([("s", k, 100 + k, k % 2) for k in range(n_trial)], "exp string, trial int, acq_id long, odor int")
    return channels, trials


def test_respiration_from_round(spark):
    channels, trials = recording(spark, noise=(5.5, 8.5))
    frames, per, report = breaths.respiration_from_round(channels, trials, ["exp"], 200.0)
    assert frames.count() == 120 and frames.where("trial = 0 and frame between 10 and 30").agg(F.min("rate"), F.max("rate")).first() == pytest.approx((3.0, 3.0), abs=0.2)
    flags = {r["trial"]: (r["flagged"], r["odor"]) for r in per.collect()}
    assert flags == {0: (False, 0), 1: (True, 1), 2: (False, 0)}
    r = report.first()
    assert (r["n_trial"], r["n_frame"], r["n_flagged"], r["flagged_trials"], r["n_odor_pulses"]) == (3, 40, 1, [1], 3)
    assert 0.5 < r["fraction_good"] < 1 and r["median_hz"] == pytest.approx(3.0, abs=0.2) and any("1 of 3 trials" in f for f in r["flags"])
    with pytest.raises(ValueError, match="s: 3 acquisitions but 2 trials"):
        breaths.respiration_from_round(channels, trials.where("trial < 2"), ["exp"], 200.0)
    uneven = channels.where("not (channel = '2pFrameSync' and at between 200 and 215)")
    with pytest.raises(ValueError, match="differ in length, from 38 to 40"):
        breaths.respiration_from_round(uneven, trials, ["exp"], 200.0)


def test_extract_respiration(spark):
    channels, trials = recording(spark)
    _, per, report = breaths.extract_respiration(channels, trials, ["exp"], 200.0)
    assert sorted((r["trial"], r["on_frame"], r["off_frame"]) for r in per.collect()) == [(0, 10, 20), (1, 10, 20), (2, 10, 20)]
    r = report.first()
    assert (r["frame_rate"], r["n_pre"], r["onset_frame_spread"], r["n_flagged"], r["flags"]) == (20.0, 10, 0, 0, [])
    with pytest.raises(ValueError, match="no odor pulse lies inside acquisition 1"):
        breaths.extract_respiration(recording(spark, pulses=(0, 2))[0], trials, ["exp"], 200.0)
    with pytest.raises(ValueError, match="no acq_id"):
        breaths.extract_respiration(channels, trials.withColumn("acq_id", F.lit(None).cast("long")), ["exp"], 200.0)
