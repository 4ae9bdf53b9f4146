"""Baseline trends of traces: exponential fits and shapes, and their removal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import finite, safe_ratio
from ..sources.shared import saved

#: Bounds of the fast time constant in seconds (of a single one it is the only one) and of the slow one's ratio to it,
#: seconds after an odor that are left out, and the least number of frames.
FAST_S, ONLY_S, RATIO, GUARD_S, LEAST_FRAMES, LEAST_ROWS = (0.1, 10.0), (0.1, 60.0), (2.0, 40.0), 6.0, 20, 8


def outside(frame, on, off, guard: float) -> Column:
    """Whether a frame lies before the odor or `guard` frames after its end."""
    return (F.col(frame) < F.col(on)) | (F.col(frame) >= F.col(off) + guard)


def grid_fits(rows: DataFrame, keys: list[str], bounds: DataFrame, components: int, steps: tuple[int, int] = (13, 9)) -> DataFrame:
    """(keys, i, j, lt, lr, a, b, sse): least squares for each point of a grid of time constants exp(lt) and ratios exp(lr).

    rows (keys, t, v): times in seconds and values less their key's mean. bounds (keys, lo, hi, rlo, rhi): the grid's ends. With the time
    constants given the rest is linear, so sums over the rows say all: one aggregation, which tasks begin before the shuffle, serves
    all points of all keys. Where the two exponentials can't be told apart the slow one has no part."""
    ni, nj = steps[0], steps[1] if components == 2 else 1
    at = lambda lo, hi, k, n: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(k) / (n - 1) if n > 1 else F.col(lo)
    grid = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ni - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nj - 1))))
    points = grid.select(*keys, "i", "j", at("lo", "hi", "i", ni).alias("lt"), at("rlo", "rhi", "j", nj).alias("lr"))
    both = rows.join(points, keys).select(*keys, "i", "j", "lt", "lr", "v", F.exp(-F.col("t") / F.exp("lt")).alias("q"), (F.exp(-F.col("t") / F.exp(F.col("lt") + F.col("lr"))) if components == 2 else F.lit(0.0)).alias("r"))
    s = lambda x, y: F.sum(F.col(x) * F.col(y)).alias(x + y)
    m = both.groupBy(*keys, "i", "j", "lt", "lr").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), F.sum("r").alias("r"), F.sum("v").alias("v"), s("q", "q"), s("r", "r"), s("q", "r"), s("q", "v"), s("r", "v"), s("v", "v"))
    cov = lambda x, y: F.col(x + y) - F.col(x) * F.col(y) / F.col("n")
    m = m.select(*keys, "i", "j", "lt", "lr", *[cov(*p).alias(p) for p in ("qq", "rr", "qr", "qv", "rv", "vv")])
    det = F.col("qq") * F.col("rr") - F.col("qr") * F.col("qr")
    apart = det > 1e-12 * F.col("qq") * F.col("rr")
    alone = F.coalesce(safe_ratio("qv", "qq"), F.lit(0.0))
    a = F.when(apart, (F.col("qv") * F.col("rr") - F.col("rv") * F.col("qr")) / det).otherwise(alone)
    b = F.when(apart, (F.col("rv") * F.col("qq") - F.col("qv") * F.col("qr")) / det).otherwise(0.0)
    return m.withColumns({"a": a, "b": b}).select(*keys, "i", "j", "lt", "lr", "a", "b", F.greatest(F.lit(0.0), F.col("vv") - F.col("a") * F.col("qv") - F.col("b") * F.col("rv")).alias("sse"))


def fit_baseline(means: DataFrame, keys: list[str], frame: str, value: str, rate: float, components: int = 2, window: str = "outside", odor: tuple[int, int] | None = None, guard_s: float = GUARD_S, rounds: int = 7) -> DataFrame:
    """(keys, ok, tau_fast, tau_slow, a_fast, a_slow, c, r2) of a * exp(-t/tau) sums fitted to mean traces. odor: the first onset and
    the last end of the odor in frames; frames from it until guard_s after it are left out, or (window "pre") all from it on. None:
    the traces are all baseline. A key may hold the trial, for a fit of each trial.

    For given time constants the rest is linear, so only those are searched: a grid over their bounds (`grid_fits`), closed in around
    its best point in each of a few rounds. A round is one aggregation for all keys; no trace is gathered."""
    if window not in ("pre", "outside"):
        raise ValueError(f"window is 'pre' or 'outside', not {window!r}")
    if odor is not None:
        on, off = odor
        means = means.where(F.col(frame) < on) if window == "pre" else means.where((F.col(frame) < on) | (F.col(frame) >= off + round(guard_s * rate)))
    taus = FAST_S if components == 2 else ONLY_S
    ends = {"lo": np.log(taus[0]), "hi": np.log(taus[1]), "rlo": np.log(RATIO[0]), "rhi": np.log(RATIO[1])}
    given = means.select(*keys, (F.col(frame) / rate).alias("t"), finite(F.col(value).cast("double")).alias("y"))
    per = saved(given.groupBy(*keys).agg(F.count("y").alias("n"), F.avg("y").alias("m")))
    enough = per.where(F.col("n") >= LEAST_FRAMES)
    rows = saved(given.where("y is not null").join(enough, keys).select(*keys, "t", (F.col("y") - F.col("m")).alias("v")))
    sums = rows.groupBy(*keys).agg(F.sum(F.col("v") * F.col("v")).alias("total"))
    bounds = enough.select(*keys, *[F.lit(float(v)).alias(k) for k, v in ends.items()])
    best = None
    for _ in range(rounds):
        fits = grid_fits(rows, keys, bounds, components)
        found = fits.groupBy(*keys).agg(F.min_by(F.struct("sse", "lt", "lr", "a", "b"), F.struct("sse", "i", "j")).alias("f"))
        if best is not None:
            found = found.join(best.withColumnRenamed("f", "g"), keys).select(*keys, F.when(F.col("f.sse") < F.col("g.sse"), F.col("f")).otherwise(F.col("g")).alias("f"))
        best = saved(found)
        near = lambda c, lo, hi, share, end, out: F.greatest(F.lit(float(ends[end])), c - (F.col(hi) - F.col(lo)) / share) if out < 0 else F.least(F.lit(float(ends[end])), c + (F.col(hi) - F.col(lo)) / share)
        t, r = F.col("f.lt"), F.col("f.lr")
        bounds = saved(bounds.join(best, keys).select(*keys, near(t, "lo", "hi", 12, "lo", -1).alias("lo"), near(t, "lo", "hi", 12, "hi", 1).alias("hi"), near(r, "rlo", "rhi", 8, "rlo", -1).alias("rlo"), near(r, "rlo", "rhi", 8, "rhi", 1).alias("rhi")))
    tau, slow = F.exp("f.lt"), F.exp(F.col("f.lt") + F.col("f.lr"))
    at_mean = rows.join(best, keys).groupBy(*keys).agg(F.avg(F.exp(-F.col("t") / tau)).alias("_q"), F.avg(F.exp(-F.col("t") / slow)).alias("_r"))
    two = F.lit(components == 2)
    out = per.join(best, keys, "left").join(at_mean, keys, "left").join(sums, keys, "left")
    return out.select(
        *keys, F.col("f").isNotNull().alias("ok"), tau.alias("tau_fast"), F.when(two, slow).alias("tau_slow"), F.col("f.a").alias("a_fast"), F.when(two, F.col("f.b")).alias("a_slow"),
        F.when(F.col("f").isNotNull(), F.col("m") - F.col("f.a") * F.col("_q") - F.col("f.b") * F.col("_r")).alias("c"), (1 - safe_ratio("f.sse", "total")).alias("r2"),
    )


def detrend_exponential(traces: DataFrame, keys: list[str], frame: str, value: str, fast: float, slow: float | None, mask: Column) -> DataFrame:
    """traces less the exponentials with these time constants (in frames) that least squares fits to each key's masked frames; the
    constant stays. Fewer than 8 finite frames: unchanged. The normal equations are sums, so no trace is gathered."""
    q = F.exp(-F.col(frame) / fast)
    v = F.when(mask, finite(value))
    t = traces.withColumn("_q", q)
    if slow is None:
        k = t.groupBy(*keys).agg(F.regr_slope(v, F.col("_q")).alias("_b"), F.count(v).alias("_n"))
        return t.join(k, keys).withColumn(value, F.col(value) - F.when(F.col("_n") >= LEAST_ROWS, F.coalesce("_b", F.lit(0.0))).otherwise(0.0) * F.col("_q")).drop("_q", "_b", "_n")
    t = t.withColumn("_r", F.exp(-F.col(frame) / slow))
    on = v.isNotNull()
    s = lambda e: F.sum(F.when(on, e))
    k = t.groupBy(*keys).agg(F.count(v).alias("n"), s(F.col("_q")).alias("q"), s(F.col("_r")).alias("r"), s(v).alias("v"), s(F.col("_q") * F.col("_q")).alias("qq"), s(F.col("_r") * F.col("_r")).alias("rr"), s(F.col("_q") * F.col("_r")).alias("qr"), s(F.col("_q") * v).alias("qv"), s(F.col("_r") * v).alias("rv"))
    cov = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    qq, rr, qr, qv, rv = cov("q", "q", "qq"), cov("r", "r", "rr"), cov("q", "r", "qr"), cov("q", "v", "qv"), cov("r", "v", "rv")
    det = qq * rr - qr * qr
    ok = F.col("n") >= LEAST_ROWS
    k = k.select(*keys, F.when(ok, safe_ratio(qv * rr - rv * qr, det)).alias("_a"), F.when(ok, safe_ratio(rv * qq - qv * qr, det)).alias("_b"))
    return t.join(k, keys).withColumn(value, F.col(value) - F.coalesce("_a", F.lit(0.0)) * F.col("_q") - F.coalesce("_b", F.lit(0.0)) * F.col("_r")).drop("_q", "_r", "_a", "_b")


def fit_shape(traces: DataFrame, keys: list[str], frame: str, value: str, mask: Column, length: int) -> DataFrame:
    """(frame, shape): the median over traces, each over its mean outside the window, on a line across the window, less its mean."""
    from . import clock

    norm = traces.groupBy(*keys).agg(F.avg(F.when(mask, finite(value))).alias("_m"))
    med = traces.where(mask).join(norm, keys).groupBy(frame).agg(F.median(safe_ratio(value, "_m", 1e-9)).alias("shape")).withColumn("_k", F.lit(0))
    grid = traces.sparkSession.range(length).select(F.col("id").cast("int").alias(frame), F.lit(0).alias("_k"))
    line = clock.interpolated(grid, med.select("_k", F.col(frame).cast("int").alias(frame), "shape"), ["_k"], frame, "shape")
    mean = line.agg(F.avg("shape").alias("_a"))
    return line.crossJoin(F.broadcast(mean)).select(frame, (F.col("shape") - F.col("_a")).alias("shape"))


def detrend_by_shape(traces: DataFrame, keys: list[str], frame: str, value: str, mask: Column, shape: DataFrame | None = None) -> DataFrame:
    """traces (frames of the mask, or of `shape`) less slope * shape, the slope by regression on the masked frames of each key. The
    default shape is the median trace."""
    own = shape if shape is not None else traces.where(mask).groupBy(frame).agg(F.median(value).alias("shape"))
    both = traces.join(own, frame)
    k = both.where(mask).groupBy(*keys).agg(F.regr_slope(value, "shape").alias("_b"))
    return both.join(k, keys).withColumn(value, F.col(value) - F.coalesce("_b", F.lit(0.0)) * F.col("shape")).drop("shape", "_b")


def slopes(traces: DataFrame, keys: list[str], frame: str, value: str, shape: DataFrame) -> DataFrame:
    """(median, iqr) of the slopes on a shape."""
    k = traces.join(shape, frame).groupBy(*keys).agg(F.regr_slope(value, "shape").alias("b"))
    return k.agg(F.median("b").alias("median"), (F.expr("percentile(b, 0.75)") - F.expr("percentile(b, 0.25)")).alias("iqr"))
