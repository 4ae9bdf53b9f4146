"""Responses of traces to events: deltas, tests, multiplicity, empirical thresholds, robust scaling, sparseness.

Traces are long tables (roi, trial, frame, v); trials carry the event's frames and the odor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite, safe_ratio
from ..sources.shared import saved

MAD = 1.4826


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df (one row for each value of a key) with running sums in order of the value, the row's own included, and totals:
    for each name in sums (name: column) the columns name and name_total.

    Rows are dealt by ranges of the value, summed within their range, and a range adds what the ranges before it hold: the only
    table that is ordered in one place has a row for each range, so no task sees all rows even if there is one key."""
    order = F.col(value).desc() if descending else F.col(value)
    dealt = saved(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    w = Window.partitionBy(*keys)
    before = w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_range_id"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_s_{n}").over(w).alias(f"{n}_total") for n in sums])
    own = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    got = dealt.withColumns({f"_o_{n}": F.sum(c).over(own) for n, c in sums.items()})
    on = [F.col("_range") == F.col("_range_id"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return got.join(ranges, on).withColumns({n: F.col(f"_o_{n}") + F.col(f"_b_{n}") for n in sums}).drop("_range", "_range_id", *[f"_k_{k}" for k in keys], *[f"{x}{n}" for n in sums for x in ("_o_", "_b_")])


def trial_deltas(traces: DataFrame, keys: list[str], frame, value: str, on, off, baseline_frames: int | None = None) -> DataFrame:
    """(keys, base, resp, delta, n_base, n_resp): the mean over [on, off) less the mean before on (its last baseline_frames)."""
    t, on, off = F.col(frame), F.col(on), F.col(off)
    pre = (t < on) & (t >= on - baseline_frames) if baseline_frames else t < on
    post = (t >= on) & (t < off)
    v = finite(value)
    got = traces.groupBy(*keys).agg(F.avg(F.when(pre, v)).alias("base"), F.avg(F.when(post, v)).alias("resp"), F.count(F.when(pre, v)).alias("n_base"), F.count(F.when(post, v)).alias("n_resp"))
    return got.withColumn("delta", F.col("resp") - F.col("base"))


def trial_responses(traces: DataFrame, roi: list[str], trial: str, frame, value: str, on, off, pooled: bool = True, baseline_frames: int | None = None, carry: list[str] = ()) -> DataFrame:
    """(roi, trial, carry, dff, z): the response less the mean of the baseline (the last baseline_frames before the onset, or all),
    against |base|, and against the standard deviation of all frames before the onset, of the trial or (pooled) within all its
    roi's trials. carry: columns that are the same in all frames of a trial."""
    t, on = F.col(frame), F.col(on)
    v = finite(value)
    pre, post = F.when(t < on, v), F.when((t >= on) & (t < F.col(off)), v)
    base = F.when((t < on) & (t >= on - baseline_frames), v) if baseline_frames else pre
    got = traces.groupBy(*roi, trial, *carry).agg(F.avg(base).alias("base"), F.avg(post).alias("resp"), F.var_pop(pre).alias("_var"), F.count(pre).alias("_n"))
    var = F.sum(F.col("_var") * F.col("_n")).over(Window.partitionBy(*roi)) / F.sum("_n").over(Window.partitionBy(*roi)) if pooled else F.col("_var")
    return got.withColumn("sd", F.sqrt(var)).withColumns({"dff": safe_ratio(F.col("resp") - F.col("base"), F.abs("base"), 1e-9), "z": safe_ratio(F.col("resp") - F.col("base"), "sd", 1e-9)}).drop("_var", "_n")


def t_statistics(deltas: DataFrame, keys: list[str], value: str = "delta", min_trials: int = 5) -> DataFrame:
    """(keys, n, mean, sd, t) of groups with enough trials; NULLs are left out."""
    v = finite(value)
    return deltas.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).where(F.col("n") >= min_trials).withColumn("t", safe_ratio(F.col("mean") * F.sqrt("n"), "sd"))


def bh_reject(tests: DataFrame, p: str, q: float = 0.05, keys: list[str] = ()) -> DataFrame:
    """tests with rejected and cutoff: the largest p that is at most its rank / number * q. NULL p values take no part. Ranks are
    running counts of distinct p values (see running), so tests of one family may be any number."""
    v = tests.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n"))
    ok = running(v, list(keys), p, {"_rank": "_n"}).where(F.col(p) <= F.col("_rank") / F.col("_rank_total") * q)
    cut = ok.groupBy(*keys).agg(F.max(p).alias("cutoff"))
    got = tests.join(cut, list(keys), "left") if keys else tests.join(F.broadcast(cut), F.lit(True), "left")
    return got.withColumn("rejected", F.coalesce(F.col(p) <= F.col("cutoff"), F.lit(False)))


def centre_scale(values: DataFrame, keys: list[str], value: str, robust: bool = True) -> DataFrame:
    """(keys, centre, scale): median and 1.4826 MAD, or mean and sample standard deviation."""
    if not robust:
        return values.groupBy(*keys).agg(F.avg(value).alias("centre"), F.stddev_samp(value).alias("scale"))
    centre = values.groupBy(*keys).agg(F.median(value).alias("centre"))
    return values.join(centre, keys).groupBy(*keys).agg(F.first("centre").alias("centre"), (F.median(F.abs(F.col(value) - F.col("centre"))) * MAD).alias("scale"))


def scaled(values: DataFrame, keys: list[str], value: str, reference: str | None = None, robust: bool = True, name: str = "z") -> DataFrame:
    """values with (value - centre) / scale, both taken from the reference column (its own by default)."""
    cs = centre_scale(values.where(F.col(reference or value).isNotNull()), keys, reference or value, robust)
    return values.join(cs, keys, "left").withColumn(name, safe_ratio(F.col(value) - F.col("centre"), "scale"))


def empirical_threshold(z: DataFrame, keys: list[str], value: str, is_null: str, target_fdr: float = 0.05) -> DataFrame:
    """(keys, excited, suppressed): for each tail the least extreme real value at which the share of null values strictly beyond
    it, times the number of real ones, over the number of real ones as extreme, is within the target. Counts are per distinct
    value, so ties need no care and one ordered pass does both."""
    v = z.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.col(is_null).cast("long")).alias("_null"), F.sum((~F.col(is_null)).cast("long")).alias("_real"))
    out = None
    for name, down, pick in (("excited", True, F.min), ("suppressed", False, F.max)):
        c = running(v, list(keys), value, {"_b": "_null", "_r": "_real"}, down)
        good = (F.col("_real") > 0) & ((F.col("_b") - F.col("_null")) * F.col("_r_total") <= target_fdr * F.col("_r") * F.col("_b_total"))
        got = c.groupBy(*keys).agg(pick(F.when(good, F.col(value))).alias(name))
        out = got if out is None else (out.join(got, list(keys)) if keys else out.crossJoin(got))
    return out


def without_median(z: DataFrame, roi: str, odor: str, trial: str, value: str) -> DataFrame:
    """z with `clean`: what each trial's median over rois (of residuals from the roi's mean for the odor) explains is taken out of
    each roi's residuals by regression."""
    r = z.withColumn("_mean", F.avg(value).over(Window.partitionBy(roi, odor))).withColumn("_res", F.col(value) - F.col("_mean"))
    common = r.groupBy(odor, trial).agg(F.median("_res").alias("_g"))
    common = common.withColumn("_g", F.col("_g") - F.avg("_g").over(Window.partitionBy(odor)))
    both = r.join(common, [odor, trial])
    slope = both.groupBy(roi).agg(safe_ratio(F.sum(F.col("_res") * F.col("_g")), F.sum(F.col("_g") * F.col("_g"))).alias("_slope"))
    return both.join(slope, roi).withColumn("clean", F.col(value) - F.coalesce("_slope", F.lit(0.0)) * F.col("_g")).drop("_mean", "_res", "_g", "_slope")


def sparsity(calls: DataFrame, odor: list[str], trial: str, called: str) -> DataFrame:
    """(odor, n_trials, mean, sem) of the share of rois called in a trial."""
    share = calls.groupBy(*odor, trial).agg(F.avg(F.col(called).cast("double")).alias("_s"))
    return share.groupBy(*odor).agg(F.count("_s").alias("n_trials"), F.avg("_s").alias("mean"), safe_ratio(F.stddev_samp("_s"), F.sqrt(F.count("_s"))).alias("sem"))


def split_half(calls: DataFrame, roi: list[str], place: str, value: str, threshold: float = 2.0) -> DataFrame:
    """(n, false_rate, kurtosis): control values at odd places scaled by those at even ones: how many pass, how heavy the tails."""
    even = centre_scale(calls.where(F.col(place) % 2 == 0), roi, value)
    z = calls.where(F.col(place) % 2 == 1).join(even, roi).withColumn("_z", safe_ratio(F.col(value) - F.col("centre"), "scale"))
    return z.agg(F.count("_z").alias("n"), F.avg((F.abs("_z") >= threshold).cast("double")).alias("false_rate"), F.kurtosis("_z").alias("kurtosis"))


def chance_table(z: DataFrame, value: str, control: str, thresholds=(1.5, 2.0, 2.5, 3.0, 3.5, 4.0)) -> DataFrame:
    """(threshold, observed, chance, ratio) of the shares of values and controls that pass each threshold, in one pass."""
    aggs = [F.struct(F.lit(t).alias("threshold"), F.avg((F.col(value) >= t).cast("double")).alias("observed"), F.avg((F.col(control) >= t).cast("double")).alias("chance")).alias(f"_{i}") for i, t in enumerate(thresholds)]
    return z.agg(*aggs).select(F.explode(F.array(*[f"_{i}" for i in range(len(thresholds))])).alias("_t")).select("_t.*").withColumn("ratio", safe_ratio("observed", "chance"))


def treves_rolls(rates: DataFrame, keys: list[str], rate: str) -> DataFrame:
    """(keys, n, sparseness): (1 - mean(|r|)^2 / mean(r^2)) / (1 - 1/n), over odors (lifetime) or over rois (population)."""
    r = F.abs(F.col(rate))
    a = rates.groupBy(*keys).agg(F.count(rate).alias("n"), F.avg(r).alias("_m"), F.avg(r * r).alias("_q"))
    return a.withColumn("sparseness", safe_ratio(1 - safe_ratio(F.col("_m") * F.col("_m"), "_q"), 1 - F.lit(1.0) / F.col("n"))).drop("_m", "_q")


def sham_offsets(first_onset: int, span: int, n_base: int, step_fraction: float = 0.2) -> list[int]:
    """How many frames before the onset sham windows begin: from one span on, as long as a baseline of n_base frames is left."""
    return list(range(span, first_onset - n_base + 1, max(1, round(step_fraction * span))))


def sham_responses(traces: DataFrame, offsets: list[int], span: int, baseline_frames: int, frame: str = "frame", value: str = "v") -> DataFrame:
    """(roi, odor, place, offset, z): the mean over an odor's trials of the pooled z of windows that begin `offset` frames before the
    onset, made as a real response's is. One pass over traces (roi, trial, odor, frame, v, on) for all offsets."""
    t, on, v = F.col(frame), F.col("on"), finite(value)
    each = []
    for i, shift in enumerate(offsets):
        at = on - shift
        pre = F.when(t < at, v)
        each.append(F.struct(F.lit(i).alias("place"), F.lit(shift).alias("offset"), F.avg(F.when((t >= at) & (t < at + span), v)).alias("resp"), F.avg(F.when((t < at) & (t >= at - baseline_frames), v)).alias("base"), F.var_pop(pre).alias("var"), F.count(pre).alias("n")))
    long = traces.groupBy("roi", "trial", "odor").agg(F.array(*each).alias("_w")).select("roi", "trial", "odor", F.explode("_w").alias("_w")).select("roi", "trial", "odor", "_w.*")
    w = Window.partitionBy("roi", "place")
    sd = F.sqrt(F.sum(F.col("var") * F.col("n")).over(w) / F.sum("n").over(w))
    return long.withColumn("z", safe_ratio(F.col("resp") - F.col("base"), sd, 1e-9)).groupBy("roi", "odor", "place", "offset").agg(F.avg("z").alias("z"))


def sham_null(sham: DataFrame, target: float = 0.01) -> DataFrame:
    """One row: thresholds at the target share of each tail of the sham responses at every other offset (the fitted ones), and the share
    that passes them at the offsets between (held out): whether the calibration holds."""
    fitted, held = F.when(F.col("place") % 2 == 0, F.col("z")), F.when(F.col("place") % 2 == 1, F.col("z"))
    cut = sham.agg(F.percentile(fitted, 1 - target).alias("z_excited"), F.percentile(fitted, target).alias("z_suppressed"), F.count(fitted).alias("n_null"), F.countDistinct("place").alias("n_offsets"))
    held_out = sham.select(held.alias("h")).where("h is not null").join(F.broadcast(cut))
    rate = held_out.agg(F.avg((F.col("h") >= F.col("z_excited")).cast("double")).alias("achieved_excited"), F.avg((F.col("h") <= F.col("z_suppressed")).cast("double")).alias("achieved_suppressed"))
    return cut.join(F.broadcast(rate)).withColumns({"target": F.lit(target), "available": F.col("n_offsets") >= 2})


def sham_null_by_roi(sham: DataFrame, target: float = 0.01) -> DataFrame:
    """(roi, z_excited, z_suppressed, n, reliable): thresholds of each roi from its fitted offsets; reliable if five samples lie beyond
    the target."""
    z = sham.where("place % 2 = 0")
    return z.groupBy("roi").agg(F.percentile("z", 1 - target).alias("z_excited"), F.percentile("z", target).alias("z_suppressed"), F.count("z").alias("n")).withColumn("reliable", F.col("n") * target >= 5)


def sham_windows(traces: DataFrame, keys: list[str], frame: str, value: str, on: str, span: int, step: int) -> DataFrame:
    """(keys, offset, sham): mean over [offset, offset + span) less the mean of the span before, for windows that slide by `step`
    before the onset. Each frame goes to the windows that hold it, without a join."""
    t = F.col(frame)
    first = F.greatest(F.lit(0), F.ceil((t - span + 1 - span) / step).cast("int"))
    rows = traces.where(t < F.col(on)).withColumn("_k", F.explode(F.sequence(first, F.floor(t / step).cast("int"))))
    at = F.col("_k") * step + span
    inside, before = (t >= at) & (t < at + span), (t < at) & (t >= at - span)
    rows = rows.where((inside | before) & (at + span <= F.col(on)))
    return rows.groupBy(*keys, at.alias("offset")).agg((F.avg(F.when(inside, F.col(value))) - F.avg(F.when(before, F.col(value)))).alias("sham"))


def outliers(values: DataFrame, keys: list[str], value: str, sd: float = 5.0, rounds: int = 4) -> DataFrame:
    """values with `outlier`: those further than sd standard deviations from the mean of what is left go, again and again."""
    w = Window.partitionBy(*keys)
    df = values.withColumn("outlier", F.lit(False))
    for _ in range(rounds):
        v = F.when(~F.col("outlier"), F.col(value))
        df = df.withColumn("_m", F.avg(v).over(w)).withColumn("_s", F.stddev_pop(v).over(w))
        df = df.withColumn("outlier", F.col("outlier") | F.coalesce(F.abs(F.col(value) - F.col("_m")) > sd * F.col("_s"), F.lit(False))).drop("_m", "_s")
    return df


def bleaching(series: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, first, last, percent): the change from the first to the last value."""
    g = series.groupBy(*keys).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return g.withColumn("percent", safe_ratio(100 * (F.col("last") - F.col("first")), "first"))


def qc_blocks(calls: DataFrame, roi: str, state: str, called: str, dff: str) -> DataFrame:
    """(state or 'all', counts and percentiles): each state's rois and all of them, by grouping sets in one pass over rois."""
    per = calls.groupBy(roi, state).agg(F.bool_or(called).alias("any"), F.bool_and(called).alias("all"), F.avg(dff).alias("dff"))
    g = per.groupingSets([[F.col(state)], []], F.col(state)).agg(F.count(F.lit(1)).alias("n"), F.count_if("any").alias("n_any"), F.count_if("all").alias("n_all"), F.expr("percentile(dff, 0.5)").alias("median_dff"), F.expr("percentile(dff, 0.95)").alias("p95_dff"))
    return g.withColumn(state, F.coalesce(state, F.lit("all")))


def flags(report: DataFrame, rules: dict) -> DataFrame:
    """report with `flags`: the messages of the rules (message: condition) that hold."""
    return report.withColumn("flags", F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in rules.items()]), lambda x: x.isNotNull()))
