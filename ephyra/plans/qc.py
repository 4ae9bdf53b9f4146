"""Response QC of a session: calibrated or per-trial calls, blocks of all trials and of each state, and plain flags.

Traces are (roi, trial, odor, state, frame, v) with the frames `on` and `off`; areas are (roi, area)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators import response
from . import reports

#: Thresholds where the null can't be made, windows in seconds, and standard deviations of a dead trial's baseline.
Z_EXCITED, Z_SUPPRESSED, BASELINE_S, SHAM_S, SHAM_BASE_S, OUTLIER_SD = 1.5, -0.5, 1.0, 2.0, 2.0, 5.0
TRIAL = ["trial", "odor", "state"]


def baselines(traces: DataFrame, baseline_frames: int, sd: float = OUTLIER_SD) -> DataFrame:
    """(trial, f0, outlier): the mean of the last frames before the onset over all rois, and whether it is implausible. One row a trial."""
    t, on = F.col("frame"), F.col("on")
    f0 = traces.where((t < on) & (t >= on - baseline_frames)).groupBy("trial").agg(F.avg("v").alias("f0"))
    return response.outliers(f0.withColumn("_session", F.lit(0)), ["_session"], "f0", sd).drop("_session")


def cells(responses: DataFrame) -> DataFrame:
    """(block, roi, odor, dff, z): means over trials of all of them ('pooled') and of each state that has as many trials as there are
    odors."""
    n = responses.select("odor").distinct().count()
    trials = responses.groupBy("state").agg(F.countDistinct("trial").alias("n")).where(F.col("n") >= n).select("state")
    blocks = responses.withColumn("block", F.lit("pooled")).unionByName(responses.join(F.broadcast(trials), "state", "left_semi").withColumn("block", F.col("state").cast("string")))
    return blocks.groupBy("block", "roi", "odor").agg(F.avg("dff").alias("dff"), F.avg("z").alias("z"))


def called(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """cells with excited, suppressed and responsive, by one row of thresholds or by one for each roi."""
    cut = thresholds.select(*(["roi"] if "roi" in thresholds.columns else []), F.col("z_excited").alias("_up"), F.col("z_suppressed").alias("_down"))
    got = cells.join(cut, "roi", "left") if "roi" in thresholds.columns else cells.join(F.broadcast(cut))
    yes = lambda c: F.coalesce(c, F.lit(False))
    got = got.withColumns({"excited": yes(F.col("z") >= F.col("_up")), "suppressed": yes(F.col("z") <= F.col("_down"))}).drop("_up", "_down")
    return got.withColumn("responsive", F.col("excited") | F.col("suppressed"))


def odor_block(calls: DataFrame) -> DataFrame:
    """(block, odor, shares of rois, population sparseness)."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    got = calls.groupBy("block", "odor").agg(share("responsive").alias("responsive"), share("excited").alias("excited"), share("suppressed").alias("suppressed"))
    return got.join(response.treves_rolls(calls, ["block", "odor"], "dff").select("block", "odor", "sparseness"), ["block", "odor"])


def roi_block(calls: DataFrame) -> DataFrame:
    """(block, roi, number of odors that drive it, whether any, all, or all suppress it, lifetime sparseness)."""
    got = calls.groupBy("block", "roi").agg(
        F.count_if("responsive").alias("n_odors"), F.bool_or("responsive").alias("any"), F.bool_and("responsive").alias("all"),
        F.bool_or("excited").alias("excited"), F.bool_or("suppressed").alias("suppressed"), F.bool_and("suppressed").alias("suppressed_by_all"),
    )
    return got.join(response.treves_rolls(calls, ["block", "roi"], "dff").select("block", "roi", "sparseness"), ["block", "roi"])


def block_rows(calls: DataFrame) -> DataFrame:
    """One row for each block: counts of rois, medians and percentiles."""
    rois = roi_block(calls).groupBy("block").agg(
        F.count(F.lit(1)).alias("n_rois"), F.count_if("any").alias("n_any"), F.count_if("all").alias("n_all"), F.count_if("excited").alias("n_excited"), F.count_if("suppressed").alias("n_suppressed"),
        F.count_if("suppressed_by_all").alias("n_suppressed_by_all"), F.median("n_odors").alias("median_odors"),
        *[F.percentile("sparseness", q).alias(f"lifetime_{n}") for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
    )
    odors = odor_block(calls).groupBy("block").agg(F.median("sparseness").alias("population_median"), F.max("responsive").alias("most_responsive"))
    dff = calls.groupBy("block").agg(*[F.percentile("dff", q).alias(n) for n, q in (("dff_p05", 0.05), ("dff_median", 0.5), ("dff_p95", 0.95))])
    return rois.join(odors, "block").join(dff, "block")


def drift(traces: DataFrame) -> DataFrame:
    """One row: percent by which the mean over rois and trials falls in the frames before the onset, and by which the frames before the
    onset move from the first trial to the last."""
    pre = traces.where(F.col("frame") < F.col("on"))
    within = response.bleaching(pre.groupBy("frame").agg(F.avg("v").alias("m")).withColumn("_", F.lit(0)), ["_"], "frame", "m").select(F.col("percent").alias("within_trial_pct"))
    across = response.bleaching(pre.groupBy("trial").agg(F.avg("v").alias("m")).withColumn("_", F.lit(0)), ["_"], "trial", "m").select(F.col("percent").alias("across_session_pct"))
    return within.join(F.broadcast(across))


def thresholds(traces: DataFrame, rate: float, target: float = 0.01, baseline_s: float = BASELINE_S, per_roi: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(the null's row with the thresholds' source, thresholds of each roi or None). Where no two sham windows fit before the first onset,
    the fixed thresholds are used and the row says so."""
    span, base = max(1, round(SHAM_S * rate)), max(1, round(SHAM_BASE_S * rate))
    first = traces.agg(F.min("on")).first()[0]
    offsets = response.sham_offsets(int(first), span, base) if first is not None else []
    if len(offsets) < 2:
        row = [(False, "fixed (null unavailable)", Z_EXCITED, Z_SUPPRESSED, target, 0, len(offsets), None, None, False)]
        return traces.sparkSession.createDataFrame(row, "available boolean, source string, z_excited double, z_suppressed double, target double, n_null long, n_offsets long, achieved_excited double, achieved_suppressed double, per_roi boolean"), None
    sham = response.sham_responses(traces, offsets, span, max(1, round(baseline_s * rate)))
    null, rois = response.sham_null(sham, target), None
    if per_roi:
        rois = response.sham_null_by_roi(sham, target)
        rois = rois if rois.agg(F.bool_and("reliable")).first()[0] else None
    source = "calibrated" if not per_roi else "calibrated per roi" if rois is not None else "calibrated pooled (per roi unreliable)"
    return null.withColumns({"source": F.lit(source), "per_roi": F.lit(rois is not None)}), rois


def response_qc(traces: DataFrame, areas: DataFrame, rate: float, *, baseline_s: float = BASELINE_S, target: float = 0.01, per_roi: bool = False, fixed: tuple[float, float] | None = None, outlier_sd: float = OUTLIER_SD) -> tuple[DataFrame, DataFrame]:
    """(one row for each block, one row of the report with its flags). Trials with an implausible baseline are left out before
    anything is summed up; thresholds come from the session's own sham windows, unless fixed ones are given."""
    n = max(1, round(baseline_s * rate))
    trials = baselines(traces, n, outlier_sd)
    good = trials.where("not outlier").select("trial")
    resp = response.trial_responses(traces, ["roi"], "trial", "frame", "v", "on", "off", True, n, ["odor", "state"]).join(F.broadcast(good), "trial", "left_semi")
    null, rois = thresholds(traces, rate, target, baseline_s, per_roi)
    if fixed is not None:
        null, rois = null.withColumns({"z_excited": F.lit(fixed[0]), "z_suppressed": F.lit(fixed[1]), "source": F.lit("fixed")}), None
    blocks = block_rows(called(cells(resp), null if rois is None else rois))
    size = areas.agg(F.min("area").alias("least_area"), F.max("area").alias("largest_area"), F.count_if(F.col("area") < 10).alias("n_tiny"))
    dead = trials.agg(F.count_if("outlier").alias("n_dead"), F.avg("f0").alias("mean_f0"), F.stddev_pop("f0").alias("sd_f0"))
    report = blocks.where("block = 'pooled'").drop("block")
    for one in (null, size, dead, drift(traces)):
        report = report.join(F.broadcast(one))
    return blocks, response.flags(report, calibrated_rules(per_roi))


def calibrated_rules(per_roi: bool = False) -> dict:
    """Message: condition on the report's row."""
    c = F.col
    return {
        "one odor drives more than 80 % of rois: check motion, focus and the baseline's window": c("most_responsive") > 0.8,
        "fewer than a tenth of rois respond to any odor: check alignment and mask": c("n_any") < 0.1 * c("n_rois"),
        "most suppressed rois are suppressed by every odor alike: likely decay within trials; the suppressed count is an upper bound": (c("n_suppressed") > 0) & (c("n_suppressed_by_all") > 0.5 * c("n_suppressed")),
        "median lifetime sparseness is below 0.1: rois respond to all odors alike": c("lifetime_median") < 0.1,
        "rois of fewer than 10 pixels: curate and extract again": c("n_tiny") > 0,
        "too few sham windows for thresholds of each roi: the pooled ones were used": F.lit(per_roi) & ~c("per_roi"),
        "no null could be made: fixed thresholds, whose false positive rate is unknown": ~c("available"),
        "held-out sham windows pass the excited threshold more than three times as often as planned: an upper bound": c("available") & (c("achieved_excited") > 3 * c("target")),
        "held-out sham windows pass the suppressed threshold more than three times as often as planned: an upper bound": c("available") & (c("achieved_suppressed") > 3 * c("target")),
        "no odor drives more rois than the thresholds allow by construction: hardly any response": c("available") & (c("most_responsive") < 4 * c("target")),
        "fluorescence falls by more than 5 % before the odor within a trial": c("within_trial_pct") < -5,
        "baselines fall by more than 25 % from the first trial to the last": c("across_session_pct") < -25,
    }


def trial_report(traces: DataFrame, areas: DataFrame, rate: float, width: int, *, manipulation: str | None = None, deglobal: str | None = "pc1", target_fdr: float = 0.05, outlier_sd: float = OUTLIER_SD) -> tuple[DataFrame, DataFrame]:
    """(block, odor, means and standard errors of the shares called in a trial; one row of the report with its flags), by calls of each
    trial against the controls of the session. Dead trials are left out, and named by their number in the report."""
    n = max(1, round(BASELINE_S * rate))
    trials = baselines(traces, n, outlier_sd)
    used = traces.join(F.broadcast(trials.where("not outlier").select("trial")), "trial", "left_semi")
    calls = reports.trial_calls(used, width, deglobal=deglobal, target_fdr=target_fdr, keys=("roi", *TRIAL))
    blocks = calls.withColumn("block", F.lit("pooled")).unionByName(calls.withColumn("block", F.col("state").cast("string")))
    by = lambda name: response.sparsity(blocks, ["block", "odor"], "trial", name).select("block", "odor", "n_trials", F.col("mean").alias(name), F.col("sem").alias(f"{name}_sem"))
    odors = by("excited").join(by("suppressed").drop("n_trials"), ["block", "odor"])
    places = calls.withColumn("place", F.dense_rank().over(Window.partitionBy("roi").orderBy("trial")))
    half = response.split_half(places, ["roi"], "place", "control").select(F.col("false_rate").alias("control_false_rate"), F.col("kurtosis").alias("control_kurtosis"))
    total = calls.agg(F.countDistinct("roi").alias("n_rois"), F.countDistinct("trial").alias("n_trials"), F.max(F.when(F.col("excited"), 1)).alias("_e"), F.min(F.when(F.col("suppressed"), F.col("z"))).alias("least_suppressed"))
    dead = trials.agg(F.array_sort(F.collect_list(F.when(F.col("outlier"), F.col("trial")))).alias("dead_trials"))
    most = odors.where("block = 'pooled'").agg(F.max("excited").alias("most_excited"), F.median("excited").alias("excited_median"), F.median("suppressed").alias("suppressed_median"))
    report = total.drop("_e")
    for one in (half, dead, most, areas.agg(F.count_if(F.col("area") < 10).alias("n_tiny")), drift(traces)):
        report = report.join(F.broadcast(one))
    return odors, response.flags(report.withColumn("manipulation", F.lit(manipulation).cast("string")), {
        "approved trials with an implausible baseline were left out: look at them again": F.size("dead_trials") > 0,
        "one odor drives more than 80 % of rois: check motion and focus": F.col("most_excited") > 0.8,
        "no suppression threshold reaches the target: suppressed counts are undetermined, not zero": F.col("least_suppressed").isNull(),
        "no manipulation label: blocks can't be told from a control": F.col("manipulation").isNull(),
        "the split-half control passes more than 2 %: both counts are upper bounds": F.col("control_false_rate") > 0.02,
        "rois of fewer than 10 pixels": F.col("n_tiny") > 0,
        "fluorescence falls by more than 5 % before the odor within a trial, on raw traces": F.col("within_trial_pct") < -5,
        "baselines move by more than 25 % from the first trial to the last": F.abs("across_session_pct") > 25,
    })
