"""Whole workflows composed of the operators: calls, responder and QC reports, group movies, aligned signals, finished rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..functions import images
from ..functions.columns import finite, safe_ratio
from ..functions.special import t_pvalue
from ..operators import baseline, clock, grouping, pixels, response, signals
from ..sources import store
from ..sources.shared import written

# -- calls and responders: traces are (roi, trial, odor, state, frame, v) with on and off


def trial_windows(traces: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, d, c): response less the window before the onset, and that window less the one before it, all of `width` frames."""
    t, on, v = F.col("frame"), F.col("on"), finite("v")
    mean = lambda lo, hi: F.avg(F.when((t >= on + lo) & (t < on + hi), v))
    return traces.groupBy(*keys).agg(mean(0, width).alias("_r"), mean(-width, 0).alias("_p2"), mean(-2 * width, -width).alias("_p1")).select(*keys, (F.col("_r") - F.col("_p2")).alias("d"), (F.col("_p2") - F.col("_p1")).alias("c"))


def trial_calls(traces: DataFrame, width: int, *, deglobal: str | None = None, robust: bool = True, target_fdr: float = 0.05, keys=("roi", "odor", "trial")) -> DataFrame:
    """(keys, z, control, excited, suppressed): both windows' differences on the scale of the control's of each roi, less the common
    component if asked ('median' or 'pc1'), called by empirical thresholds from the controls of all rois."""
    keys = list(keys)
    w = trial_windows(traces, keys, width)
    cs = response.centre_scale(w.where("c is not null"), ["roi"], "c", robust)
    z = w.join(cs, "roi", "left").select(*keys, safe_ratio(F.col("d") - F.col("centre"), "scale").alias("z"), safe_ratio(F.col("c") - F.col("centre"), "scale").alias("control"))
    if deglobal == "median":
        z = response.without_median(z, "roi", "odor", "trial", "z").drop("z").withColumnRenamed("clean", "z").select(*keys, "z", "control")
    elif deglobal == "pc1":
        z = without_first_component(z, "z").select(*keys, "z", "control")
    both = z.select(F.col("z").alias("x"), F.lit(False).alias("null_")).unionByName(z.select(F.col("control").alias("x"), F.lit(True).alias("null_")))
    at = response.empirical_threshold(both, [], "x", "null_", target_fdr)
    got = z.crossJoin(F.broadcast(at.withColumnsRenamed({"excited": "_e", "suppressed": "_s"})))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return got.select(*keys, "z", "control", yes(F.col("z") >= F.col("_e")).alias("excited"), yes(F.col("z") <= F.col("_s")).alias("suppressed"))


#: Up to so many trials, or else rois, their products are summed whole (a square of 8-byte sums on the driver); more of both go by power iteration.
GRAM_TRIALS = 1024


def _products(cells: DataFrame, n: int) -> np.ndarray:
    """The n x n sums of products of rows (i: places below n, x: values). Each task sums those of its rows; repeated places of a row add up."""

    def products(batches):
        g, any_rows = np.zeros((n, n)), False
        for batch in batches:
            any_rows = any_rows or batch.num_rows > 0
            for lo in range(0, batch.num_rows, 4096):
                i, x = (batch.column(k).slice(lo, 4096) for k in (0, 1))
                row = np.repeat(np.arange(len(i)), pc.list_value_length(i).to_numpy())
                m = np.bincount(row * n + i.flatten().to_numpy(), weights=x.flatten().to_numpy(), minlength=len(i) * n).reshape(-1, n)
                g += m.T @ m
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], names=["i", "g"])

    parts = cells.select("i", "x").mapInArrow(products, "i int, g array<double>")
    sums = parts.select("i", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    g = np.zeros((n, n))
    if len(sums):
        g[sums["i"], sums["j"]] = sums["g"]
    return g


def first_trial_component(r: DataFrame, tolerance: float = 1e-9, most: int = 200, gram_trials: int = GRAM_TRIALS) -> DataFrame:
    """(odor, trial, _w): the first right singular vector of the written table r (roi, odor, trial, _res).

    A session has few trials, and a long one few rois: there each task sums the products of the rows of one by the other, the sums are
    added in a shuffle of at most a square of the fewer for each task, and the vector is exact after one pass (from that of the
    rois, the trials' follows by one sum). With more than `gram_trials` of both the cluster iterates until the vector moves by no more
    than the tolerance: each step is two sums over the long table, and only weights move, by shuffles, never through the driver."""
    spark = r.sparkSession
    small = lambda *by: r.select(*by).distinct().limit(gram_trials + 1).collect()
    names = small("odor", "trial")
    if len(names) <= gram_trials:
        schema = r.select("odor", "trial").schema
        # nulls are trials of no one: they join nothing below either
        names = sorted((tuple(x) for x in names if None not in tuple(x)), key=str)
        place = spark.createDataFrame([(*x, i) for i, x in enumerate(names)], T.StructType([*schema.fields, T.StructField("_i", T.IntegerType())]))
        # of a trial's repeated rows, each counts
        cells = r.where("roi is not null").join(F.broadcast(place), ["odor", "trial"]).groupBy("roi").agg(F.collect_list("_i").alias("i"), F.collect_list("_res").alias("x"))
        w = np.linalg.eigh(_products(cells, len(names)))[1][:, -1] if names else np.zeros(0)
        return spark.createDataFrame([(*x, float(v)) for x, v in zip(names, w)], T.StructType([*schema.fields, T.StructField("_w", T.DoubleType())]))
    rois = small("roi")
    if len(rois) <= gram_trials:
        rois = sorted((x[0] for x in rois if x[0] is not None), key=str)
        own = T.StructType([*r.select("roi").schema.fields, T.StructField("_i", T.IntegerType())])
        known = r.where("odor is not null and trial is not null")
        cells = known.join(F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(rois)], own)), "roi").groupBy("odor", "trial").agg(F.collect_list("_i").alias("i"), F.collect_list("_res").alias("x"))
        values, vectors = np.linalg.eigh(_products(cells, len(rois))) if rois else (np.zeros(1), np.zeros((0, 1)))
        norm = float(np.sqrt(max(values[-1], 0.0)))
        weight = spark.createDataFrame([(x, float(v) / norm if norm else 0.0) for x, v in zip(rois, vectors[:, -1])], T.StructType([own.fields[0], T.StructField("_u", T.DoubleType())]))
        return known.join(F.broadcast(weight), "roi").groupBy("odor", "trial").agg(F.sum(F.col("_res") * F.col("_u")).alias("_w"))
    # a start that no symmetry of the data cancels
    v = written(r.groupBy("odor", "trial").agg((F.avg("_res") + F.pmod(F.xxhash64("odor", "trial"), F.lit(1000)) * 1e-3).alias("_w")))
    for _ in range(most):
        u = r.join(v.hint("merge"), ["odor", "trial"]).groupBy("roi").agg(F.sum(F.col("_res") * F.col("_w")).alias("_u"))
        new = written(r.join(u.hint("merge"), "roi").groupBy("odor", "trial").agg(F.sum(F.col("_res") * F.col("_u")).alias("_w")))
        norm = new.agg(F.sqrt(F.sum(F.col("_w") * F.col("_w")))).first()[0] or 0.0
        new = new.withColumn("_w", F.col("_w") / norm if norm else F.lit(0.0))
        moved = new.join(v.withColumnRenamed("_w", "_old").hint("merge"), ["odor", "trial"]).agg(F.sqrt(F.sum(F.pow(F.col("_w") - F.col("_old"), 2)))).first()[0]
        v = new
        if moved is None or moved <= tolerance:
            break
    return v


def without_first_component(z: DataFrame, value: str, gram_trials: int = GRAM_TRIALS) -> DataFrame:
    """z (roi, odor, trial, value) less what the first right singular vector of the rois' residuals (from their odor's mean) explains."""
    r = written(z.withColumn("_res", F.coalesce(F.col(value) - F.avg(value).over(Window.partitionBy("roi", "odor")), F.lit(0.0))))
    v = first_trial_component(r, gram_trials=gram_trials)
    centred = v.withColumn("_g", F.col("_w") - F.avg("_w").over(Window.partitionBy("odor"))).drop("_w")
    both = r.join(centred, ["odor", "trial"])
    slope = both.groupBy("roi").agg(safe_ratio(F.sum(F.col("_res") * F.col("_g")), F.sum(F.col("_g") * F.col("_g"))).alias("_b"))
    return both.join(slope, "roi").withColumn(value, F.col(value) - F.coalesce("_b", F.lit(0.0)) * F.col("_g")).drop("_res", "_g", "_b")


#: An odor with fewer trials is thin, and more than this share of excited rois is no answer to an odor.
THIN_TRIALS, UNIFORM = 10, 0.9


def responder_test(deltas: DataFrame, keys: list[str], target_fdr: float = 0.05, min_trials: int = 5) -> DataFrame:
    """(keys, n, mean, t, p, rejected, sign) of one-sample tests with the step-up over all of them."""
    t = response.t_statistics(deltas, keys, "delta", min_trials).withColumn("p", t_pvalue("t", "n"))
    return response.bh_reject(t, "p", target_fdr).withColumn("sign", F.when(~F.col("rejected"), "none").when(F.col("mean") > 0, "excited").otherwise("suppressed"))


def control_deltas(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas of a pseudo-odor: the second half of the frames before the onset against the first."""
    t = traces.withColumn("off", F.col("on")).withColumn("on", F.floor(F.col("on") / 2).cast("int"))
    return response.trial_deltas(t, keys, "frame", "v", "on", "off")


def responders(traces: DataFrame, *, target_fdr: float = 0.05, min_trials: int = 5, outlier_sd: float = 5.0) -> DataFrame:
    """(block, roi, odor, test columns): all trials ('all'), each state, and the control ('control'), trials whose mean baseline is an
    outlier left out."""
    keys = ["roi", "odor", "state", "trial"]
    d = response.trial_deltas(traces, keys, "frame", "v", "on", "off")
    f0 = d.groupBy("trial").agg(F.avg("base").alias("f0")).withColumn("_k", F.lit(0))
    good = response.outliers(f0, ["_k"], "f0", outlier_sd).where("not outlier").select("trial")
    d, c = d.join(good, "trial"), control_deltas(traces.join(good, "trial"), keys)
    out = responder_test(d, ["roi", "odor"], target_fdr, min_trials).withColumn("block", F.lit("all"))
    for name, part in (("pre", d.where("state = 'pre'")), ("post", d.where("state = 'post'")), ("control", c)):
        out = out.unionByName(responder_test(part, ["roi", "odor"], target_fdr, min_trials).withColumn("block", F.lit(name)))
    return out


def responder_counts(tests: DataFrame) -> DataFrame:
    """(block, n_tests, n_excited, n_suppressed, n_rois, rois_excited, rois_suppressed, fewest_trials, thin_odors) of what `responders`
    gives; thin odors have tests of fewer than THIN_TRIALS trials. Two aggregations, by roi and by odor; tests may be any number."""
    hit = lambda name: F.col("rejected") & (F.col("sign") == name)
    rois = tests.groupBy("block", "roi").agg(F.count_if(F.col("p").isNotNull()).alias("_n"), F.count_if(hit("excited")).alias("_e"), F.count_if(hit("suppressed")).alias("_s"))
    by_roi = rois.groupBy("block").agg(
        F.sum("_n").alias("n_tests"), F.sum("_e").alias("n_excited"), F.sum("_s").alias("n_suppressed"), F.count("roi").alias("n_rois"), F.count_if(F.col("_e") > 0).alias("rois_excited"), F.count_if(F.col("_s") > 0).alias("rois_suppressed")
    )
    odors = tests.groupBy("block", "odor").agg(F.max("n").alias("_n")).groupBy("block").agg(F.min("_n").alias("fewest_trials"), F.count_if(F.col("_n") < THIN_TRIALS).alias("thin_odors"))
    return by_roi.join(odors, "block")


def responder_flags(tests: DataFrame, detrended: bool) -> DataFrame:
    """responder_counts with `flags`: on the row of all trials, what would make its counts unreadable; other rows have none.

    A control that finds anything at all is flagged, since no odor was there. No tests give no rows; a roi whose tests are all
    NULL counts as a roi, not as a test. Odors with too few trials for any test have no rows in tests and aren't counted as thin.
    """
    from ..sources.shared import saved

    counts = saved(responder_counts(tests))
    control = counts.where("block = 'control'").agg(F.coalesce(F.sum(F.col("n_excited") + F.col("n_suppressed")), F.lit(0)).alias("control_found"))
    own = F.col("block") == "all"
    return response.flags(counts.join(F.broadcast(control), F.lit(True), "left"), {
        "traces are not detrended": own & F.lit(not detrended), "responses in the control": own & (F.col("control_found") > 0), f"odors with fewer than {THIN_TRIALS} trials": own & (F.col("thin_odors") > 0),
        "nothing responds": own & (F.col("n_tests") > 0) & (F.col("n_excited") + F.col("n_suppressed") == 0), "nearly every roi is excited": own & (F.col("rois_excited") > UNIFORM * F.col("n_rois")),
    })


def by_odor(deltas: DataFrame, value: str, odors: list) -> DataFrame:
    """(roi, one column for each odor) of means."""
    return deltas.groupBy("roi").pivot("odor", odors).agg(F.avg(value))


def trial_counts(calls: DataFrame, high: float = 2.0, low: float = -2.0) -> DataFrame:
    """(trial, odor, n, n_excited, n_suppressed, chance_excited, chance_suppressed) at fixed thresholds."""
    share = lambda c: F.avg(c.cast("double"))
    return calls.groupBy("trial", "odor").agg(F.count("z").alias("n"), F.count_if(F.col("z") >= high).alias("n_excited"), F.count_if(F.col("z") <= low).alias("n_suppressed"), share(F.col("control") >= high).alias("chance_excited"), share(F.col("control") <= low).alias("chance_suppressed"))


def qc_report(traces: DataFrame, width: int, *, deglobal: str | None = "pc1", target_fdr: float = 0.05) -> DataFrame:
    """One row: rois, trials, shares called against chance, split-half control, mean sparseness, and flags."""
    from ..sources.shared import saved

    calls = saved(trial_calls(traces, width, deglobal=deglobal, target_fdr=target_fdr))
    sp = response.sparsity(calls, ["odor"], "trial", "excited").agg(F.avg("mean").alias("mean_sparsity"))
    life = response.treves_rolls(calls.groupBy("roi", "odor").agg(F.avg("z").alias("r")), ["roi"], "r").agg(F.avg("sparseness").alias("mean_lifetime"))
    places = calls.withColumn("place", F.col("trial").cast("long"))
    half = response.split_half(places, ["roi"], "place", "control").select(F.col("false_rate").alias("control_false_rate"), F.col("kurtosis").alias("control_kurtosis"))
    one = calls.agg(F.countDistinct("roi").alias("n_rois"), F.countDistinct("odor", "trial").alias("n_trials"), F.avg(F.col("excited").cast("double")).alias("share_excited"), F.avg(F.col("suppressed").cast("double")).alias("share_suppressed"))
    row = one.crossJoin(sp).crossJoin(life).crossJoin(half)
    return response.flags(row, {
        "fewer than 10 trials": F.col("n_trials") < 10, "control passes too often": F.coalesce(F.col("control_false_rate") > 0.1, F.lit(False)),
        "heavy tails in the control": F.coalesce(F.col("control_kurtosis") > 3, F.lit(False)), "nothing responds": F.col("share_excited") + F.col("share_suppressed") == 0,
    })


# -- movies


def group_z_movies(frames: DataFrame, trials: DataFrame, n_pre: int, n_span: int, keys: list[str], pooled: str = "mean") -> tuple[DataFrame, DataFrame]:
    """(movies (keys, t, y, x, z), skipped trials): each trial's window [on - n_pre, on - n_pre + n_span) on its own baseline, averaged
    over the trials of a group, or pooled as sum over root. A trial whose movie doesn't hold its window is skipped."""
    span = frames.groupBy("trial").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    t = trials.join(span, "trial", "left")
    begin, end = clock.window_bounds("on", n_pre, n_span)
    fits = F.coalesce((begin >= F.col("_lo")) & (end - 1 <= F.col("_hi")), F.lit(False))
    skipped = t.where(~fits).select("trial")
    cut = frames.join(t.where(fits).select("trial", "on", *keys), "trial").where((F.col("t") >= begin) & (F.col("t") < end))
    z = pixels.baseline_z(cut, ["trial", "y", "x"], "t", "v", "on").withColumn("t", F.col("t") - F.col("on") + n_pre)
    by = [*keys, "t", "y", "x"]
    return (pixels.group_mean(z, by, "z") if pooled == "mean" else pixels.stouffer(z, by, "z").withColumnRenamed("pooled", "z")), skipped


def correlation_maps(movies: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.neighbour_correlation(movies, keys, ["t"], "z")


def summary_session(frames: DataFrame, trials: DataFrame) -> DataFrame:
    """(y, x, mean, max, corr, activity) over the movies of a session."""
    base = pixels.summary_images(frames, [], "v")
    corr = pixels.neighbour_correlation(frames, ["trial"], ["t"], "v").groupBy("y", "x").agg(F.avg("corr").alias("corr"))
    per = pixels.odor_response(frames.join(trials.select("trial", "odor", "on", "off"), "trial"), ["trial", "odor", "y", "x"], "t", "v", "on", "off")
    act = pixels.signed_activity(per.groupBy("odor", "y", "x").agg(F.avg("response").alias("response")), ["y", "x"], "odor", "response")
    return base.join(corr, ["y", "x"], "left").join(act, ["y", "x"], "left")


def blurred(pixels_: DataFrame, keys: list[str], sigma: float, value: str = "v") -> DataFrame:
    """Images (keys, y, x, value) blurred; an image is one task's work."""
    schema = ", ".join([*[f"{k} {pixels_.schema[k].dataType.simpleString()}" for k in keys], f"y int, x int, {value} double"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        im = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
        im[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf[value].to_numpy(float)
        out = images.gaussian(im, sigma)
        y, x = np.indices(out.shape)
        return pd.DataFrame({**{k: [v] * out.size for k, v in zip(keys, key)}, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), value: out.ravel()})

    return pixels_.groupBy(*keys).applyInPandas(run, schema)


def reference_images(frames: DataFrame, n_frames: int = 120, structural: float = 0.8, correlation: float = 0.7) -> DataFrame:
    """(trial, y, x, structure, corr) of the central frames of each movie."""
    w = Window.partitionBy("trial")
    mid = frames.withColumns({"_n": F.max("t").over(w) + 1}).withColumn("_s", F.greatest(F.lit(0), F.floor((F.col("_n") - n_frames) / 2)))
    part = mid.where((F.col("t") >= F.col("_s")) & (F.col("t") < F.col("_s") + n_frames))
    mean = blurred(part.groupBy("trial", "y", "x").agg(F.avg("v").alias("structure")), ["trial"], structural, "structure")
    corr = blurred(pixels.neighbour_correlation(part, ["trial"], ["t"], "v"), ["trial"], correlation, "corr")
    return mean.join(corr, ["trial", "y", "x"], "left")


# -- aligned signals


def respiration_by_trial(samples: DataFrame, keys: list[str], rate: float, frames: DataFrame, most: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(per frame, per trial): the breath rate laid on frames (keys, trial, frame, sample), and each trial's masked share."""
    per = signals.instantaneous_rate(samples, keys, "sample", "v", rate, frames)
    return per, signals.trial_frames(per, keys, "trial", most)


def pupil_by_trial(measures: DataFrame, keys: list[str], camera_at: str, grid: DataFrame, period: int) -> tuple[DataFrame, DataFrame]:
    """(per frame, per trial): measured frames (keys, at, diameter, blink, clipped) laid on imaging frames (keys, trial, frame, at) by
    the nearest in time; further than two camera periods is an error. Blinks and clipped pupils have no diameter."""
    near = clock.asof(grid, measures.withColumnRenamed(camera_at, "at"), keys, "at", ["diameter", "blink", "clipped"], "nearest")
    far = F.abs(F.col("at") - F.col("at_right")) > 2 * period
    near = near.withColumn("diameter", F.when(far, F.raise_error(F.lit("a frame is further than two camera periods from any")).cast("double")).when(F.col("blink") | F.col("clipped"), F.lit(None)).otherwise(F.col("diameter")))
    share = lambda c: F.avg(F.col(c).cast("double"))
    return near, near.groupBy(*keys, "trial").agg(share("blink").alias("blink_fraction"), share("clipped").alias("clipped_fraction"), F.avg(F.col("diameter").isNull().cast("double")).alias("masked_fraction"), F.avg("diameter").alias("mean_diameter"))


def respiration_summary(per_frame: DataFrame, keys: list[str], value: str = "rate") -> DataFrame:
    """(keys, n, mean, half): means with 1.96 standard errors (ddof 0)."""
    return per_frame.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), safe_ratio(1.96 * F.stddev_pop(value), F.sqrt(F.count(value))).alias("half"))


# -- rounds and masks


def finalize(path: str, frames: DataFrame, mask: DataFrame, trials: DataFrame, *, fast: float | None = None, slow: float | None = None, **meta) -> str:
    """Extracts the traces of a mask, takes a baseline out (with given time constants in frames), writes the round and checks it."""
    raw = pixels.roi_traces(frames, mask, ["trial", "t"], "v").withColumnsRenamed({"label": "roi", "t": "frame"})
    tables = {"masks": mask, "rois": pixels.roi_table(mask), "trials": trials}
    if fast:
        both = raw.join(trials.select("trial", "on", "off"), "trial")
        clean = baseline.detrend_exponential(both, ["roi", "trial"], "frame", "v", fast, slow, baseline.outside("frame", "on", "off", 0.0))
        tables["traces"] = raw.join(clean.select("roi", "trial", "frame", F.col("v").alias("detrended")), ["roi", "trial", "frame"])
    else:
        tables["traces"] = raw
    store.write_session(path, tables, **meta)
    return store.verify_session(mask.sparkSession, path)


def preferred(traces: DataFrame) -> DataFrame:
    """traces with v and its source: the detrended value where there is one."""
    has = "detrended" in traces.columns
    return traces.withColumn("source", F.when(F.col("detrended").isNotNull(), "detrended").otherwise("raw") if has else F.lit("raw")).withColumn("v", F.coalesce("detrended", "v") if has else F.col("v"))


def overlay(image: DataFrame, mask: DataFrame, palette: list[tuple[int, int, int]], alpha: float = 0.5, low: float = 0.01, high: float = 0.995) -> DataFrame:
    """(y, x, r, g, b): grey between two percentiles of the image (NULL as the lower), labels blended in colours that repeat."""
    cut = image.agg(F.expr(f"percentile(v, {low})").alias("_lo"), F.expr(f"percentile(v, {high})").alias("_hi"))
    m = image.crossJoin(F.broadcast(cut)).join(mask.select("y", "x", "label"), ["y", "x"], "left")
    grey = 255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(safe_ratio(F.coalesce("v", "_lo") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))))
    colours = F.array(*[F.array(*[F.lit(c) for c in rgb]) for rgb in palette])
    own = F.get(colours, ((F.col("label") - 1) % len(palette)).cast("int"))
    mix = lambda i: F.bround(F.when(F.coalesce("label", F.lit(0)) > 0, (1 - alpha) * grey + alpha * F.get(own, i)).otherwise(grey), 0).cast("int")
    return m.select("y", "x", mix(0).alias("r"), mix(1).alias("g"), mix(2).alias("b"))


def roi_groups(rois: DataFrame, groups: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """rois with their group, -1 if none; a manual one wins."""
    g = groups if manual is None else grouping.assigned(groups, manual)
    return rois.join(g, "roi", "left").withColumn("group", F.coalesce("group", F.lit(-1)))


def autogroup(traces: DataFrame, somas: DataFrame, processes: DataFrame, um_per_px: float, max_gap_um: float = 8.0, least: float = 0.4, max_lag: int = 0) -> DataFrame:
    """(kind, label, group): rois within the gap whose traces (kind, label, trial, frame, v) correlate, never two somas in one group."""
    image, members = grouping.index_image(somas, processes)
    most = max(1, int(np.floor(max_gap_um / um_per_px)))
    gaps = grouping.pairwise_gaps(image.withColumn("label", F.col("idx") + 1), most).select((F.col("a") - 1).alias("a"), (F.col("b") - 1).alias("b"), "gap")
    t = traces.join(members, ["kind", "label"]).withColumnRenamed("idx", "roi")
    c = grouping.lagged_correlations(t.select("roi", "trial", "frame", "v"), gaps.select("a", "b"), max_lag)
    links = gaps.join(c, ["a", "b"], "left").select(F.col("a").cast("long"), F.col("b").cast("long"), "corr", F.col("gap").cast("double"))
    done = grouping.constrained_groups(links, members.select(F.col("idx").cast("long").alias("roi"), (F.col("kind") == "soma").alias("soma")), least)
    return members.join(grouping.group_members(done).withColumnRenamed("roi", "idx"), "idx").select("kind", "label", "group")


