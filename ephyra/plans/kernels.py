"""Queries of the numeric and image kernels; SQL can't express these, tests hold them against their definitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import rounded
from ..functions.special import normal_pvalue, t_pvalue
from ..operators import baseline, frames, response, segment, signals
from .queries import _deltas, _traces, query, table


@query()
def t_pvalue_bh(spark, d):
    """p values of the t statistics, and which pass the step-up at 5 %."""
    t = response.t_statistics(_deltas(spark, d), ["user_id"]).withColumn("p", t_pvalue("t", "n"))
    return response.bh_reject(t, "p").select("user_id", rounded("p", 8).alias("p"), "rejected")


@query()
def normal_tails(spark, d):
    z = response.scaled(table(spark, d, "events"), ["user_id"], "value")
    return z.select("event_id", rounded(normal_pvalue("z"), 8).alias("p"))


@query()
def deglobal_pc1(spark, d):
    """Responses of trials less their first common component over rois."""
    from . import reports

    z = reports.trial_windows(_session(spark, d), ["roi", "odor", "trial"], 12).select("roi", "odor", "trial", F.col("d").alias("z"))
    return reports.without_first_component(z, "z").select("roi", "odor", "trial", rounded("z").alias("z"))


def _samples(spark, d):
    """Events laid on a clock of one sample each, as one channel for each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("sample"), "value")


@query()
def bandpass(spark, d):
    return signals.filtered(_samples(spark, d), ["user_id"], "sample", "value", 200.0).withColumn("value", rounded("value"))


@query()
def inhalation_onsets(spark, d):
    return signals.inhalations(_samples(spark, d), ["user_id"], "sample", "value", 20.0 * 12)


@query()
def band_power_quality(spark, d):
    return signals.quality_report(signals.quality(_samples(spark, d), ["user_id"], "sample", "value", 50.0), ["user_id"]).withColumn("percent", rounded("percent"))


@query("""with v as (select label, unnest(range(64)) as frame, unnest(embedding)::double as y from embeddings), m as (select label, frame, avg(y) as y from v group by all), w as (select label, frame / 8.0 as t, y - avg(y) over (partition by label) as v from m where frame < 20 or frame >= 46),
 k as (select *, ln(0.1) + (ln(10.0) - ln(0.1)) * i / 12 as lt, ln(2.0) + (ln(40.0) - ln(2.0)) * j / 8 as lr from range(13) a(i), range(9) b(j)),
 e as (select label, i, j, v, exp(-t / exp(lt)) as q, exp(-t / exp(lt + lr)) as r from w, k),
 s as (select label, i, j, covar_pop(q, q) * count(*) as qq, covar_pop(r, r) * count(*) as rr, covar_pop(q, r) * count(*) as qr, covar_pop(q, v) * count(*) as qv, covar_pop(r, v) * count(*) as rv, covar_pop(v, v) * count(*) as vv from e group by all),
 f as (select *, (qv * rr - rv * qr) / (qq * rr - qr * qr) as a, (rv * qq - qv * qr) / (qq * rr - qr * qr) as b from s)
 select label, cast(i as int) as i, cast(j as int) as j, round(greatest(vv - a * qv - b * rv, 0), 7) as sse from f""")
def baseline_grid(spark, d):
    """The squares that two exponentials leave of each label's mean trace, for every point of the first grid of time constants."""
    m = _traces(spark, d).groupBy("label", "frame").agg(F.avg("v").alias("v")).where("frame < 20 or frame >= 46")
    rows = m.select("label", (F.col("frame") / 8.0).alias("t"), (F.col("v") - F.avg("v").over(Window.partitionBy("label"))).alias("v"))
    ends = {"lo": baseline.FAST_S[0], "hi": baseline.FAST_S[1], "rlo": baseline.RATIO[0], "rhi": baseline.RATIO[1]}
    bounds = rows.select("label").distinct().select("label", *[F.lit(float(np.log(v))).alias(k) for k, v in ends.items()])
    return baseline.grid_fits(rows, ["label"], bounds, 2).select("label", "i", "j", rounded("sse", 7).alias("sse"))


@query()
def fit_baseline(spark, d):
    """One fit for each label, outside an odor from frame 20 to 30 and two seconds after it."""
    m = _traces(spark, d).groupBy("label", "frame").agg(F.avg("v").alias("v"))
    return baseline.fit_baseline(m, ["label"], "frame", "v", 8.0, odor=(20, 30), guard_s=2.0).select("label", "ok", *[rounded(c).alias(c) for c in ("tau_fast", "tau_slow", "c", "r2")])


@query()
def detrend_two_exponentials(spark, d):
    return baseline.detrend_exponential(_traces(spark, d), ["vec_id"], "frame", "v", 6.0, 40.0, (F.col("frame") < 20) | (F.col("frame") >= 40)).select("vec_id", "frame", rounded("v").alias("v"))


@query()
def fit_shape(spark, d):
    t = _traces(spark, d)
    s = baseline.fit_shape(t.withColumn("v", F.col("v") + 10), ["vec_id"], "frame", "v", (F.col("frame") < 20) | (F.col("frame") >= 40), 64)
    return s.select("frame", rounded("shape").alias("shape"))


def _images(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("odor"), (F.col("l_partkey") % 48).cast("int").alias("y"), (F.col("l_suppkey") * 7 % 48).cast("int").alias("x")).agg(F.sum("l_quantity").alias("v"))


@query()
def segment_images(spark, d):
    return segment.per_image(_images(spark, d), ["odor"], lambda im: segment.segment_image(np.nan_to_num(im), segment.SegmentParams(85.0, min_diameter_px=1.5, max_diameter_px=12, peak_distance_px=2)))


@query()
def ridge_processes(spark, d):
    return segment.per_image(_images(spark, d), ["odor"], lambda im: segment.processes(np.nan_to_num(im), np.zeros(im.shape, int)))


def _eye_frames(spark, d):
    """Embeddings as 8 x 8 grey frames, blown up to 40 x 40, dealt evenly: a frame takes far longer than its reading, and a file of few row
    groups would be few tasks."""

    def run(batches):
        for pdf in batches:
            px = [np.kron(np.clip(np.asarray(e, float).reshape(8, 8) * 60 + 128, 0, 255), np.ones((5, 5))).astype(np.uint8).tobytes() for e in pdf["embedding"]]
            yield pd.DataFrame({"label": pdf["label"], "index": pdf["vec_id"], "height": 40, "width": 40, "pixels": px})

    dealt = table(spark, d, "embeddings").select("vec_id", "label", "embedding").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    return dealt.mapInPandas(run, "label int, index long, height int, width int, pixels binary")


@query()
def pupil_frames(spark, d):
    m = frames.classify(frames.pupils(_eye_frames(spark, d), ["label"], frames.PupilConfig()), ["label"], "index")
    return m.select("label", "index", rounded("diameter", 3).alias("diameter"), "blink", "clipped")


# -- workflows


ROIS = 50


def _session(spark, d):
    """Embeddings as traces: 50 rois, trials of 64 frames, labels as odors, the odor from frame 32 to 48."""
    t = table(spark, d, "embeddings").select((F.col("vec_id") % ROIS).alias("roi"), F.floor(F.col("vec_id") / ROIS).alias("trial"), (F.floor(F.col("vec_id") / ROIS) % 5).cast("int").alias("odor"), F.posexplode("embedding").alias("frame", "v"))
    return t.withColumns({"v": F.col("v").cast("double"), "on": F.lit(32), "off": F.lit(48), "state": F.when(F.col("trial") % 2 == 0, "pre").otherwise("post")})


CALLS = """with f as (select vec_id % 50 as roi, vec_id // 50 as trial, (vec_id // 50) % 5 as odor, i - 1 as frame, embedding[i]::double as v from embeddings, range(1, 65) r(i)),
 w as (select roi, odor, trial, avg(v) filter (where frame >= 32 and frame < 44) as r, avg(v) filter (where frame >= 20 and frame < 32) as p2, avg(v) filter (where frame >= 8 and frame < 20) as p1 from f group by all),
 m as (select roi, median(p2 - p1) as c from w group by roi), s as (select w.roi, m.c, median(abs(p2 - p1 - m.c)) * 1.4826 as s from w join m on w.roi = m.roi group by all),
 z as (select w.roi, cast(odor as int) as odor, trial, (r - p2 - c) / nullif(s, 0) as z, (p2 - p1 - c) / nullif(s, 0) as control from w join s on w.roi = s.roi)"""


@query(CALLS + " select roi, odor, trial, round(z, 6) as z, round(control, 6) as control from z")
def trial_calls(spark, d):
    from . import reports

    return reports.trial_calls(_session(spark, d), 12).select("roi", "odor", "trial", rounded("z").alias("z"), rounded("control").alias("control"))


@query(CALLS + """ select trial, odor, count(z) as n, count(*) filter (where z >= 2) as n_excited, count(*) filter (where z <= -2) as n_suppressed, round(avg(case when control >= 2 then 1.0 when control is not null then 0 end), 6) as chance_excited,
 round(avg(case when control <= -2 then 1.0 when control is not null then 0 end), 6) as chance_suppressed from z group by all""")
def trial_counts(spark, d):
    from . import reports

    return reports.trial_counts(reports.trial_calls(_session(spark, d), 12)).withColumns({c: rounded(c) for c in ("chance_excited", "chance_suppressed")})


@query()
def responders(spark, d):
    from . import reports

    return reports.responders(_session(spark, d), min_trials=2).select("block", "roi", "odor", "n", rounded("t").alias("t"), rounded("p", 8).alias("p"), "rejected", "sign")


@query()
def responder_flags(spark, d):
    """Counts of each block of the session's responders, and what would make them unreadable."""
    from . import reports

    return reports.responder_flags(reports.responders(_session(spark, d), min_trials=2), detrended=False)


@query()
def qc_report(spark, d):
    from . import reports

    r = reports.qc_report(_session(spark, d), 12)
    return r.select(*[rounded(c, 4).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


#: Of 20 trials at most none lies 5 deviations out, so the SQL needs no outliers. Sham windows of 8 frames begin 8, 10, ..., 24 before.
SHAM = """with f as (select vec_id % 50 as roi, vec_id // 50 as trial, (vec_id // 50) % 5 as odor, (vec_id // 50) % 2 as st, i - 1 as frame, embedding[i]::double as v from embeddings, range(1, 65) r(i)),
 o as (select range as place, 8 + 2 * range as s from range(9)),
 w as (select roi, trial, odor, place, avg(v) filter (where frame >= 32 - s and frame < 40 - s) as r, avg(v) filter (where frame < 32 - s and frame >= 28 - s) as b, var_pop(v) filter (where frame < 32 - s) as var, count(v) filter (where frame < 32 - s) as n from f, o group by all),
 p as (select *, sqrt(sum(var * n) over (partition by roi, place) / sum(n) over (partition by roi, place)) as sd from w), z as (select roi, odor, place, avg((r - b) / sd) as z from p group by all),
 c as (select quantile_cont(z, 0.99) filter (where place % 2 = 0) as up, quantile_cont(z, 0.01) filter (where place % 2 = 0) as down, count(z) filter (where place % 2 = 0) as n_null from z)"""
CELLS = SHAM + """, e as (select roi, trial, odor, case when st = 0 then 'pre' else 'post' end as state, avg(v) filter (where frame < 32 and frame >= 28) as base, avg(v) filter (where frame >= 32 and frame < 48) as resp, var_pop(v) filter (where frame < 32) as var from f group by all),
 y as (select *, (resp - base) / abs(base) as dff, (resp - base) / sqrt(avg(var) over (partition by roi)) as ze from e),
 k as (select state from y group by state having count(distinct trial) >= (select count(distinct odor) from y)),
 q as (select 'pooled' as block, roi, odor, avg(dff) as dff, avg(ze) as z from y group by all union all select state, roi, odor, avg(dff), avg(ze) from y where state in (select state from k) group by all),
 a as (select q.*, z >= up as exc, z <= down as sup, z >= up or z <= down as hit from q, c)"""
SPARSE = "round((1 - avg(abs(dff)) ** 2 / avg(dff * dff)) / nullif(1 - 1.0 / count(dff), 0), 6)"


def _qc(spark, d):
    from . import qc

    t = _session(spark, d)
    null, _ = qc.thresholds(t, 4.0)
    resp = response.trial_responses(t, ["roi"], "trial", "frame", "v", "on", "off", True, 4, ["odor", "state"])
    return qc.called(qc.cells(resp), null)


@query(SHAM + """ select round(up, 6) as z_excited, round(down, 6) as z_suppressed, n_null, round((select avg((z >= up)::int) from z where place % 2 = 1), 6) as achieved_excited,
 round((select avg((z <= down)::int) from z where place % 2 = 1), 6) as achieved_suppressed from c""")
def sham_null(spark, d):
    from . import qc

    null, _ = qc.thresholds(_session(spark, d), 4.0)
    return null.select("n_null", *[rounded(c).alias(c) for c in ("z_excited", "z_suppressed", "achieved_excited", "achieved_suppressed")])


@query(CELLS + f" select block, odor::int as odor, round(avg(hit::int), 6) as responsive, round(avg(exc::int), 6) as excited, round(avg(sup::int), 6) as suppressed, {SPARSE} as sparseness from a group by block, odor")
def qc_odor_block(spark, d):
    from . import qc

    return qc.odor_block(_qc(spark, d)).select("block", "odor", *[rounded(c).alias(c) for c in ("responsive", "excited", "suppressed", "sparseness")])


@query(CELLS + f" select block, roi, count(*) filter (where hit) as n_odors, bool_and(sup) as suppressed_by_all, {SPARSE} as sparseness from a group by block, roi")
def qc_roi_block(spark, d):
    from . import qc

    return qc.roi_block(_qc(spark, d)).select("block", "roi", "n_odors", "suppressed_by_all", rounded("sparseness").alias("sparseness"))


@query(CELLS + """, r as (select block, roi, bool_or(hit) as n_any, bool_and(hit) as n_all, bool_or(exc) as e, bool_or(sup) as s, (1 - avg(abs(dff)) ** 2 / avg(dff * dff)) / nullif(1 - 1.0 / count(dff), 0) as life from a group by all)
 select block, n_rois, n_any, n_all, n_excited, n_suppressed, lifetime_median, dff_p95 from (select block, count(*) as n_rois, count(*) filter (where n_any) as n_any, count(*) filter (where n_all) as n_all, count(*) filter (where e) as n_excited,
 count(*) filter (where s) as n_suppressed, round(median(life), 6) as lifetime_median from r group by block) join (select block, round(quantile_cont(dff, 0.95), 4) as dff_p95 from a group by block) using (block)""")
def qc_block_rows(spark, d):
    from . import qc

    return qc.block_rows(_qc(spark, d)).select("block", "n_rois", "n_any", "n_all", "n_excited", "n_suppressed", rounded("lifetime_median").alias("lifetime_median"), rounded("dff_p95", 4).alias("dff_p95"))


@query()
def response_qc(spark, d):
    """The flags of a session's report."""
    from . import qc

    t = _session(spark, d)
    _, report = qc.response_qc(t, t.groupBy("roi").agg(F.count_distinct("trial").alias("area")), 4.0)
    return report.select("n_rois", "n_any", "source", F.concat_ws("; ", "flags").alias("flags"))


@query("""with f as (select vec_id % 50 as roi, (vec_id // 50) % 5 as odor, vec_id // 50 as trial, i - 1 as frame, embedding[i]::double as v from embeddings, range(1, 65) r(i)), t as (select roi, odor, trial, avg(v) filter (where frame >= 32 and frame < 48) - avg(v) filter (where frame < 32) as d from f group by all)
 select roi, """ + ", ".join(f'round(avg(d) filter (where odor = {i}), 6) as "{i}"' for i in range(5)) + " from t group by roi")
def by_odor(spark, d):
    from . import reports

    x = response.trial_deltas(_session(spark, d), ["roi", "odor", "trial"], "frame", "v", "on", "off")
    return reports.by_odor(x, "delta", list(range(5))).select("roi", *[rounded(F.col(f"`{i}`")).alias(str(i)) for i in range(5)])


MOVIE = """with m as (select l_suppkey % 7 as trial, cast(l_orderkey % 40 as int) as t, cast(l_partkey % 9 as int) as y, cast(l_suppkey % 8 as int) as x, avg(l_quantity) as v from lineitem group by all), tr as (select range as trial, cast(case when range = 3 then 38 else 20 end as int) as "on", range % 2 as odor from range(7)),
 c as (select m.*, tr."on", odor from m join tr using (trial) where tr."on" <= 30 and t >= tr."on" - 10 and t < tr."on" + 10),
 s as (select *, avg(case when t < "on" then v end) over w as a, stddev_samp(case when t < "on" then v end) over w as b from c window w as (partition by trial, y, x)),
 z as (select odor, t - "on" + 10 as t, y, x, case when b is null or b <= 1e-6 then 0 else (v - a) / b end as z from s)"""


def _movies(spark, d):
    from . import reports

    li = table(spark, d, "lineitem")
    f = li.groupBy((F.col("l_suppkey") % 7).alias("trial"), (F.col("l_orderkey") % 40).cast("int").alias("t"), (F.col("l_partkey") % 9).cast("int").alias("y"), (F.col("l_suppkey") % 8).cast("int").alias("x")).agg(F.avg("l_quantity").alias("v"))
    trials = spark.range(7).select(F.col("id").alias("trial"), F.when(F.col("id") == 3, 38).otherwise(20).alias("on"), (F.col("id") % 2).alias("odor"))
    return f, trials, reports.group_z_movies(f, trials, 10, 20, ["odor"])


@query(MOVIE + " select odor, t, y, x, round(avg(z), 6) as z, count(z) as n from z group by all")
def group_zscore_movies(spark, d):
    return _movies(spark, d)[2][0].select("odor", "t", "y", "x", rounded("z").alias("z"), "n")


@query()
def group_correlation_maps(spark, d):
    from . import reports

    return reports.correlation_maps(_movies(spark, d)[2][0], ["odor"]).withColumn("corr", rounded("corr", 4))


@query()
def session_images(spark, d):
    from . import reports

    f, trials, _ = _movies(spark, d)
    s = reports.summary_session(f, trials.withColumn("off", F.col("on") + 10))
    return s.select("y", "x", *[rounded(c, 4).alias(c) for c in ("mean", "max", "corr", "activity")])


@query()
def reference_images(spark, d):
    from . import reports

    r = reports.reference_images(_movies(spark, d)[0], 24)
    return r.select("trial", "y", "x", rounded("structure", 4).alias("structure"), rounded("corr", 4).alias("corr"))


@query("""with i as (select cast(l_partkey % 30 as int) as y, cast(l_suppkey % 9 as int) as x, avg(l_quantity) as v from lineitem group by all), q as (select quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.995) as hi from i),
 g as (select y, x, 255 * greatest(0, least(1, coalesce((v - lo) / nullif(hi - lo, 0), 0))) as g, y // 6 * 4 + x // 3 + 1 as label from i, q)
 select y, x, cast(round_even(0.5 * g + 0.5 * case (label - 1) % 3 when 0 then 255 else 0 end, 0) as int) as r, cast(round_even(0.5 * g + 0.5 * case (label - 1) % 3 when 1 then 255 else 0 end, 0) as int) as g, cast(round_even(0.5 * g + 0.5 * case (label - 1) % 3 when 2 then 255 else 0 end, 0) as int) as b from g""")
def mask_overlay(spark, d):
    from . import reports

    im = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 30).cast("int").alias("y"), (F.col("l_suppkey") % 9).cast("int").alias("x")).agg(F.avg("l_quantity").alias("v"))
    mask = im.select("y", "x", (F.floor(F.col("y") / 6) * 4 + F.floor(F.col("x") / 3) + 1).alias("label"))
    return reports.overlay(im, mask, [(255, 0, 0), (0, 255, 0), (0, 0, 255)])


@query("""select c_custkey as roi, case when c_custkey % 11 = 0 then 999 when c_custkey % 13 = 0 then -1 when c_custkey % 3 = 0 then c_nationkey else -1 end as "group" from customer""")
def roi_groups(spark, d):
    from . import reports

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("roi"), F.col("c_nationkey").alias("group"))
    manual = c.where("roi % 11 = 0 or roi % 13 = 0").select("roi", F.when(F.col("roi") % 11 == 0, 999).alias("group"))
    return reports.roi_groups(c.select("roi"), c.where("roi % 3 = 0"), manual)
