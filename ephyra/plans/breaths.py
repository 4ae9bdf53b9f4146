"""Respiration of sessions: breath rates laid on imaging frames, trial by trial, with what isn't to be trusted said aloud.

channels: (keys, channel, at, value) of the recording's clock, `at` a sample number: one row for each sample of the channels named in CHANNELS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.columns import rounded
from ..operators import clock, signals
from ..sources.shared import saved
from .queries import SIGNAL, query, signal

#: The channels of a recording.
CHANNELS = {"frames": "2pFrameSync", "breath": "respiration", "odor": "odorPulse"}


def refuse(df: DataFrame, wrong: Column, text: Column) -> None:
    """An error with the first row's text if a row is wrong."""
    bad = df.where(wrong).select(text.alias("t")).first()
    if bad:
        raise ValueError(bad["t"])


def acquisitions(channels: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """(keys, at, block, frame): the recording's frames, debounced, in acquisitions numbered from 0; frames count from 0 in each."""
    rises = clock.edges(clock.channel(channels, CHANNELS["frames"]), keys, ["at"], "value").where("edge = 'rise'").select(*keys, "at")
    kept = clock.debounced(rises, keys, "at", round(clock.DEBOUNCE_S * rate))
    blocks = clock.gap_blocks(kept, keys, ["at"], "at", clock.BLOCK_GAP_S * rate)
    return blocks.withColumn("frame", F.row_number().over(Window.partitionBy(*keys, "block").orderBy("at")) - 1)


def matched(frames: DataFrame, trials: DataFrame, keys: list[str]) -> DataFrame:
    """trials (keys, trial from 0 in order, ...) with n_frame; errors unless each session has as many acquisitions as trials, all of one length."""
    counts = frames.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.min("n").alias("n_frame"), F.max("n").alias("longest"))
    both = trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials")).join(per, keys, "full")
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    say = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    refuse(both, F.coalesce("blocks", F.lit(0)) != F.coalesce("trials", F.lit(0)), say(name, ": ", n("blocks"), " acquisitions but ", n("trials"), " trials; they must correspond one to one"))
    refuse(both, F.col("n_frame") != F.col("longest"), say(name, ": acquisitions differ in length, from ", n("n_frame"), " to ", n("longest"), " frames"))
    return trials.join(per.select(*keys, "n_frame"), keys)


def laid_out(channels: DataFrame, frames: DataFrame, trials: DataFrame, keys: list[str], rate: float, threshold: float, smooth: int, most: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per frame, per trial, per session). One estimate serves a session, so a breath across two acquisitions isn't lost."""
    breath = clock.channel(channels, CHANNELS["breath"]).select(*keys, F.col("at").alias("sample"), "value")
    onsets = saved(signals.inhalations(breath, keys, "sample", "value", rate))
    scores = saved(signals.quality(breath, keys, "sample", "value", rate))
    at = frames.select(*keys, F.col("block").alias("trial"), "frame", F.col("at").alias("sample"))
    per_frame = saved(signals.breath_rates(onsets, scores, at, keys, "sample", rate, signals.QUALITY_S * rate, threshold, smooth))
    shares = signals.trial_frames(per_frame, keys, "trial", most)
    per_trial = trials.join(shares.withColumn("trial", F.col("trial").cast(trials.schema["trial"].dataType)), [*keys, "trial"])
    session = signals.breath_report(onsets, scores, per_frame, keys, threshold)
    flagged = per_trial.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trial"), F.max("n_frame").alias("n_frame"), F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("trial")))).alias("flagged_trials"))
    pulses = clock.edges(clock.channel(channels, CHANNELS["odor"]), keys, ["at"], "value").where("edge = 'rise'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_odor_pulses"))
    out = flagged.join(session, keys, "left").join(pulses, keys, "left").withColumn("n_odor_pulses", F.coalesce("n_odor_pulses", F.lit(0)))
    n = F.size("flagged_trials")
    masked = F.concat(n.cast("string"), F.lit(" of "), F.col("n_trial").cast("string"), F.lit(f" trials have more than {most:.0%} of their frames masked, so their means rest on another window than the others': "), F.concat_ws(", ", F.transform(F.slice("flagged_trials", 1, 8), lambda t: t.cast("string"))), F.when(n > 8, "...").otherwise(""))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return per_frame, per_trial, out.withColumn("n_flagged", n).withColumn("flags", F.when(n > 0, F.array_append(flags, masked)).otherwise(flags))


def respiration_from_round(channels: DataFrame, trials: DataFrame, keys: list[str], rate: float, *, threshold: float = signals.THRESHOLD, smooth: int = signals.SMOOTH, most: float = signals.MASKED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per frame, per trial, per session) of a round's trials (keys, trial, odor labels, ...).

    Per frame: trial, frame, rate (smoothed and masked), unmasked, quality. Per trial: the labels with masked_fraction and flagged (more than
    `most` of the frames are masked). Per session: n_trial, n_frame, n_breaths, median_hz, fraction_good, flagged_trials, n_flagged,
    n_odor_pulses and flags in words. `rate` is the clock's, in samples a second."""
    frames = saved(acquisitions(channels, keys, rate))
    return laid_out(channels, frames, matched(frames, trials, keys), keys, rate, threshold, smooth, most)


def extract_respiration(channels: DataFrame, trials: DataFrame, keys: list[str], rate: float, *, threshold: float = signals.THRESHOLD, smooth: int = signals.SMOOTH, most: float = signals.MASKED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `respiration_from_round`, for sessions without a round: odor windows and the frame rate come from the recording too.

    trials (keys, trial, acq_id, ...). Per trial also on_frame and off_frame; per session frame_rate (of the median frame interval), n_pre
    (the median onset) and onset_frame_spread. An acquisition without an odor pulse, or a trial without acq_id, is an error."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    refuse(trials, F.col("acq_id").isNull(), F.concat(name, F.lit(": a trial has no acq_id, the key that all later joins need")))
    frames = saved(acquisitions(channels, keys, rate))
    given = matched(frames, trials, keys)
    odor = clock.pulses(clock.channel(channels, CHANNELS["odor"]), keys, ["at"], "value", "at")
    windows = clock.odor_frames(frames, odor, keys).select(*keys, F.col("block").cast(trials.schema["trial"].dataType).alias("trial"), "on_frame", "off_frame")
    placed = saved(given.join(windows, [*keys, "trial"], "left"))
    refuse(placed, F.col("on_frame").isNull(), F.concat(name, F.lit(": no odor pulse lies inside acquisition "), F.col("trial").cast("string")))
    per_frame, per_trial, report = laid_out(channels, frames, placed, keys, rate, threshold, smooth, most)
    steps = frames.withColumn("_d", F.col("at") - F.lag("at").over(Window.partitionBy(*keys).orderBy("at"))).groupBy(*keys).agg((F.lit(rate) / F.median("_d")).alias("frame_rate"))
    onset = placed.groupBy(*keys).agg(F.floor(F.median("on_frame")).cast("long").alias("n_pre"), (F.max("on_frame") - F.min("on_frame")).alias("onset_frame_spread"))
    return per_frame, per_trial, report.join(steps, keys).join(onset, keys)


BREATHS = SIGNAL + """, o as (select distinct user_id, us from s where event_type = 'view'), q as (select user_id, us, (lead(us) over (partition by user_id order by us) - us) / 3.6e9 as g from o),
 r as (select user_id, us, case when g > 0 and 1 / g between 0.5 and 15 then 1 / g end as rate from q where g is not null), m as (select *, median(rate) over (partition by user_id order by us rows between 1 preceding and 1 following) as smooth from r),
 t as (select user_id, us // 86400000000 as tile, avg(value) as score from s where event_type <> 'click' group by all), u as (select *, lead(tile) over w as next_tile, lead(score) over w as next_score from t window w as (partition by user_id order by tile)),
 c as (select event_id, user_id, us, us / 86400000000.0 - 0.5 as place from s where event_type = 'click'),
 h as (select c.*, m.rate, m.smooth from c asof left join m on c.user_id = m.user_id and c.us >= m.us),
 l as (select h.*, case when h.user_id in (select user_id from r) then case when place = tile then score else score + (next_score - score) * (place - tile) end end as quality from h left join u on u.user_id = h.user_id and u.tile = floor(place)),
 k as (select *, case when quality >= 50 then smooth end as masked from l)"""


def _breaths(spark, d):
    """Views as breath onsets, the other events' mean value of a day as quality, clicks as frames; an hour is a second."""
    s = signal(spark, d)
    onsets = s.where("event_type = 'view'").select("user_id", "us").distinct()
    scores = s.where("event_type <> 'click'").groupBy("user_id", F.floor(F.col("us") / 86_400_000_000).alias("tile")).agg(F.avg("value").alias("score"))
    at = s.where("event_type = 'click'").select("event_id", "user_id", "us")
    return onsets, scores, signals.breath_rates(onsets, scores, at, ["user_id"], "us", 3.6e9, 8.64e10, 50.0)


@query(BREATHS + " select event_id, round(rate, 6) as frequency, round(smooth, 6) as unmasked, round(quality, 6) as quality, round(masked, 6) as rate from k")
def breath_frames(spark, d):
    """Rates of the breath that a frame lies in, their medians over breaths, and both masked by quality."""
    rated = _breaths(spark, d)[2]
    return rated.select("event_id", *[rounded(c).alias(c) for c in ("frequency", "unmasked", "quality", "rate")])


@query(BREATHS + """, n as (select user_id, greatest(count(*) - 1, 0) as n_breaths from o group by 1), g as (select user_id, avg((score >= 50)::int) as good from t group by 1), d as (select user_id, median(rate) as mid from h group by 1)
 select user_id, coalesce(n_breaths, 0) as n_breaths, round(mid, 6) as median_hz, round(case when coalesce(n_breaths, 0) > 0 then good else 0 end, 6) as fraction_good, case when coalesce(n_breaths, 0) = 0 or good < 0.7 then 1 else 0 end as n_flags
 from n full join g using (user_id) full join d using (user_id)""")
def breath_report(spark, d):
    """Breaths, median rate and share of good windows of each series, and whether it is flagged."""
    onsets, scores, rated = _breaths(spark, d)
    got = signals.breath_report(onsets, scores, rated, ["user_id"], 50.0)
    return got.select("user_id", "n_breaths", rounded("median_hz").alias("median_hz"), rounded("fraction_good").alias("fraction_good"), F.size("flags").alias("n_flags"))


@query(SIGNAL + """, e as (select user_id, us, row_number() over (partition by user_id order by us) as k from (select distinct user_id, us from s where event_type <> 'error')), low as (select distinct user_id, us from s where event_type = 'error'),
 f as (select e.*, low.us as deep from e asof left join low on e.user_id = low.user_id and e.us < low.us), g as (select *, case when deep is not null then greatest(deep, us + 7200000000) end as ready from f),
 t as (with recursive t as (select user_id, us, k, us as kept, ready from g where k = 1 union all
  select g.user_id, g.us, g.k, case when g.us >= t.ready then g.us else t.kept end, case when g.us >= t.ready then g.ready else t.ready end from t join g on g.user_id = t.user_id and g.k = t.k + 1) select * from t)
 select user_id, us from t where us = kept""")
def accepted_onsets(spark, d):
    """Of each user's events those that come two hours or more after the last that counted, with an error between them."""
    s = signal(spark, d)
    events = s.where("event_type <> 'error'").select("user_id", "us").distinct()
    deep = s.where("event_type = 'error'").select("user_id", F.col("us").alias("at"))
    low = clock.asof(events.withColumn("at", F.col("us") + 1), deep, ["user_id"], "at", [], "forward")
    ready = F.when(F.col("at_right").isNotNull(), F.greatest(F.col("at_right"), F.col("us") + 7_200_000_000))
    return clock.chain(low.select("user_id", "us", ready.alias("ready")), ["user_id"], "us", "ready")
