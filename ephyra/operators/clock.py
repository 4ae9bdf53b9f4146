"""Edges, pulses, bursts, as-of and interval joins: signals of different clocks laid on one another.

Every operator takes the columns that name a series (`key`), so that series are worked on side by side, each partition by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.columns import col
from ..sources.shared import saved

#: Volts that a logic level passes, and seconds between frames at least.
LOGIC_V, DEBOUNCE_S, BLOCK_GAP_S = 2.5, 0.005, 2.0


def _in_order(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def edges(signal: DataFrame, key: list[str], order: list[str], value: str, threshold: float = LOGIC_V) -> DataFrame:
    """Rows at which the value passes the threshold, with `edge` 'rise' or 'fall'. A value on the threshold counts as low."""
    before = F.lag(value).over(_in_order(key, order))
    kind = F.when((before <= threshold) & (F.col(value) > threshold), "rise").when((before > threshold) & (F.col(value) <= threshold), "fall")
    return signal.withColumn("edge", kind).where("edge is not null")


def pulses(signal: DataFrame, key: list[str], order: list[str], value: str, at: str, threshold: float = LOGIC_V) -> DataFrame:
    """(key, on, off): each rise with the fall after it. Edges alternate, so a fall before the first rise and a rise without a
    fall drop out by themselves."""
    e = edges(signal, key, order, value, threshold)
    return e.withColumn("off", F.lead(at).over(_in_order(key, order))).where("edge = 'rise' and off is not null").select(*key, F.col(at).alias("on"), "off")


def chain(events: DataFrame, key: list[str], at: str, ready: str) -> DataFrame:
    """(key, at) of the events that count: the first of each key, and after one that counts the first at or after its `ready`
    (NULL: never). ready lies after `at` and never falls from one event to the next.

    An event at or after the `ready` of the one before it counts whatever went before. From there the next ones are found by their
    successors, which a forward as-of join gives: pointers are doubled until none is left, and marks spread along them, the longest
    first. So a burst takes as many rounds as its length has binary digits, and is no list and no task of its own."""
    w = _in_order(key, [at])
    rows = events.select(*key, at, ready).distinct()
    rows = saved(rows.withColumn("_sure", F.lag(at).over(w).isNull() | F.coalesce(F.lag(ready).over(w) <= F.col(at), F.lit(False))))
    if rows.where("not _sure").isEmpty():
        return rows.select(*key, at)
    asked = rows.where(F.col(ready).isNotNull()).select(*key, F.col(at).alias("_from"), F.col(ready).alias(at))
    after = asof(asked, rows.select(*key, at, "_sure"), key, at, ["_sure"], "forward")
    names = [f"_k{i}" for i in range(len(key))]
    hops = [saved(after.where("not _sure").select(*[F.col(k).alias(n) for k, n in zip(key, names)], "_from", F.col("at_right").alias("_to")))]

    def follow(left: DataFrame, hop: DataFrame) -> DataFrame:
        """left (names, _from, _to) with the ends that a hop takes them to."""
        l, r = left.alias("l"), hop.alias("r")
        on = F.col("l._to") == F.col("r._from")
        for n in names:
            on = on & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
        return l.join(r, on).select(*[F.col(f"l.{n}").alias(n) for n in names], F.col("l._from").alias("_from"), F.col("r._to").alias("_to"))

    while not (twice := saved(follow(hops[-1], hops[-1]))).isEmpty():
        hops.append(twice)
    marked = rows.where("_sure").select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col(at).alias("_from"), F.col(at).alias("_to"))
    for hop in reversed(hops):
        marked = saved(marked.union(follow(marked, hop)))
    return marked.select(*[F.col(n).alias(k) for n, k in zip(names, key)], F.col("_to").alias(at))


def debounced(onsets: DataFrame, key: list[str], at: str, least) -> DataFrame:
    """Onsets (whole numbers) of which each is `least` or more after the last one that was kept."""
    return chain(onsets.select(*key, at, (F.col(at) + least).alias("_ready")), key, at, "_ready")


def gap_blocks(events: DataFrame, key: list[str], order: list[str], at, gap) -> DataFrame:
    """events with `block` from 0: a new one begins after a gap longer than `gap` in the units of `at`."""
    w = _in_order(key, order)
    return events.withColumn("_t", col(at)).withColumn("block", F.sum(F.coalesce((F.col("_t") - F.lag("_t").over(w) > gap).cast("long"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t")


def asof(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str], direction: str = "backward", tie: str | None = None) -> DataFrame:
    """left with the values and the time (`at_right`) of the right row nearest in time: at or before it ('backward'), at or after
    it ('forward'), or either ('nearest', of two equally near the earlier). Of right rows of one time the last (backward) or
    first (forward) by `tie` counts.

    Both sides become one stream, sorted once per key; no pair is built, so a right side of any size does."""
    order = tie or at
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(_struct(right, at, values))})
    r = right.select(*key, F.col(at), *([F.col(tie)] if tie and tie != at else []), F.lit(0).alias("_side"), F.struct(F.col(at).alias("at_right"), *values).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    back = _in_order(key, [F.col(at), F.col("_side"), F.col(order)]).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _in_order(key, [F.col(at), F.col("_side").desc(), F.col(order)]).rowsBetween(0, Window.unboundedFollowing)
    found = {"backward": ["_b"], "forward": ["_f"], "nearest": ["_b", "_f"]}[direction]
    if "_b" in found:
        both = both.withColumn("_b", F.last("_v", ignorenulls=True).over(back))
    if "_f" in found:
        both = both.withColumn("_f", F.first("_v", ignorenulls=True).over(ahead))
    pick = F.col(found[0])
    if direction == "nearest":
        pick = F.when(F.col("_f").isNull() | (F.col(at) - F.col("_b.at_right") <= F.col("_f.at_right") - F.col(at)), F.col("_b")).otherwise(F.col("_f"))
    return both.where("_side = 1").withColumn("_p", pick).select(*left.columns, F.col("_p.at_right").alias("at_right"), *[F.col(f"_p.{v}").alias(v) for v in values])


def _struct(df: DataFrame, at: str, values: list[str]) -> str:
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "struct<" + ",".join([f"at_right:{kind[at]}", *[f"{v}:{kind[v]}" for v in values]]) + ">"


def interpolated(left: DataFrame, right: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """left with the right side's value on the straight line between its neighbours in time, its end values beyond them."""
    b = asof(left, right, key, at, [value], "backward").withColumnsRenamed({"at_right": "_t0", value: "_v0"})
    f = asof(b, right, key, at, [value], "forward").withColumnsRenamed({"at_right": "_t1", value: "_v1"})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    return f.withColumn(value, F.when(F.col("_t0") == F.col("_t1"), F.col("_v0")).otherwise(F.coalesce(line, "_v0", "_v1"))).drop("_t0", "_t1", "_v0", "_v1")


def first_inside(blocks: DataFrame, points: DataFrame, key: list[str], begin: str, end: str, at: str, values: list[str], inclusive: bool = True) -> DataFrame:
    """blocks with the first point at or after their begin, if it isn't past their end (`inclusive`: may lie on it): an interval
    join as a forward as-of join, so that the number of points inside a block doesn't matter."""
    stamped = asof(blocks.withColumn(at, F.col(begin)), points, key, at, values, "forward").drop(at).withColumnRenamed("at_right", at)
    inside = F.col(at) <= F.col(end) if inclusive else F.col(at) < F.col(end)
    return stamped.withColumns({c: F.when(inside, F.col(c)) for c in [at, *values]})


def trigger_windows(triggers: DataFrame, rises: DataFrame, falls: DataFrame, key: list[str], at: str, interval: int, rate_hz: float, frame_rate: float) -> DataFrame:
    """triggers with on_frame and off_frame: the first rise within the interval after the trigger and the first fall after that
    (none: off is on), in frames from the trigger, ties to even."""
    t = triggers.withColumn("_end", F.col(at) + interval)
    on = first_inside(t.withColumnRenamed(at, "_trigger"), rises.withColumnRenamed(at, "_on"), key, "_trigger", "_end", "_on", [], inclusive=False)
    off = asof(on.where("_on is not null").withColumn("_at", F.col("_on")), falls.withColumnRenamed(at, "_at"), key, "_at", [], "forward").withColumn("_off", F.coalesce("at_right", "_on"))
    frame = lambda c: F.bround((F.col(c) - F.col("_trigger")) / rate_hz * frame_rate, 0).cast("int")
    return off.select(*key, F.col("_trigger").alias(at), frame("_on").alias("on_frame"), frame("_off").alias("off_frame"))


def odor_frames(frames: DataFrame, odor: DataFrame, key: list[str], align: str = "nearest") -> DataFrame:
    """(key, block, on_frame, off_frame, on_residual, off_residual): of each block of frames (frame, at, block) the first odor
    pulse (on, off) that begins inside it, laid on frames: the frame that contains the edge, the next, or the nearest."""
    how = {"contains": "backward", "next": "forward", "nearest": "nearest"}[align]
    blocks = frames.groupBy(*key, "block").agg(F.min("at").alias("begin"), F.max("at").alias("end"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    hit = first_inside(blocks, odor.select(*key, F.col("on").alias("at"), "off"), key, "begin", "end", "at", ["off"]).where("at is not null").withColumnRenamed("at", "on")
    grid = frames.select(*key, "block", "at", "frame")
    on = asof(hit.withColumn("at", F.col("on")), grid, [*key, "block"], "at", ["frame"], how).drop("at").withColumnsRenamed({"frame": "on_abs", "at_right": "on_at"})
    clamped = on.withColumn("at", F.least("off", "end"))
    off = asof(clamped, grid, [*key, "block"], "at", ["frame"], how).drop("at").withColumnsRenamed({"frame": "off_abs", "at_right": "off_at"})
    return off.select(*key, "block", (F.col("on_abs") - F.col("first_frame")).alias("on_frame"), (F.coalesce("off_abs", "last_frame") - F.col("first_frame")).alias("off_frame"), (F.col("on_at") - F.col("on")).alias("on_residual"), (F.col("off_at") - F.col("off")).alias("off_residual"))


def window_bounds(on_frame, n_pre: int, n_span: int) -> tuple[Column, Column]:
    """[begin, end) of the frames around an onset."""
    return col(on_frame) - n_pre, col(on_frame) - n_pre + n_span


def step_rate(onsets: DataFrame, key: list[str], at: str, low: float, high: float, per: float = 1.0) -> DataFrame:
    """(key, at, rate): one over the time to the next onset (in units of `per`), NULL outside [low, high]; to be held from there by a
    backward as-of join. The last onset begins no interval and has no row."""
    gap = (F.lead(at).over(_in_order(key, [at])) - F.col(at)) / per
    rate = F.when(gap > 0, F.lit(1.0) / gap)
    return onsets.select(*key, at, gap.alias("_gap"), F.when(rate.between(low, high), rate).alias("rate")).where("_gap is not null").drop("_gap")


def rolling_median(series: DataFrame, key: list[str], order: list[str], value: str, k: int = 3, name: str = "smooth") -> DataFrame:
    """series with the median of the k rows around each (fewer at the ends), NULLs left out."""
    frame = _in_order(key, order).rowsBetween(-(k // 2), k // 2)
    s = series.withColumn("_l", F.array_sort(F.collect_list(value).over(frame)))
    n = F.size("_l")
    mid = (F.get("_l", F.floor((n - 1) / 2).cast("int")) + F.get("_l", F.floor(n / 2).cast("int"))) / 2
    return s.withColumn(name, F.when(n > 0, mid)).drop("_l")


def header(samples: DataFrame, key: list[str], at: str, rate_hz: float) -> DataFrame:
    """(key, n_samples, duration_s) of channels kept as (key, at, value)."""
    return samples.groupBy(*key).agg((F.max(at) + 1).alias("n_samples")).withColumn("duration_s", F.col("n_samples") / rate_hz)


def channel(samples: DataFrame, name: str, column: int | None = None) -> DataFrame:
    """One channel's samples, or one column of a channel of arrays."""
    s = samples.where(F.col("channel") == name)
    return s if column is None else s.withColumn("value", F.get("value", column))
