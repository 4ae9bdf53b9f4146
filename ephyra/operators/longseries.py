"""Filters and onsets of series of any length: blocks of samples side by side, a few numbers for each block carried from one to the next.

A recursive filter's state after a block is a fixed matrix times its state before, plus what the block alone gives. So blocks are run from
rest side by side, the carries of a series (four numbers and a count for each block) are folded in order, and every block then adds the
response to the state that it begins with. Medians look a few samples into the next blocks; envelopes are joined by tile.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.shared import saved
from . import clock, signals

BLOCK = 65_536
#: Samples that are stepped through one by one while many such stretches go side by side.
STRETCH = 256


@lru_cache(maxsize=16)
def _homogeneous(a: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(response (n, order) of the output to each part of the state, the state's matrix to the power n)."""
    order = len(a) - 1
    step = np.zeros((order, order))
    step[:, 0] = -np.array(a[1:])
    step[:-1, 1:] = np.eye(order - 1)
    rows, power = np.eye(order)[:1], step
    while len(rows) < n:
        rows, power = np.concatenate([rows, rows @ power]), power @ power
    return rows[:n], np.linalg.matrix_power(step, n)


def recurrence(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filtered x, state after it) from the state z (transposed direct form)."""
    many = len(x) // STRETCH
    head, out = x[: many * STRETCH].reshape(many, STRETCH), np.empty(len(x))
    if many:
        state, y = np.zeros((many, len(z))), np.empty((many, STRETCH))
        for t in range(STRETCH):
            y[:, t] = b[0] * head[:, t] + state[:, 0]
            state = np.pad(state[:, 1:], ((0, 0), (0, 1))) + head[:, t, None] * b[1:] - y[:, t, None] * a[1:]
        response, power = _homogeneous(tuple(a), STRETCH)
        begin = np.empty_like(state)
        for i in range(many):
            begin[i], z = z, power @ z + state[i]
        out[: many * STRETCH] = (y + begin @ response.T).ravel()
    for i in range(many * STRETCH, len(x)):
        out[i] = b[0] * x[i] + z[0]
        z = np.append(z[1:], 0.0) + x[i] * b[1:] - out[i] * a[1:]
    return out, z


def _out(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """pdf with plain key columns, which Arrow takes whatever pieces they came in."""
    return pdf.assign(**{k: pdf[k].astype(object) for k in keys})


def _type(df: DataFrame, c: str) -> str:
    return f"{c} {df.schema[c].dataType.simpleString()}"


def bandpassed(samples: DataFrame, keys: list[str], order: str, value: str, rate: float, band=signals.FILTER_HZ, block: int = BLOCK) -> DataFrame:
    """(keys, order, value, _i, _n): the zero-phase band-pass of each series, with each sample's place and the series' length.

    The same as `signals.bandpass` of the samples in order: forward and back over the series and an odd reflection at either end; zeros for
    a series no longer than a reflection. Blocks are ranges of `order`, a whole sample number. NaN anywhere makes a series NaN."""
    b, a = signals.butterworth(*band, rate)
    size = len(b) - 1
    pad = 3 * (size + 1)
    rest = np.zeros(size)
    settled = np.linalg.solve(np.eye(size) - np.column_stack([-a[1:], np.eye(size)[:, :-1]]), b[1:] - a[1:] * b[0])
    own = ", ".join(_type(samples, k) for k in keys)
    cut = samples.select(*keys, F.floor(F.col(order) / block).cast("long").alias("block"), F.struct(F.col(order).cast("long").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("x")).alias("_s"))
    rows = cut.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("_s")).alias("_s")).select(*keys, "block", F.col("_s.t").alias("t"), F.col("_s.x").alias("y"))

    def first(pdfs):
        for pdf in pdfs:
            xs = [np.asarray(x, float) for x in pdf["y"]]
            ys, ends = zip(*[recurrence(b, a, x, rest) for x in xs], strict=True) if xs else ((), ())
            yield _out(pdf, keys).assign(y=list(ys), m=[len(x) for x in xs], head=[x[: pad + 1] for x in xs], tail=[x[-pad - 1 :] for x in xs], state=list(ends))

    carry = "m long, head array<double>, tail array<double>, state array<double>"
    forward = saved(rows.mapInPandas(first, f"{own}, block long, t array<bigint>, y array<double>, {carry}"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        count = pdf["m"].to_numpy(np.int64)
        total, offset = int(count.sum()), np.concatenate([[0], np.cumsum(count)[:-1]])
        begins, back = [rest] * len(pdf), rest
        if total > pad:
            start, end = np.zeros(0), np.zeros(0)
            for part in pdf["head"]:
                start = np.concatenate([start, part])[: pad + 1]
                if len(start) > pad:
                    break
            for part in reversed(list(pdf["tail"])):
                end = np.concatenate([part, end])[-pad - 1 :]
                if len(end) > pad:
                    break
            before, after = 2 * start[0] - start[:0:-1], 2 * end[-1] - end[-2::-1]
            _, z = recurrence(b, a, before, settled * before[0])
            for i, (n, state) in enumerate(zip(count, pdf["state"])):
                begins[i], z = z, _homogeneous(tuple(a), int(n))[1] @ z + np.asarray(state)
            y, _ = recurrence(b, a, after, z)
            _, back = recurrence(b, a, y[::-1], settled * y[-1])
        return _out(pdf, keys)[[*keys, "block"]].assign(offset=offset, n=total, begin=begins, back=[back] * len(pdf))

    begun = forward.select(*keys, "block", "m", "head", "tail", "state").groupBy(*keys).applyInPandas(fold, f"{own}, block long, offset long, n long, begin array<double>, back array<double>")

    def second(pdfs):
        for pdf in pdfs:
            ys = [np.asarray(y, float) + _homogeneous(tuple(a), len(y))[0] @ np.asarray(z) if n > pad else np.zeros(len(y)) for y, z, n in zip(pdf["y"], pdf["begin"], pdf["n"])]
            done, ends = zip(*[recurrence(b, a, y[::-1], rest) for y in ys], strict=True) if ys else ((), ())
            yield _out(pdf, keys).assign(y=list(done), state=list(ends))[[*keys, "block", "t", "y", "m", "offset", "n", "back", "state"]]

    joined = forward.drop("head", "tail", "state").join(begun, [*keys, "block"])
    backward = saved(joined.mapInPandas(second, f"{own}, block long, t array<bigint>, y array<double>, m long, offset long, n long, back array<double>, state array<double>"))

    def unfold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=False, ignore_index=True)
        begins, z = [], np.asarray(pdf["back"].iloc[0])
        for n, state in zip(pdf["m"], pdf["state"]):
            begins.append(z)
            z = _homogeneous(tuple(a), int(n))[1] @ z + np.asarray(state)
        return _out(pdf, keys)[[*keys, "block"]].assign(begin=begins)

    ended = backward.select(*keys, "block", "m", "back", "state").groupBy(*keys).applyInPandas(unfold, f"{own}, block long, begin array<double>")

    def third(pdfs):
        for pdf in pdfs:
            ys = [(np.asarray(y, float) + _homogeneous(tuple(a), len(y))[0] @ np.asarray(z))[::-1] if n > pad else np.zeros(len(y)) for y, z, n in zip(pdf["y"], pdf["begin"], pdf["n"])]
            yield _out(pdf, keys).assign(y=ys)[[*keys, "t", "y", "offset", "n"]]

    out = backward.select(*keys, "block", "t", "y", "offset", "n").join(ended, [*keys, "block"]).mapInPandas(third, f"{own}, t array<bigint>, y array<double>, offset long, n long")
    each = out.select(*keys, "offset", "n", F.posexplode(F.arrays_zip("t", "y")).alias("_p", "_s"))
    return each.select(*keys, F.col("_s.t").cast(samples.schema[order].dataType).alias(order), F.col("_s.y").alias(value), (F.col("offset") + F.col("_p")).alias("_i"), F.col("n").alias("_n"))


def detrended(series: DataFrame, keys: list[str], order: str, value: str, width: int, block: int = BLOCK) -> DataFrame:
    """(keys, order, _i, y, before, before_order): series (keys, order, value, _i, _n) less the median of `width` (odd) samples around each,
    the ends repeated, with the sample before. Blocks borrow what their windows need from those beside them."""
    half = width // 2
    to = lambda c: F.floor(c / block).cast("long")
    spread = series.select(*keys, order, value, "_i", "_n", F.explode(F.sequence(to(F.greatest(F.lit(0), F.col("_i") - half)), to(F.col("_i") + half + 1))).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        i, x, t, n, at = pdf["_i"].to_numpy(), pdf[value].to_numpy(float), pdf[order].to_numpy(), int(pdf["_n"].iloc[0]), int(pdf["block"].iloc[0])
        left, right = (half if i[0] == 0 else 0), (half if i[-1] == n - 1 else 0)
        ext = np.concatenate([np.full(left, x[0]), x, np.full(right, x[-1])])
        known = len(ext) - width + 1  # medians of i[first] onwards
        first = half - left
        if known <= 0:
            return _out(pd.DataFrame({**{k: [] for k in keys}, order: t[:0], "_i": i[:0], "y": x[:0], "before": x[:0], "before_order": t[:0]}), keys)
        step = max(1, 4_000_000 // width)
        mid = np.concatenate([np.median(np.lib.stride_tricks.sliding_window_view(ext[s : min(s + step, known) + width - 1], width), axis=1) for s in range(0, known, step)])
        y = x[first : first + known] - mid
        i, t = i[first : first + known], t[first : first + known]
        before, before_t = np.concatenate([[np.nan], y[:-1]]), np.concatenate([[-1], t[:-1]])
        mine = i // block == at
        if mine.any() and i[0] == i[mine][0] != 0:
            raise ValueError("a block lacks the sample before it")
        return _out(pd.DataFrame({**{k: [pdf[k].iloc[0]] * int(mine.sum()) for k in keys}, order: t[mine], "_i": i[mine], "y": y[mine], "before": before[mine], "before_order": before_t[mine]}), keys)

    own = ", ".join(_type(series, k) for k in keys)
    return spread.groupBy(*keys, "block").applyInPandas(run, f"{own}, {_type(series, order)}, _i long, y double, before double, before_order long")


def exact_percentile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "p", near: float = 0.002) -> DataFrame:
    """(keys, name): the percentile on the line between neighbouring ranks, exactly. A sketch gives bounds around it; only values
    between these are ranked, after equal ones are counted, so no task holds a series. Short series are ranked whole."""
    accuracy = int(4 / near)
    v = F.col(value)
    bounds = df.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.percentile_approx(v, [max(0.0, q - near), min(1.0, q + near)], accuracy).alias("_b"))
    short = F.col("_n") * near < 8
    lo, hi = F.when(short, F.col("_min")).otherwise(F.get("_b", F.lit(0))), F.when(short, F.col("_max")).otherwise(F.get("_b", F.lit(1)))
    bounds = saved(bounds.select(*keys, "_n", lo.alias("_lo"), hi.alias("_hi")))
    kept = df.where(v.isNotNull()).join(bounds, keys).where(v <= F.col("_hi"))
    counted = kept.groupBy(*keys, "_n", F.when(v < F.col("_lo"), F.lit(None)).otherwise(v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    reach = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
    at = F.lit(q) * (F.col("_n") - 1)
    rank = F.floor(at)
    ranked = counted.withColumn("_r", reach)
    pick = lambda r: F.min(F.when(F.col("_r") > r, F.col("_v")))
    ends = ranked.groupBy(*keys, "_n").agg(pick(rank).alias("_a"), pick(F.least(rank + 1, F.col("_n") - 1)).alias("_z"))
    return ends.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * (at - rank)).alias(name))


def enveloped(series: DataFrame, keys: list[str], value: str, rate: float) -> DataFrame:
    """series (.., _i, value) with `size`: the envelope by tiles (`signals.envelope`), on lines between the tiles' middles."""
    width = max(int(signals.ENVELOPE_S * rate), 8)
    tiles = signals.tile_envelope(series, keys, "_i", value, width).select(*keys, "tile", "envelope")
    least = tiles.groupBy(*keys).agg((F.median("envelope") * signals.QUIET).alias("_q"), F.max("tile").alias("_last"))
    w = Window.partitionBy(*keys).orderBy("tile")
    held = tiles.join(least, keys).withColumn("_e", F.greatest("envelope", "_q")).select(*keys, "tile", "_e", F.lead("_e").over(w).alias("_next"), F.col("_last"))
    last = series.join(least.select(*keys, "_last"), keys)
    place = F.col("_i") / width - 0.5
    at = last.withColumn("tile", F.greatest(F.lit(0), F.least(F.floor(place), F.col("_last"))).cast("long")).drop("_last")
    share = F.greatest(F.lit(0.0), F.col("_i") / width - 0.5 - F.col("tile"))
    line = F.when(F.col("_next").isNull(), F.col("_e")).otherwise(F.col("_e") + (F.col("_next") - F.col("_e")) * share)
    return at.join(held.drop("_last"), [*keys, "tile"]).withColumn("size", line).drop("tile", "_e", "_next")


def inhalations(samples: DataFrame, keys: list[str], order: str, value: str, rate: float, band=signals.SNIFF_HZ, excursion: float = signals.EXCURSION, block: int = BLOCK) -> DataFrame:
    """(keys, sample): the onsets that `signals.onsets` finds in the filtered series, each series in as many tasks as it has blocks."""
    filtered = bandpassed(samples, keys, order, value, rate, block=block).where(~F.isnan(value))
    flat = saved(detrended(filtered, keys, order, value, max(int(signals.MEDIAN_S * rate) | 1, 3), block))
    sized = enveloped(flat, keys, "y", rate)
    y = saved(sized.withColumn("v", F.when(F.col("size") > 0, F.col("y") / F.col("size")).otherwise(0.0)).select(*keys, "_i", "v", "y", "before", "before_order", "size"))
    limit = exact_percentile(y, keys, "v", 0.1).select(*keys, (F.least(F.col("p"), F.lit(0.0)) * excursion).alias("_deep"))
    deep = y.join(limit, keys).where(F.col("v") <= F.col("_deep")).select(*keys, F.col("_i").alias("at"))
    ups = y.where((F.col("before") <= 0) & (F.col("y") > 0) & (F.col("size") > 0)).select(*keys, (F.col("_i") - 1).alias("up"), F.col("before_order").alias("sample"))
    low = clock.asof(ups.withColumn("at", F.col("up") + 1), deep, keys, "at", [], "forward")
    ready = low.select(*keys, F.col("up").alias("at"), F.when(F.col("at_right").isNotNull(), F.greatest("at_right", F.col("up") + F.lit(int(np.ceil(rate / band[1]))))).alias("ready"))
    kept = clock.chain(ready, keys, "at", "ready").withColumnRenamed("at", "up")
    return ups.join(kept, [*keys, "up"]).select(*keys, F.col("sample").cast("long").alias("sample"))


def placed(samples: DataFrame, keys: list[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """(keys, order, value, _i): samples with their place from 0, by counts of blocks and places within these."""
    at = samples.select(*keys, order, value, F.floor(F.col(order) / block).cast("long").alias("block"))
    counts = at.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*keys, "block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(order)) - 1
    return at.withColumn("_p", inside).join(offset, [*keys, "block"]).select(*keys, order, value, (F.col("_o") + F.col("_p")).alias("_i"))


def quality(samples: DataFrame, keys: list[str], order: str, value: str, rate: float, window_s: float = signals.QUALITY_S, tiles: int = 64) -> DataFrame:
    """(keys, tile, score): the breath band's power over the noise band's in each whole window, some windows to a task at a time."""
    width = int(round(window_s * rate))
    if width < 8:
        raise ValueError(f"a window of {window_s} s has fewer than 8 samples at {rate} Hz")
    at = placed(samples, keys, order, value).withColumn("part", F.floor(F.col("_i") / (width * tiles)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        score = signals.band_quality(pdf[value].to_numpy(float), rate, window_s)
        return _out(pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(score) for k in keys}, "tile": int(pdf["part"].iloc[0]) * tiles + np.arange(len(score)), "score": score}), keys)

    return at.groupBy(*keys, "part").applyInPandas(run, ", ".join([*[_type(samples, k) for k in keys], "tile long, score double"]))
