"""Groups of rois by distance and correlation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.columns import rounded, safe_ratio
from ..sources.shared import saved, written


def index_image(somas: DataFrame, processes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels: y, x, idx; members: idx, kind, label): both masks in one image, a process over a soma where they overlap."""
    both = somas.where("label > 0").withColumn("kind", F.lit("soma")).unionByName(processes.where("label > 0").withColumn("kind", F.lit("process")))
    members = both.select("kind", "label").distinct().withColumn("idx", F.row_number().over(Window.orderBy(F.col("kind").desc(), "label")) - 1)
    pixels = both.join(members, ["kind", "label"]).groupBy("y", "x").agg(F.max("idx").alias("idx"))
    return pixels, members


def pairwise_gaps(mask: DataFrame, most: int) -> DataFrame:
    """(a, b, gap): the least distance between pixels of two rois, up to `most`. Pixels meet in cells of that size, so that each
    is held against the 3 x 3 cells around it and no others."""
    m = mask.where("label > 0").withColumns({"cy": F.floor(F.col("y") / most), "cx": F.floor(F.col("x") / most)})
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    other = m.withColumn("_n", near).select(F.col("label").alias("b"), F.col("y").alias("y2"), F.col("x").alias("x2"), (F.col("cy") + F.col("_n.dy")).alias("cy"), (F.col("cx") + F.col("_n.dx")).alias("cx"))
    d2 = (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) + (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2"))
    return m.withColumnRenamed("label", "a").join(other, ["cy", "cx"]).where((F.col("a") < F.col("b")) & (d2 <= most * most)).groupBy("a", "b").agg(F.sqrt(F.min(d2)).alias("gap"))


#: Values of two blocks of traces that a task holds at most, rois of a block, traces of a tile, whose pairs are compared at once (and
#: rois that share a row), and pairs of rois after which a batch ends.
BLOCK_VALUES, BLOCK_ROIS, TILE_ROIS, BATCH_PAIRS = 8_000_000, 32_768, 512, 262_144


def lagged_correlations(traces: DataFrame, pairs: DataFrame | None = None, max_lag: int = 0, places: int | None = None) -> DataFrame:
    """(a, b, corr), a < b: the largest correlation of two rois' traces (roi, trial, frame, v) over lags within trials, NULL if flat;
    rounded to so many places, if given.

    pairs (a, b): only these, by joins. Else all pairs that share a frame, as a matrix: a trace is packed in one row with the rois that
    have it, rows are cut in blocks, each pair of blocks is one task of matrix products over pairs of tiles, so that traces are copied once
    for each block and never once for each pair. What is shuffled is the different traces times the blocks; what comes out is of the
    order of all pairs. Two traces are compared (and rounded) once however many rois have them, and the pairs of those rois follow one
    another with the same correlation, which columns on disk hold in a few bytes."""
    final = (lambda df: df) if places is None else lambda df: df.withColumn("corr", rounded("corr", places))
    if pairs is not None:
        a = traces.select(F.col("roi").alias("a"), "trial", "frame", F.col("v").alias("va"))
        lags = F.explode(F.array(*[F.lit(i) for i in range(-max_lag, max_lag + 1)]))
        b = traces.withColumn("lag", lags).select(F.col("roi").alias("b"), "trial", (F.col("frame") + F.col("lag")).alias("frame"), "lag", F.col("v").alias("vb"))
        own = [m.alias(f"_{n}{x}") for x, y in (("va", "vb"), ("vb", "va")) for n, m in ((f, g(F.when(F.col(y).isNotNull(), F.col(x)))) for f, g in (("s", F.var_pop), ("q", lambda v: F.avg(v * v))))]
        per = a.join(pairs, "a").join(b, ["b", "trial", "frame"]).groupBy("a", "b", "lag").agg(F.covar_pop("va", "vb").alias("_c"), *own)
        # corr itself fails on flat traces; what merging sums leaves of them is a deviation in the 16th digit
        varies = (F.col("_sva") > 1e-24 * F.col("_qva")) & (F.col("_svb") > 1e-24 * F.col("_qvb"))
        per = per.select("a", "b", F.when(varies, F.col("_c") / F.sqrt(F.col("_sva") * F.col("_svb"))).alias("c"))
        return final(per.groupBy("a", "b").agg(F.max(F.when(F.col("c").isNotNull() & ~F.isnan("c"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c"))))).alias("corr")))
    t = traces.select(F.col("roi").cast("long"), F.col("trial").cast("long"), F.col("frame").cast("long"), F.col("v").cast("double")).where("v is not null and roi is not null")
    own = t.groupBy("roi").agg(F.array_sort(F.collect_list(F.struct("trial", "frame", "v"))).alias("_p")).select("roi", *[F.col(f"_p.{c}").alias(c) for c in ("trial", "frame", "v")])
    equal = own.groupBy("trial", "frame", "v").agg(F.sort_array(F.collect_list("roi")).alias("_r"))
    few = F.explode(F.transform(F.sequence(F.lit(0), F.size("_r") - 1, F.lit(TILE_ROIS)), lambda i: F.slice("_r", i + 1, TILE_ROIS)))
    packed = written(equal.select(few.alias("rois"), "trial", "frame", "v"))
    rows, rois, longest, low, high = packed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("rois")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.min(F.array_min("frame")), F.max(F.array_max("frame"))).first()
    times = packed.select(F.explode(F.array_distinct("trial"))).distinct().count() * ((high or 0) - (low or 0) + 1 + 2 * max_lag)
    tile = max(16, min(TILE_ROIS, BLOCK_VALUES // max(1, 2 * times)))
    # blocks as large as a task can hold, but so many that their pairs keep each core busy
    cores = traces.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rois // max(tile, BLOCK_ROIS)), -(-rows // max(tile, BLOCK_VALUES // max(1, 2 * longest))), min(-(-rois // tile), math.ceil(math.sqrt(16 * cores))))
    own = F.pmod(F.xxhash64(F.element_at("rois", 1)), F.lit(blocks)).cast("int")
    cut = packed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")
    # partitions by number, so that none are put together: their input is small, what they make of it isn't
    dealt = cut.repartition(max(1, min(blocks * (blocks + 1) // 2, 2000)), "lo", "hi").sortWithinPartitions("lo", "hi", "rois")
    met = final(dealt.mapInArrow(lambda batches: _pairs_of_blocks(batches, max_lag, tile), "roi long, others array<long>, corr double"))
    return met.select("roi", "corr", F.explode("others").alias("_o")).select(F.least("roi", "_o").alias("a"), F.greatest("roi", "_o").alias("b"), "corr")


def _pairs_of_blocks(batches, max_lag: int, tile: int):
    """The correlations of each pair of blocks in sorted rows (rois, trial, frame, v, own, lo, hi), held one pair of blocks at a time."""
    held, key = [], None
    for batch in batches:
        lo, hi = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("lo", "hi"))
        edges = [0, *(np.flatnonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:]):
            if j > i:
                if held and key != (lo[i], hi[i]):
                    yield from _tiles(pa.Table.from_batches(held), key, max_lag, tile)
                    held = []
                key = (lo[i], hi[i])
                held.append(batch.slice(i, j - i))
    if held:
        yield from _tiles(pa.Table.from_batches(held), key, max_lag, tile)


def _tiles(rows: pa.Table, key: tuple, max_lag: int, tile: int):
    own = rows.column("own").to_numpy()
    place = lambda side: np.flatnonzero(own == side)
    cut = lambda at: [at[i : i + tile] for i in range(0, len(at), tile)]
    los, his = cut(place(key[0])), cut(place(key[1]))
    for i, a in enumerate(los):
        for b in his[i:] if key[0] == key[1] else his:
            same = a[0] == b[0]
            yield from _tile_correlations(rows.take(pa.array(a if same else np.concatenate([a, b]))), len(a), same, max_lag)


def _tile_correlations(rows: pa.Table, first: int, same: bool, max_lag: int):
    """(roi, others, corr) of all pairs of the first rows with the others, or (same) of all rows with themselves and one another."""
    flat_of = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
    r = np.repeat(np.arange(len(rows)), pc.list_value_length(rows.column("v")).to_numpy())
    trial, tr = np.unique(flat_of("trial"), return_inverse=True)
    frame = flat_of("frame")
    low, width = frame.min(), int(frame.max() - frame.min()) + 1 + 2 * max_lag
    x = np.full((len(rows), len(trial), width), np.nan)
    x[r, tr, frame - low + max_lag] = flat_of("v")
    there = ~np.isnan(x)
    x = np.where(there, x - (np.where(there, x, 0.0).sum(axis=(1, 2)) / np.maximum(there.sum(axis=(1, 2)), 1))[:, None, None], 0.0)
    lo = np.arange(len(rows)) < first
    hi = lo if same else ~lo
    flat = lambda v, k: np.roll(v, k, axis=2).reshape(len(v), -1)  # noqa: E731  margins keep a lag inside its trial
    a, ma = flat(x[lo], 0), flat(there[lo], 0).astype(float)
    best, met = np.full((lo.sum(), hi.sum()), -np.inf), np.zeros((lo.sum(), hi.sum()), bool)
    for lag in range(-max_lag, max_lag + 1):
        b, mb = flat(x[hi], lag), flat(there[hi], lag).astype(float)
        n, sa, sb, ab = ma @ mb.T, a @ mb.T, ma @ b.T, a @ b.T
        aa, bb = (a * a) @ mb.T, ma @ (b * b).T
        va, vb = n * aa - sa * sa, n * bb - sb * sb
        ok = (va > 1e-9 * n * aa) & (vb > 1e-9 * n * bb) & (n > 1)
        c = np.clip((n * ab - sa * sb) / np.sqrt(np.where(ok, va * vb, 1)), -1, 1)
        best = np.where(ok, np.maximum(best, c), best)
        met |= n > 0
    i, j = np.nonzero(np.triu(met) if same else met)
    yield from _pairs_of_rois(flat_of("rois"), pc.list_value_length(rows.column("rois")).to_numpy().astype(np.int64), i, j if same else j + first, best[i, j])


def _pairs_of_rois(roi: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, corr: np.ndarray):
    """(roi, others, corr): each roi of row i[k] with those of row j[k], whose correlation is corr[k]; in a row itself with the later ones."""
    start = np.cumsum(size) - size
    for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(size[i] * size[j]) // BATCH_PAIRS)) + 1):
        n = size[i[at]]
        k, place = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        skip = np.where(i[k] == j[k], place + 1, 0)
        length = size[j[k]] - skip
        ends = np.concatenate([[0], np.cumsum(length)])
        others = roi[np.repeat(start[j[k]] + skip - ends[:-1], length) + np.arange(ends[-1])]
        yield pa.RecordBatch.from_arrays([pa.array(roi[start[i[k]] + place]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(others)), pa.array(corr[k], mask=~np.isfinite(corr[k]))], names=["roi", "others", "corr"])


def array_correlations(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, corr) of traces kept as arrays (roi, v): centred, NULLs as 0, 0 for a flat one."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0))) / F.greatest(F.lit(1), F.size(F.filter(v, lambda x: x.isNotNull())))
    c = vectors.withColumn("_m", mean(F.col("v"))).withColumn("v", F.transform("v", lambda x: F.coalesce(x.cast("double") - F.col("_m"), F.lit(0.0)))).drop("_m")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    c = c.withColumn("n", norm(F.col("v")))
    a, b = c.select(F.col("roi").alias("a"), F.col("v").alias("va"), F.col("n").alias("na")), c.select(F.col("roi").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.coalesce(safe_ratio(dot, F.col("na") * F.col("nb")), F.lit(0.0)).alias("corr"))


def gap_profile(pairs: DataFrame, kind: str, width: float) -> DataFrame:
    """(kind, gap_bin, mean, n) of correlations over right-open bins of the gap."""
    return pairs.groupBy(kind, (F.floor(F.col("gap") / width) * width).alias("gap_bin")).agg(F.avg("corr").alias("mean"), F.count("corr").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that edges (a, b) reach. In each round a node points to its least neighbour if that is less than itself
    (a minimum, summed before the shuffle), pointers are doubled to their ends, and edges become those between ends, until none
    is left. Rows with a NULL give no link."""
    edges = saved(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna())
    label = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    between = lambda df: saved(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    live = between(edges)
    while not live.isEmpty():
        root = _ends(live.groupBy(F.col("b").alias("g")).agg(F.min("a").alias("to")).withColumn("st", F.lit(False))).select("g", "to")
        label = saved(label.join(root, F.col("root") == F.col("g"), "left").select("node", F.coalesce("to", "root").alias("root")))
        for c in "ab":
            live = live.join(root, F.col(c) == F.col("g"), "left").withColumn(c, F.coalesce("to", c)).drop("g", "to")
        live = between(live)
    return label


def constrained_groups(links: DataFrame, kinds: DataFrame, least: float, name: str = "soma") -> DataFrame:
    """(a, b, corr, gap, status, root): links (a, b, corr, gap) in order of correlation (strongest, then nearest, then by roi) join groups
    unless the group would hold two rois of the kind. root is the least roi of a's group.

    The outcome is that of taking the links one after another, found in rounds instead. A group without a roi of the kind can be joined to
    any other, and nothing before its best link touches it, so that link joins in any case: all such groups take their best link at
    once. What links them are trees with at most one roi of the kind each (or a pair that chose each other), so pointers are doubled to
    their ends and the groups contracted. Links inside a group or between two groups of the kind drop out. At least half of the groups
    without the kind that have links left vanish in a round, whatever the shape of the component; no task holds one."""
    typed = links.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("corr").cast("double"), F.col("gap").cast("double"))
    strong = saved(typed.where(F.coalesce(F.col("corr") >= least, F.lit(False)) & ~F.isnan("corr")))
    rois = saved(strong.select(F.explode(F.array("a", "b")).alias("roi")).distinct().join(kinds.select(F.col("roi").cast("long").alias("roi"), F.col(name).alias("own")), "roi", "left").select("roi", F.coalesce("own", F.lit(False)).alias("own")))
    label = rois.select("roi", F.col("roi").alias("g"))
    side = lambda x: rois.select(F.col("roi").alias(x), F.col("own").alias(f"s{x}"))
    live = strong.join(side("a"), "a").join(side("b"), "b").select("a", "b", "corr", "gap", F.col("a").alias("ga"), F.col("b").alias("gb"), "sa", "sb")
    joined = []
    while True:
        live = saved(live.where((F.col("ga") != F.col("gb")) & ~(F.col("sa") & F.col("sb"))))
        if live.isEmpty():
            break
        ends = F.explode(F.array(F.struct(F.col("ga").alias("g"), F.col("sa").alias("s"), F.col("gb").alias("to"), F.col("sb").alias("st")), F.struct(F.col("gb").alias("g"), F.col("sb").alias("s"), F.col("ga").alias("to"), F.col("sa").alias("st"))))
        first = F.struct((-F.col("corr")).alias("c"), "gap", "a", "b")
        best = saved(live.select(first.alias("_o"), ends.alias("_e")).where("not _e.s").groupBy("_e.g").agg(F.min_by(F.struct("_e.to", "_e.st", "_o.a", "_o.b"), "_o").alias("_b")).select("g", "_b.*"))
        joined.append(best.select("a", "b").distinct())
        root = _ends(best)
        label = saved(label.join(root.select("g", "to"), "g", "left").select("roi", F.coalesce("to", "g").alias("g")))
        for x in "ab":
            new = root.select(F.col("g").alias(f"g{x}"), F.col("to").alias("_t"), F.col("st").alias("_st"))
            live = live.join(new, f"g{x}", "left").withColumns({f"s{x}": F.when(F.col("_t").isNull(), F.col(f"s{x}")).otherwise(F.col("_st")), f"g{x}": F.coalesce("_t", f"g{x}")}).drop("_t", "_st")
    root = label.groupBy("g").agg(F.min("roi").alias("root"))
    named = saved(label.join(root, "g").select("roi", "root"))
    out = strong.join(named.select(F.col("roi").alias("a"), "root"), "a").join(named.select(F.col("roi").alias("b"), F.col("root").alias("_rb")), "b")
    if joined:
        chosen = reduce(DataFrame.union, joined).withColumn("_chosen", F.lit(True))
        out = out.join(chosen, ["a", "b"], "left")
    else:
        out = out.withColumn("_chosen", F.lit(None).cast("boolean"))
    status = F.when(F.col("_chosen"), "linked").when(F.col("root") == F.col("_rb"), "already_grouped").otherwise("two_somas")
    weak = typed.where(F.coalesce(F.col("corr") < least, F.lit(True)) | F.isnan("corr")).select("a", "b", "corr", "gap", F.lit("below_correlation").alias("status"), F.lit(None).cast("long").alias("root"))
    return out.select("a", "b", "corr", "gap", status.alias("status"), "root").unionByName(weak)


def _ends(pointers: DataFrame) -> DataFrame:
    """(g, to, st) with `to` the end of the way from g along pointers (g, to, st); of two that point at each other the lesser is the end
    of both. st belongs to `to`."""
    ahead = pointers.select(F.col("g").alias("to"), F.col("to").alias("_t"), F.col("st").alias("_st"))
    both = F.coalesce(F.col("_t") == F.col("g"), F.lit(False))
    now = saved(pointers.join(ahead, "to", "left").select("g", F.when(both, F.least("g", "to")).otherwise(F.col("to")).alias("to"), F.when(both, F.lit(False)).otherwise(F.col("st")).alias("st")))
    while True:
        ahead = now.select(F.col("g").alias("to"), F.col("to").alias("_t"), F.col("st").alias("_st"))
        new = saved(now.join(ahead, "to", "left").select("g", F.coalesce("_t", "to").alias("to"), F.coalesce("_st", "st").alias("st"), (F.col("_t") != F.col("to")).alias("_moved")))
        now = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return now


def group_members(links: DataFrame) -> DataFrame:
    """(roi, group): members of groups of two and more, numbered from 1 by their least member."""
    got = links.where("status = 'linked'").select("root", F.explode(F.array("a", "b")).alias("roi")).distinct()
    least = got.groupBy("root").agg(F.min("roi").alias("_least"))
    return got.join(least.withColumn("group", F.dense_rank().over(Window.orderBy("_least"))), "root").select("roi", "group")


def assigned(groups: DataFrame, edits: DataFrame) -> DataFrame:
    """groups (roi, group) after edits (roi, group): an edit replaces, NULL removes."""
    return groups.join(edits.select("roi"), "roi", "left_anti").unionByName(edits.where(F.col("group").isNotNull()))


def next_group(groups: DataFrame) -> DataFrame:
    return groups.agg((F.coalesce(F.max("group"), F.lit(0)) + 1).alias("next"))


def roi_at(masks: DataFrame, points: DataFrame) -> DataFrame:
    """points (y, x) with the roi there (kind, label), a soma before a process."""
    m = masks.where("label > 0").groupBy("y", "x").agg(F.min_by(F.struct("kind", "label"), F.when(F.col("kind") == "soma", 0).otherwise(1)).alias("_r"))
    return points.join(m, ["y", "x"], "left").select("y", "x", "_r.kind", "_r.label")


def live_edits(edits: DataFrame) -> DataFrame:
    """An edit log (edit_id, action, target, ...) less what later rows with action 'delete' undo."""
    return edits.where("action <> 'delete'").join(edits.where("action = 'delete'").select(F.col("target").alias("edit_id")), "edit_id", "left_anti")


def curated(mask: DataFrame, edits: DataFrame) -> DataFrame:
    """A mask without the rois that live edits drop, numbered anew from 1."""
    gone = live_edits(edits).where("action = 'drop'").select(F.col("target").cast("int").alias("label"))
    left = mask.where("label > 0").join(gone, "label", "left_anti")
    numbers = left.select("label").distinct().withColumn("_new", F.row_number().over(Window.orderBy("label")))
    return left.join(numbers, "label").select("y", "x", F.col("_new").alias("label"))


def mask_summary(mask: DataFrame, height: int, width: int) -> DataFrame:
    """(n_rois, median_diameter, coverage) of a mask."""
    areas = mask.where("label > 0").groupBy("label").agg(F.count(F.lit(1)).alias("a"))
    return areas.agg(F.count(F.lit(1)).alias("n_rois"), F.median(2 * F.sqrt(F.col("a") / F.pi())).alias("median_diameter"), (100 * F.sum("a") / (height * width)).alias("coverage"))
