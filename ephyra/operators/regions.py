"""Connected regions of masks and clusters of rois, by joins: images of any size, no image in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.shared import saved, written
from .grouping import components

#: Columns of a line that are compared together.
STRETCH = 256


def runs(mask: DataFrame, keys: list[str], same: list[str] = ()) -> DataFrame:
    """(keys, same, y, x0, x1, run): stretches of pixels side by side in a line with equal `same`; run is a number of its own. Lines are cut
    in stretches first, so a line of any width spreads over tasks."""
    cut = mask.select(*keys, *same, "y", "x", F.floor(F.col("x") / STRETCH).alias("_s")).distinct()
    order = Window.partitionBy(*keys, *same, "y", "_s").orderBy("x")
    part = cut.withColumn("_g", F.col("x") - F.row_number().over(order))
    out = part.groupBy(*keys, *same, "y", "_s", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_s", "_g")
    return saved(out.withColumn("run", F.monotonically_increasing_id()))


def labelled_runs(mask: DataFrame, keys: list[str], eight: bool = True, same: list[str] = ()) -> DataFrame:
    """(keys, same, y, x0, x1, region): runs with the number of their connected region, from 1 in each key in the order in which a region's
    first pixel comes line by line. eight: corners connect too. same: only pixels with equal values of these connect."""
    r = runs(mask, keys, same)
    touch = 1 if eight else 0
    by = [*keys, *same]
    ask = lambda p, shift: r.select(*[F.col(c).alias(f"{p}_{c}") for c in by], (F.col("y") + shift).alias(f"{p}_y"), F.col("x0").alias(f"{p}0"), F.col("x1").alias(f"{p}1"), F.col("run").alias(p))
    spread = lambda p, df, lo, hi: df.withColumn(f"{p}_s", F.explode(F.sequence(F.floor(lo / STRETCH), F.floor(hi / STRETCH))))
    same_line = F.col("a_y") == F.col("b_y")
    for c in by:
        same_line = same_line & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    a, b = spread("a", ask("a", 1), F.col("a0") - touch, F.col("a1") + touch), spread("b", ask("b", 0), F.col("b0"), F.col("b1"))
    below = a.join(b, same_line & (F.col("a_s") == F.col("b_s"))).where((F.col("a0") - touch <= F.col("b1")) & (F.col("b0") <= F.col("a1") + touch)).select("a", "b")
    beside = ask("a", 0).join(ask("b", 0), same_line & (F.col("a1") + 1 == F.col("b0"))).select("a", "b")  # the two sides of a cut
    root = components(below.union(beside).distinct())
    named = saved(r.join(root.withColumnRenamed("node", "run"), "run", "left").withColumn("root", F.coalesce("root", "run")).drop("run"))
    first = named.groupBy(*keys, "root").agg(F.min(F.struct("y", "x0")).alias("_f"))
    number = first.select("root", F.row_number().over(Window.partitionBy(*keys).orderBy("_f")).alias("region"))
    return named.join(number, "root").drop("root")


def pixels_of(labelled: DataFrame) -> DataFrame:
    """One row for each pixel of runs."""
    return labelled.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def labelled(mask: DataFrame, keys: list[str] = (), eight: bool = True) -> DataFrame:
    """(keys, y, x, region) of a mask's pixels (keys, y, x)."""
    return pixels_of(labelled_runs(mask, list(keys), eight))


def largest(mask: DataFrame, keys: list[str] = (), eight: bool = True) -> DataFrame:
    """The pixels (keys, y, x) of each mask's largest region; of equally large ones the first."""
    return _largest(labelled_runs(mask, list(keys), eight), list(keys)).drop("area")


def _largest(lab: DataFrame, by: list[str]) -> DataFrame:
    area = lab.groupBy(*by, "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    best = area.groupBy(*by).agg(F.max_by(F.struct("region", "area"), F.struct("area", (-F.col("region")).alias("r"))).alias("_m")).select(*by, "_m.*")
    named = best.select(*[F.col(c).alias(f"_{c}") for c in [*by, "region"]], "area")
    same = F.lit(True)
    for c in [*by, "region"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return pixels_of(lab.join(named, same).select(*by, "y", "x0", "x1", "area"))


def drop_clipped(mask: DataFrame, least: float, keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(mask (keys, y, x, label), dropped (keys, label, area)) after parts of rois were cut away: each roi keeps its largest piece (sides
    connect, corners don't), and goes if that has fewer than `least` pixels."""
    by = [*keys, "label"]
    best = saved(_largest(labelled_runs(mask.where("label > 0"), by, eight=False), by))
    return best.where(F.col("area") >= least).drop("area"), best.where(F.col("area") < least).select(*by, "area").distinct()


#: Pairs that a task makes, or holds uncounted, at a time.
PAIRS = 2_000_000


def sharing(members: DataFrame, least: float) -> DataFrame:
    """(a, b, s), a < b: how many items rois (roi, kind, item) of different kinds share, of the pairs that share at least `least` of the items
    of a; an overlap over union of `least` or more has that. Rows with a NULL share nothing.

    Every pair of every item has to be looked at, since shares are small; but a pair is one number in a packed list of its lesser roi, and
    is counted, and mostly dropped, where that roi's lists meet: nothing of the order of the pairs is shuffled as rows or again."""
    m = written(members.select(F.col("roi").cast("long"), "kind", "item").dropna().distinct())
    own = m.groupBy("roi").agg(F.countDistinct("item").alias("n"))
    held = m.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("roi", F.xxhash64("kind").alias("kind")))).alias("_l")).where(F.size("_l") > 1)

    def pairs(batches):
        for batch in batches:
            roi, kind = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            size = np.diff(batch.column(0).offsets.to_numpy())
            end = np.repeat(np.cumsum(size), size)
            after = end - np.arange(len(roi)) - 1  # those behind a roi in its item's list
            lo = 0
            while lo < len(roi):
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(after[lo:]), PAIRS, "right")))
                n = after[lo:hi]
                i = np.repeat(np.arange(lo, hi), n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                met = (kind[i] != kind[j]) & (roi[i] != roi[j])
                i, j = i[met], j[met]
                count = np.bincount(i - lo, minlength=hi - lo)
                some = np.flatnonzero(count)
                if len(some):
                    offsets = np.concatenate([[0], np.cumsum(count[some])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(roi[lo + some]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(roi[j]))], names=["a", "bs"])
                lo = hi

    lists = held.select("_l.roi", "_l.kind").mapInArrow(pairs, "a long, bs array<long>")
    # each roi's number of items comes first among its rows
    first = own.select(F.col("roi").alias("a"), F.lit(None).cast("array<long>").alias("bs"), "n")
    rows = lists.withColumn("n", F.lit(None).cast("long")).unionByName(first).repartition("a").sortWithinPartitions("a", F.col("n").desc_nulls_last())

    def counts(batches):
        a, need, found, times, open_, waiting = None, 0, None, None, [], 0

        def packed():
            b, k = np.unique(np.concatenate([found, *open_]), return_inverse=True)
            return b, np.bincount(k, np.concatenate([times, *[np.ones(len(x)) for x in open_]]), len(b)).astype(np.int64)

        def done():
            b, s = packed()
            good = s >= need
            return pa.RecordBatch.from_arrays([pa.array(np.full(int(good.sum()), a)), pa.array(b[good]), pa.array(s[good])], names=["a", "b", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            roi, n = batch.column(0).to_numpy(), batch.column(2).fill_null(-1).to_numpy()
            values, offsets = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            edges = [0, *(np.flatnonzero(roi[1:] != roi[:-1]) + 1).tolist(), len(roi)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if roi[lo] != a:
                    if open_:
                        yield done()
                    a, need, found, times, open_, waiting = int(roi[lo]), 0, np.zeros(0, np.int64), np.zeros(0), [], 0
                if n[lo] >= 0:
                    need = least * int(n[lo]) * (1 - 1e-9)
                if offsets[hi] > offsets[lo]:
                    open_.append(values[offsets[lo] : offsets[hi]])
                    waiting += len(open_[-1])
                    if waiting > PAIRS:
                        (found, times), open_, waiting = packed(), [np.zeros(0, np.int64)], 0
        if open_:
            yield done()

    return rows.mapInArrow(counts, "a long, b long, s long")


def clusters(rois: DataFrame, overlaps: DataFrame, least: float, linkage: str = "complete") -> DataFrame:
    """(roi, cluster): rois joined while the linkage of two clusters is an overlap of `least` or more; cluster is the least roi in it.

    overlaps (a, b, overlap) has each pair of rois that overlap at all once. Complete: the least overlap of any pair counts; average:
    the mean over all pairs, those that don't overlap as 0; single: the greatest. Taking the two nearest clusters again and again gives the same as
    joining in each round all pairs that are each other's nearest (of equally near ones the least numbers), since a joined cluster
    is no nearer to any other than its nearer part was. Only pairs of clusters that overlap have a row."""
    if linkage not in ("complete", "average", "single"):
        raise ValueError(f"linkage is complete, average or single, not {linkage!r}")
    limit = least - 1e-12
    e = overlaps.where("a <> b and overlap > 0").groupBy(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).agg(F.max("overlap").cast("double").alias("s"))
    label = saved(rois.select(F.col("roi").cast("long").alias("roi"), F.col("roi").cast("long").alias("cluster")).distinct())
    if linkage == "single":
        root = components(e.where(F.col("s") >= limit).select("a", "b"))
        return label.select("roi").join(root.withColumnRenamed("node", "roi"), "roi", "left").select("roi", F.coalesce("root", "roi").alias("cluster"))
    live = saved((e.where(F.col("s") >= limit) if linkage == "complete" else e).withColumns({"n": F.lit(1).cast("long"), "na": F.lit(1).cast("long"), "nb": F.lit(1).cast("long")}))
    near = F.col("s") if linkage == "complete" else F.col("s") / (F.col("na") * F.col("nb"))
    while True:
        close = live.withColumn("_d", -near).where(-F.col("_d") >= limit)
        best = close.select(F.explode(F.array("a", "b")).alias("_c"), F.struct("_d", "a", "b").alias("_o")).groupBy("_c").agg(F.min("_o").alias("_o"))
        mutual = saved(best.groupBy("_o.a", "_o.b").agg(F.count(F.lit(1)).alias("_k")).where("_k = 2").select("a", "b"))
        if mutual.isEmpty():
            return label
        new = mutual.select(F.col("b").alias("_old"), F.col("a").alias("_new"))
        label = saved(label.join(new, F.col("cluster") == F.col("_old"), "left").select("roi", F.coalesce("_new", "cluster").alias("cluster")))
        size = label.groupBy(F.col("cluster").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
        for c in "ab":
            live = live.join(new, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
        merged = live.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.min("s") if linkage == "complete" else F.sum("s")).alias("s"), F.sum("n").alias("n"))
        for c in "ab":
            merged = merged.join(size.select(F.col("_c").alias(c), F.col("_n").alias(f"n{c}")), c)
        # complete: a pair of rois that don't overlap keeps the clusters apart for good
        live = saved(merged.where(F.col("n") == F.col("na") * F.col("nb")) if linkage == "complete" else merged)
