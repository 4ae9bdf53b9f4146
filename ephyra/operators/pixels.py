"""Movies and masks as long tables: (movie, t, y, x, v) and (y, x, label)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.columns import safe_ratio

HALF = [(0, 1), (1, -1), (1, 0), (1, 1)]
#: Pixels on the side of a tile of a movie, the frames that are dealt together, and the rows that a task looks at at once.
TILE, SPAN, PIECE = 64, 256, 500_000


def _numbered(rows: pd.DataFrame, cols: list[str]) -> np.ndarray:
    """Numbers from 0 of stretches of rows with equal columns; NULL equals NULL."""
    new = np.zeros(len(rows), bool)
    for c in cols:
        v = rows[c]
        v = v.to_numpy() if v.dtype.kind in "iub" else pd.factorize(v, use_na_sentinel=False)[0]
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def baseline_z(frames: DataFrame, keys: list[str], t: str, value: str, on: str, sample: bool = True, floor: float = 1e-6) -> DataFrame:
    """frames with z against the mean and the standard deviation before `on`. sample: ddof 1 and a floor below which z is 0;
    else ddof 0 and 0 only where the deviation is 0."""
    pre = F.when(F.col(t) < F.col(on), F.col(value))
    w = Window.partitionBy(*keys)
    sd = (F.stddev_samp if sample else F.stddev_pop)(pre).over(w)
    low = floor if sample else 0.0
    return frames.withColumn("_m", F.avg(pre).over(w)).withColumn("_s", sd).withColumn("z", F.when(F.col("_s").isNull() | (F.col("_s") <= low), 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def group_mean(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    return frames.groupBy(*keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def stouffer(z: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, pooled): the sum of z over the root of their number. NULL keys are a group."""
    return z.groupBy(*keys).agg(F.count(value).alias("n"), (F.sum(value) / F.sqrt(F.count(value))).alias("pooled"))


def neighbour_correlation(frames: DataFrame, keys: list[str], t: list[str], value: str, centre_by: list[str] | None = None, tile: int = TILE, span: int = SPAN) -> DataFrame:
    """(keys, y, x, corr): the mean correlation over time of each pixel with its up to 8 neighbours; 0 with a flat one.

    The movie is dealt once, to tiles of tile x tile pixels and `span` of the first of `t` (whole frame numbers); pixels at a tile's edge go to the
    tiles beside it too. Tasks stream their sorted rows, many tiles of frames at a time: a pixel finds four of its neighbours in its frame by
    search, so that a frame costs what it holds and not what the image could hold. Moments of pairs add up over pieces to those of the
    movie: what is shuffled after that is of the order of the image for each piece. Missing (NULL) values aren't part of a pair. centre_by:
    values are first taken from their mean in each block (and pixel), for movies laid end to end."""
    f = frames.where(F.col(value).isNotNull()).select(*keys, *t, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("v"))
    if centre_by:
        by = [*keys, *centre_by, "y", "x"]
        mean = f.groupBy(*by).agg(F.avg("v").alias("_mean")).withColumnsRenamed({c: f"_by_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        f = f.join(mean, same).withColumn("v", F.col("v") - F.col("_mean")).select(*keys, *t, "y", "x", "v")
    at = lambda dy, dx: F.struct(F.floor((F.col("y") - dy) / tile).cast("int").alias("_ty"), F.floor((F.col("x") - dx) / tile).cast("int").alias("_tx"))
    spread = f.withColumn("_b", F.explode(F.array_distinct(F.array(at(0, 0), *[at(*d) for d in HALF])))).withColumn("_span", F.floor(F.col(t[0]) / span).cast("long"))
    own = [f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys]
    frame = [*keys, *t, "_ty", "_tx"]
    sums = ["n", "a", "b", "aa", "bb", "ab"]

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        place = _numbered(pdf, frame)
        y, x = pdf["y"].to_numpy().astype(np.int64), pdf["x"].to_numpy().astype(np.int64)
        v = pdf["v"].to_numpy()
        h, w = int(y.max() - y.min()) + 3, int(x.max() - x.min()) + 3  # a margin, so that a neighbour's code is no other pixel's
        code = (place * h + y - y.min() + 1) * w + x - x.min() + 1
        order = np.argsort(code, kind="stable")
        code, y, x, v = code[order], y[order], x[order], v[order]
        rows = pdf.iloc[order]
        mine = np.flatnonzero((y // tile == rows["_ty"].to_numpy()) & (x // tile == rows["_tx"].to_numpy()))
        pixel = ((_numbered(rows, keys) if keys else np.zeros(len(rows), np.int64)) * h + y - y.min()) * w + x - x.min()
        out = []
        for d, (dy, dx) in enumerate(HALF):
            want = code[mine] + dy * w + dx
            found = np.minimum(np.searchsorted(code, want), len(code) - 1)
            met = code[found] == want
            i, j = mine[met], found[met]
            if len(i):
                _, first, k = np.unique(pixel[i], return_index=True, return_inverse=True)
                a, b, size = v[i], v[j], len(first)
                got = rows.iloc[i[first]][[*keys, "y", "x"]].assign(d=np.int32(d))
                out.append(got.assign(**{c: np.bincount(k, z, size) for c, z in zip(sums, (np.ones(len(a)), a, b, a * a, b * b, a * b), strict=True)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[*keys, "y", "x", "d", *sums])

    def run(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= PIECE:
                whole = pd.concat(held, ignore_index=True)
                last = _numbered(whole, frame)
                cut = int(np.flatnonzero(last != last[-1])[-1]) + 1 if (last != last[-1]).any() else 0
                if cut:
                    yield moments(whole.iloc[:cut])
                held, n = [whole.iloc[cut:]], len(whole) - cut
        if n:
            yield moments(pd.concat(held, ignore_index=True))

    dealt = spread.select(*keys, *t, "y", "x", "v", "_span", "_b._ty", "_b._tx").repartition(*keys, *t[1:], "_span", "_ty", "_tx").sortWithinPartitions(*frame)
    blocks = dealt.drop("_span").mapInPandas(run, ", ".join([*own, "y int, x int, d int", *[f"{c} double" for c in sums]]))
    pairs = blocks.groupBy(*keys, "y", "x", "d").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    va, vb, cov = (F.col("aa") - F.col("a") * F.col("a") / F.col("n")), (F.col("bb") - F.col("b") * F.col("b") / F.col("n")), (F.col("ab") - F.col("a") * F.col("b") / F.col("n"))
    c = F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb)).otherwise(0.0)
    step = lambda i: F.get(F.array(*[F.lit(d[i]) for d in HALF]), F.col("d"))
    ends = pairs.select(*keys, F.explode(F.array(F.struct("y", "x", c.alias("c")), F.struct((F.col("y") + step(0)).alias("y"), (F.col("x") + step(1)).alias("x"), c.alias("c")))).alias("_e"))
    return ends.groupBy(*keys, "_e.y", "_e.x").agg(F.avg("_e.c").alias("corr"))


def summary_images(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    return frames.groupBy(*keys, "y", "x").agg(F.avg(value).alias("mean"), F.max(value).alias("max"))


def odor_response(frames: DataFrame, keys: list[str], t: str, value: str, on: str, off: str) -> DataFrame:
    """(keys, response): the mean over [on, off) of z against all frames before on; 0 if the deviation is 0 or the window empty."""
    pre, post = F.when(F.col(t) < F.col(on), F.col(value)), F.when((F.col(t) >= F.col(on)) & (F.col(t) < F.col(off)), F.col(value))
    return frames.groupBy(*keys).agg(F.coalesce(safe_ratio(F.avg(post) - F.avg(pre), F.stddev_pop(pre)), F.lit(0.0)).alias("response"))


def signed_activity(responses: DataFrame, keys: list[str], odor: str, value: str) -> DataFrame:
    """(keys, activity): the response of largest size, with its sign; of equals that of the first odor."""
    return responses.groupBy(*keys).agg(F.max_by(value, F.struct(F.abs(value), -F.col(odor))).alias("activity"))


def combined(images: DataFrame, value: str) -> DataFrame:
    """(y, x, mean, max) over images, NULLs and NaNs left out."""
    v = F.when(~F.isnan(value), F.col(value))
    return images.groupBy("y", "x").agg(F.avg(v).alias("mean"), F.max(v).alias("max"))


def roi_traces(frames: DataFrame, mask: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(label, keys, v): the mean of each roi's pixels. Pixels are joined by place; partial sums go before the shuffle."""
    return frames.join(mask.where("label > 0").select("y", "x", "label"), ["y", "x"]).groupBy("label", *keys).agg(F.avg(value).alias("v"))


def rings(mask: DataFrame, height: int, width: int, inner: int = 3, outer: int = 12) -> DataFrame:
    """(label, y, x): pixels at city-block distance in (inner, outer] from a roi's nearest pixel and in no roi; one that several
    rois could have goes to the least label."""
    m = mask.where("label > 0")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(abs(a) + abs(b)).alias("d")) for a in range(-outer, outer + 1) for b in range(-outer, outer + 1) if abs(a) + abs(b) <= outer]))
    near = m.withColumn("_s", steps).select("label", (F.col("y") + F.col("_s.a")).alias("y"), (F.col("x") + F.col("_s.b")).alias("x"), "_s.d").where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    near = near.groupBy("label", "y", "x").agg(F.min("d").alias("d")).where(F.col("d") > inner)
    return near.join(m.select("y", "x"), ["y", "x"], "left_anti").groupBy("y", "x").agg(F.min("label").alias("label"))


def roi_table(mask: DataFrame, traces: DataFrame | None = None, frame: str = "frame", n_pre: int = 0) -> DataFrame:
    """(label, area, diameter, cy, cx, and of the frames before n_pre: base, sd, snr)."""
    shape = mask.where("label > 0").groupBy("label").agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx")).withColumn("diameter", 2 * F.sqrt(F.col("area") / F.pi()))
    if traces is None:
        return shape
    pre = F.when(F.col(frame) < n_pre, F.col("v"))
    return shape.join(traces.groupBy("label").agg(F.avg(pre).alias("base"), F.stddev_pop(pre).alias("sd")), "label", "left").withColumn("snr", safe_ratio("base", "sd"))


def border(mask: DataFrame, height: int, width: int, b: int) -> DataFrame:
    return mask.where((F.col("y") < b) | (F.col("y") >= height - b) | (F.col("x") < b) | (F.col("x") >= width - b))


def overlaps(a: DataFrame, b: DataFrame, metric: str = "iou") -> DataFrame:
    """(a, b, shared, overlap) of all pairs of rois that share a pixel: over the union, or over the smaller one."""
    a, b = a.where("label > 0"), b.where("label > 0")
    shared = a.select("y", "x", F.col("label").alias("a")).join(b.select("y", "x", F.col("label").alias("b")), ["y", "x"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    n = shared.join(a.groupBy(F.col("label").alias("a")).agg(F.count(F.lit(1)).alias("_na")), "a").join(b.groupBy(F.col("label").alias("b")).agg(F.count(F.lit(1)).alias("_nb")), "b")
    whole = F.col("_na") + F.col("_nb") - F.col("shared") if metric == "iou" else F.least("_na", "_nb")
    return n.withColumn("overlap", F.col("shared") / whole).drop("_na", "_nb")


def votes(masks: DataFrame, cluster: str, source: str, fraction: float) -> DataFrame:
    """(cluster, y, x, votes) of pixels that max(1, ceil(fraction * sources of the cluster)) of its sources hold."""
    n = masks.groupBy(cluster).agg(F.countDistinct(source).alias("_n"))
    return masks.groupBy(cluster, "y", "x").agg(F.countDistinct(source).alias("votes")).join(n, cluster).where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction))).drop("_n")


def mask_digest(mask: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, digest) that changes if and only if a labelled pixel does. Rows are digested in blocks of lines, then lines' digests in order."""
    line = mask.where("label > 0").groupBy(*keys, "y").agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("x", "label"))), lambda p: F.concat_ws(":", p.x.cast("string"), p.label.cast("string")))), 256).alias("_d"))
    return line.groupBy(*keys).agg(F.substring(F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("y", "_d"))), lambda p: F.concat_ws("=", p.y.cast("string"), p["_d"]))), 256), 1, 16).alias("digest"))


def inside_polygon(pixels: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Pixels whose centre lies in a polygon (y, x), by the parity of the edges to their left."""
    odd = F.lit(False)
    for (y0, x0), (y1, x1) in zip(polygon, polygon[1:] + polygon[:1]):
        if y0 == y1:
            continue
        cross = (F.lit(y0) > F.col("y")) != (F.lit(y1) > F.col("y"))
        odd = odd != (cross & (F.col("x") < F.lit(x0) + (F.col("y") - y0) * ((x1 - x0) / (y1 - y0))))
    return pixels.where(odd)


def otsu(values: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """(keys, threshold): the bin edge of the largest variance between both sides, the first of equals."""
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int"))
    h = values.where(F.col(value).between(low, high)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return otsu_of_counts(h, keys).withColumn("threshold", low + (F.col("bin") + 1) * ((high - low) / bins))


def otsu_of_counts(h: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin): the last bin of the lower side, of histograms (keys, bin, n)."""
    w = Window.partitionBy(*keys)
    c = h.withColumns({"_w": F.sum("n").over(w.orderBy("bin")), "_s": F.sum(F.col("n") * F.col("bin")).over(w.orderBy("bin")), "_tw": F.sum("n").over(w), "_ts": F.sum(F.col("n") * F.col("bin")).over(w)})
    m0, m1 = F.col("_s") / F.col("_w"), (F.col("_ts") - F.col("_s")) / F.nullif(F.col("_tw") - F.col("_w"), F.lit(0))
    score = F.round(F.col("_w") / F.col("_tw") * ((F.col("_tw") - F.col("_w")) / F.col("_tw")) * (m0 - m1) * (m0 - m1), 9)
    return c.withColumn("_v", score).groupBy(*keys).agg(F.min_by("bin", F.struct(-F.coalesce("_v", F.lit(-1.0)), F.col("bin"))).alias("bin"))
