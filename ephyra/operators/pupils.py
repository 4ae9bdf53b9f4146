"""Pupils of eye frames, relationally. A frame is one row (key, index, height, width, pixels as bytes); keys and index name it.

All steps are joins and sums over pixels as rows, whatever the number of frames and their size: histograms give levels, runs give connected
pieces, and an ellipse follows from fifteen sums of powers of its points, so that trimming and voting are rounds of sums too."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import pixels, regions
from .frames import PupilConfig


#: Fixed values of a lid's chord: the least corridor in pixels and in residuals, points, share of the boundary, span over the bounding
#: box's diagonal, largest gap over the span, offset from the middle over the extent, and the wider corridor.
CHORD = {"px": 3.5, "residuals": 1.75, "points": 12, "share": 0.10, "span": 0.25, "gap": 0.30, "offset": 0.90, "wide": 1.5}
#: Directions that lines are looked for in.
DIRECTIONS = 90
LEAST_POINTS = 12
#: An ellipse with fewer of the boundary's points on it is put to a vote.
LEAST_ON = 0.45
FRAME, FIT = "_frame", ["cy", "cx", "major", "minor", "angle"]
POWERS = [(i, j) for i in range(5) for j in range(5 - i)]
FIELDS = ["peak", "threshold", "active", *FIT, "area", "axis_ratio", "residual", "inlier_fraction", "chord_fraction", "concavity_fraction", "used_ransac", "diameter"]


def pixel_rows(frames: DataFrame, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(_frame, y, x, v) of frames (_frame, height, width, pixels), lines first. Places outside a frame are left out."""
    y0, y1, x0, x1 = roi or (0, None, 0, None)
    ends = lambda c, hi: F.col(c) if hi is None else F.least(F.col(c), F.lit(hi))
    there = frames.withColumns({"_h": ends("height", y1), "_w": ends("width", x1)}).where((F.col("_h") > y0) & (F.col("_w") > x0))
    line = there.select(FRAME, "width", "_w", "pixels", F.explode(F.sequence(F.lit(y0), F.col("_h") - 1)).alias("y")).select(FRAME, "_w", "y", F.expr("hex(substring(pixels, y * width + 1, width))").alias("_l"))
    return line.select(FRAME, "y", "_l", F.explode(F.sequence(F.lit(x0), F.col("_w") - 1)).alias("x")).select(FRAME, "y", "x", F.expr("cast(conv(substring(_l, 2 * x + 1, 2), 16, 10) as int)").alias("v"))


def levels(px: DataFrame, config: PupilConfig = PupilConfig()) -> DataFrame:
    """(_frame, peak, threshold, core, active, plain): from each frame's histogram the brightest level, the one between dark and bright, that of
    a pupil's core, whether the light is on, and whether there is too little contrast for a pupil."""
    counts = written(px.groupBy(FRAME, F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    of = counts.groupBy(FRAME).agg(F.expr(f"percentile(bin, array(0.1, 0.99, 0.999, {config.bright_percentile / 100}), n)").alias("q"), (F.min("bin") == F.max("bin")).alias("flat"))
    cut = of.join(pixels.otsu_of_counts(counts, [FRAME]), FRAME)
    threshold = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.when(F.col("flat"), 0).otherwise(F.col("bin")) + F.lit(config.threshold_offset)))
    return cut.select(FRAME, F.col("q")[2].alias("peak"), threshold.alias("threshold"), F.greatest(threshold, F.col("q")[3]).alias("core"), (F.col("q")[2] >= config.dark_peak).alias("active"), (F.col("q")[1] - F.col("q")[0] < config.least_contrast).alias("plain"))


def filled(runs: DataFrame) -> DataFrame:
    """The pixels (_frame, y, x) of one connected piece (_frame, y, x0, x1) for each frame, with its holes: what surrounds a piece, in a box that is a
    pixel wider than it, is the first region of the rest; all others are holes."""
    box = runs.groupBy(FRAME).agg((F.min("y") - 1).alias("_y0"), (F.max("y") + 1).alias("_y1"), (F.min("x0") - 1).alias("_x0"), (F.max("x1") + 1).alias("_x1"))
    w = Window.partitionBy(FRAME, "y").orderBy("x0")
    gap = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    line = runs.join(box, FRAME).withColumns({"_before": F.coalesce(F.lag("x1").over(w) + 1, "_x0"), "_last": F.lead("x0").over(w).isNull()})
    inner = line.select(FRAME, "y", F.explode(F.array(gap(F.col("_before"), F.col("x0") - 1), F.when(F.col("_last"), gap(F.col("x1") + 1, F.col("_x1"))))).alias("_g"))
    outer = box.select(FRAME, F.explode(F.array("_y0", "_y1")).alias("y"), gap(F.col("_x0"), F.col("_x1")).alias("_g"))
    rest = inner.union(outer).where("_g.a <= _g.b").select(FRAME, "y", F.explode(F.sequence("_g.a", "_g.b")).alias("x"))
    holes = regions.labelled_runs(rest, [FRAME], eight=False).where("region > 1").select(FRAME, "y", "x0", "x1")
    return written(regions.pixels_of(runs.select(FRAME, "y", "x0", "x1").union(holes)))


def bright_masks(px: DataFrame, level: DataFrame) -> DataFrame:
    """The pixels (_frame, y, x) of each frame's pupil: of the pieces (sides connect) above the threshold the one with the most of the core's
    pixels, the first of equals, without holes."""
    lit = level.where(F.col("active") & ~F.col("plain")).select(FRAME, "threshold", "core")
    above = px.join(lit, FRAME).where("v > threshold").select(FRAME, "y", "x", (F.col("v") >= F.col("core")).alias("_core"))
    lab = written(regions.labelled_runs(above, [FRAME], eight=False))
    core = regions.pixels_of(lab).join(above.where("_core"), [FRAME, "y", "x"]).groupBy(FRAME, "region").agg(F.count(F.lit(1)).alias("n"))
    best = core.groupBy(FRAME).agg(F.max_by("region", F.struct("n", (-F.col("region")).alias("r"))).alias("region"))
    return filled(lab.join(best, [FRAME, "region"]).select(FRAME, "y", "x0", "x1"))


def edge_points(mask: DataFrame) -> DataFrame:
    """The pixels of masks that have a side on the outside."""
    row, column = Window.partitionBy(FRAME, "y").orderBy("x"), Window.partitionBy(FRAME, "x").orderBy("y")
    beside = lambda c, w: F.coalesce((F.lag(c).over(w) == F.col(c) - 1) & (F.lead(c).over(w) == F.col(c) + 1), F.lit(False))
    return mask.withColumn("_i", beside("x", row)).withColumn("_j", beside("y", column)).where(~(F.col("_i") & F.col("_j"))).drop("_i", "_j")


def _ellipse_of_sums(sums: pd.Series) -> pd.DataFrame:
    """The direct least-squares ellipse of points by the sums of their powers (POWERS, x first); no numbers where there is none."""
    s = np.stack(sums.to_numpy()).astype(float)
    at = {p: s[:, k] for k, p in enumerate(POWERS)}
    table = lambda a, b: np.stack([np.stack([at[p[0] + q[0], p[1] + q[1]] for q in b], -1) for p in a], -2)
    square, linear = [(2, 0), (1, 1), (0, 2)], [(1, 0), (0, 1), (0, 0)]
    s1, s2, s3 = table(square, square), table(square, linear), table(linear, linear)
    with np.errstate(all="ignore"):
        fine = np.isfinite(s).all(1) & (np.abs(np.linalg.det(s3)) > 1e-9)
        s3[~fine] = np.eye(3)
        t = -np.linalg.solve(s3, s2.transpose(0, 2, 1))
        m = np.array([[0, 0, 0.5], [0, -1, 0], [0.5, 0, 0]]) @ (s1 + s2 @ t)
        m[~np.isfinite(m).all((1, 2))] = np.eye(3)
        vec = np.linalg.eig(m)[1].real
        closed = 4 * vec[:, 0] * vec[:, 2] - vec[:, 1] ** 2
        v = np.take_along_axis(vec, closed.argmax(1)[:, None, None], 2)[:, :, 0]
        (a, b, c), (d, e, f) = v.T, np.einsum("nij,nj->ni", t, v).T
        den = b * b - 4 * a * c
        x, y = (2 * c * d - b * e) / den, (2 * a * e - b * d) / den
        k = a * x * x + b * x * y + c * y * y - f
        mean, half = (a + c) / 2, np.hypot((a - c) / 2, b / 2)
        one, two = k / (mean - half), k / (mean + half)
        major, minor = np.sqrt(np.maximum(one, two)), np.sqrt(np.minimum(one, two))
        steep = np.arctan2(b, a - c) / 2  # where the form is largest, so an axis is shortest if k and mean are above 0
        angle = np.where(two <= one, steep + np.pi / 2, steep) % np.pi
        out = np.stack([y, x, major, minor, angle], 1)
        out[~(fine & (closed.max(1) > 0) & np.isfinite(out).all(1))] = np.nan
    return pd.DataFrame(out, columns=FIT)


def through(points: DataFrame, by: list[str], least: int) -> DataFrame:
    """(by, e): the ellipse through points (by, y, x, _cy, _cx, _s: where and how wide the frame's points are), at least so many; one row
    for each that there is."""
    u, v = (F.col("x") - F.col("_cx")) / F.col("_s"), (F.col("y") - F.col("_cy")) / F.col("_s")
    power = lambda c, k: F.lit(1.0) if not k else c if k == 1 else power(c, k - 1) * c
    sums = points.groupBy(*by).agg(F.array(*[F.sum(power(u, i) * power(v, j)) for i, j in POWERS]).alias("_p"), F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("_cy", "_cx", "_s")]).where(F.col("_n") >= least)
    e = sums.withColumn("e", F.pandas_udf(_ellipse_of_sums, ", ".join(f"{c} double" for c in FIT))("_p")).where(~F.isnan("e.major"))
    return e.select(*by, F.struct((F.col("e.cy") * F.col("_s") + F.col("_cy")).alias("cy"), (F.col("e.cx") * F.col("_s") + F.col("_cx")).alias("cx"), (F.col("e.major") * F.col("_s")).alias("major"), (F.col("e.minor") * F.col("_s")).alias("minor"), F.col("e.angle").alias("angle")).alias("e"))


def off_ellipse(e: str = "e") -> Column:
    """How far (y, x) lies from an ellipse to first order, below 0 inside."""
    dy, dx, turn = F.col("y") - F.col(f"{e}.cy"), F.col("x") - F.col(f"{e}.cx"), F.col(f"{e}.angle")
    u, v = dx * F.cos(turn) + dy * F.sin(turn), dy * F.cos(turn) - dx * F.sin(turn)
    a, b = F.col(f"{e}.major"), F.col(f"{e}.minor")
    rho = F.hypot(u / a, v / b)
    return (rho - 1) * F.greatest(rho, F.lit(1e-15)) / F.greatest(F.hypot(u / (a * a), v / (b * b)), F.lit(1e-15))


def sound(e: str = "e") -> Column:
    """Whether an ellipse can be a pupil: its middle in the image, half axes from 2 pixels to half the image's larger side."""
    inside = (F.col(f"{e}.cx") >= 0) & (F.col(f"{e}.cx") < F.col("width")) & (F.col(f"{e}.cy") >= 0) & (F.col(f"{e}.cy") < F.col("height"))
    return F.coalesce(inside & (F.col(f"{e}.minor") >= 2) & (F.col(f"{e}.major") <= 0.5 * F.greatest("width", "height")), F.lit(False))


def chords(points: DataFrame, residual: float) -> DataFrame:
    """points with cut: whether one lies on a straight stretch that cuts the shape off, as a lid does.

    Each point counts for the corridors that it lies in, two in each of the directions; the fullest corridor's line is drawn anew through its
    points. It is a chord if it has enough points, runs far enough without a gap and passes the middle at less than the edge's distance."""
    near = max(CHORD["px"], CHORD["residuals"] * residual)
    turn = F.col("_k") * F.lit(np.pi / DIRECTIONS)
    at = F.floor(((F.col("x") - F.col("_cx")) * F.cos(turn) + (F.col("y") - F.col("_cy")) * F.sin(turn)) / near)
    placed = points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(DIRECTIONS - 1)))).withColumn("_b", F.explode(F.array(at, at - 1)))
    full = placed.groupBy(FRAME, "_k", "_b").agg(F.count(F.lit(1)).alias("_n")).groupBy(FRAME).agg(F.max_by(F.struct("_k", "_b"), F.struct("_n", (-F.col("_k")).alias("k"), (-F.col("_b")).alias("b"))).alias("_m")).select(FRAME, F.col("_m._k").alias("_k"), F.col("_m._b").alias("_b"))
    inside = points.join(full, FRAME).where(at.between(F.col("_b"), F.col("_b") + 1))
    line = inside.groupBy(FRAME).agg(F.avg("y").alias("_my"), F.avg("x").alias("_mx"), F.covar_pop("x", "y").alias("_xy"), (F.var_pop("x") - F.var_pop("y")).alias("_d"), F.count(F.lit(1)).alias("_n")).withColumn("_t", F.atan2(2 * F.col("_xy"), F.col("_d")) / 2)
    along = F.col("x") * F.cos("_t") + F.col("y") * F.sin("_t")
    steps = inside.join(line, FRAME).withColumn("_a", along).withColumn("_step", F.col("_a") - F.lag("_a").over(Window.partitionBy(FRAME).orderBy("_a"))).groupBy(FRAME).agg((F.max("_a") - F.min("_a")).alias("_span"), F.max("_step").alias("_gap"))
    across = lambda y, x: (F.col(y) - F.col("_my")) * F.cos("_t") - (F.col(x) - F.col("_mx")) * F.sin("_t")
    all_ = points.join(line.join(steps, FRAME), FRAME, "left").withColumn("_off", across("y", "x"))
    extent = F.max(F.abs(F.col("_off") - across("_cy", "_cx"))).over(Window.partitionBy(FRAME))
    diagonal = F.hypot(F.max("y").over(Window.partitionBy(FRAME)) - F.min("y").over(Window.partitionBy(FRAME)), F.max("x").over(Window.partitionBy(FRAME)) - F.min("x").over(Window.partitionBy(FRAME)))
    lid = (F.col("_n") >= CHORD["points"]) & (F.col("_n") >= CHORD["share"] * F.col("_all")) & (F.col("_span") >= CHORD["span"] * diagonal) & (F.col("_gap") <= CHORD["gap"] * F.col("_span")) & (F.abs(across("_cy", "_cx")) <= CHORD["offset"] * extent)
    return all_.withColumn("cut", F.coalesce(lid & (F.abs("_off") <= CHORD["wide"] * near), F.lit(False))).select(*points.columns, "cut")


def fit_masks(mask: DataFrame, sizes: DataFrame, config: PupilConfig = PupilConfig()) -> DataFrame:
    """(_frame, e, n_on, n_all, residual, chord_fraction, used_ransac): the ellipse through each mask's edge without a lid's chord.

    sizes (_frame, index, height, width). Three rounds leave out what lies three robust deviations off. Where too little of the edge lies on the outcome,
    the best of ellipses through five points drawn at random (by a hash of seed and index) is taken and drawn twice more through the points on it.
    n_on counts points within the residual, residual is their median distance. Frames without an ellipse have no row."""
    edge = edge_points(mask)
    base = edge.groupBy(FRAME).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"), (F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")) / 2 + F.lit(1.0)).alias("_s"), F.count(F.lit(1)).alias("_all")).where(F.col("_all") >= LEAST_POINTS)
    split = written(chords(edge.join(base, FRAME), config.residual_px))
    share = split.groupBy(FRAME).agg(F.avg(F.col("cut").cast("double")).alias("chord_fraction"), F.first("_all").alias("n_all"))
    use = written(split.where(~F.col("cut")).join(sizes, FRAME).withColumns({"_rank": F.row_number().over(Window.partitionBy(FRAME).orderBy("y", "x")) - 1, "_use": F.count(F.lit(1)).over(Window.partitionBy(FRAME))}).where(F.col("_use") >= LEAST_POINTS))

    def near(e: DataFrame) -> DataFrame:
        return use.join(e, FRAME).withColumn("_d", F.abs(off_ellipse()))

    def rated(e: DataFrame, by: list[str]) -> DataFrame:
        on = F.when(F.col("_d") <= config.residual_px, F.col("_d"))
        return near(e).groupBy(*by).agg(F.first("e").alias("e"), F.count(on).alias("n_on"), F.median(on).alias("residual"), *[F.first(c).alias(c) for c in ("height", "width", "_all")])

    def renewed(e: DataFrame, kept: DataFrame, least: int, fit: Column = F.lit(True)) -> DataFrame:
        new = through(kept, [FRAME], least).withColumnRenamed("e", "_new").join(sizes, FRAME).where(fit).select(FRAME, "_new")
        return written(e.join(new, FRAME, "left").select(FRAME, F.coalesce("_new", "e").alias("e")))

    e = written(through(use, [FRAME], 5))
    for _ in range(3):
        d = near(e).withColumn("_m", F.median("_d").over(Window.partitionBy(FRAME))).withColumn("_mad", F.median(F.abs(F.col("_d") - F.col("_m"))).over(Window.partitionBy(FRAME)))
        e = renewed(e, d.where(F.col("_d") <= F.greatest(F.lit(config.residual_px), F.col("_m") + 3 * 1.4826 * F.col("_mad"))), LEAST_POINTS)
    direct = written(rated(e, [FRAME]).where(sound() & (F.col("n_on") >= LEAST_ON * F.col("_all"))))
    doubtful = use.join(direct, FRAME, "left_anti")
    draw = doubtful.select(FRAME, "index", "_use").distinct().withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(config.trials - 1)))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    drawn = draw.select(FRAME, "_c", F.pmod(F.xxhash64(F.lit(config.seed), "index", "_c", "_i"), F.col("_use")).cast("int").alias("_rank")).distinct()
    tried = through(doubtful.join(drawn, [FRAME, "_rank"]), [FRAME, "_c"], 5).join(sizes.select(FRAME, "height", "width"), FRAME).where(sound()).select(FRAME, "_c", "e")
    # medians only of the trials with the most points on them: the others can't win
    on = written(near(written(tried)).where(F.col("_d") <= config.residual_px).groupBy(FRAME, "_c").agg(F.count(F.lit(1)).alias("_on"), F.first("e").alias("e")))
    top = on.join(on.groupBy(FRAME).agg(F.max("_on").alias("_top")), FRAME).where("_on = _top").select(FRAME, "_c", "e")
    best = written(rated(top, [FRAME, "_c"]).groupBy(FRAME).agg(F.max_by("e", F.struct((-F.col("residual")).alias("r"), (-F.col("_c")).alias("c"))).alias("e")))
    for _ in range(2):
        best = renewed(best, near(best).where(F.col("_d") <= config.residual_px), 5, sound("_new"))
    both = direct.withColumn("used_ransac", F.lit(0.0)).unionByName(rated(best, [FRAME]).withColumn("used_ransac", F.lit(1.0)))
    return written(both.where("n_on > 0").select(FRAME, "e", "n_on", "residual", "used_ransac").join(share, FRAME))


def trimmed(mask: DataFrame, fits: DataFrame, config: PupilConfig = PupilConfig()) -> tuple[DataFrame, DataFrame]:
    """(masks (_frame, y, x) of the frames that lose something, (_frame, concavity_fraction)): the largest piece of a mask within a margin of its
    ellipse, without holes, if what goes is a fair share and 20 pixels stay. Other frames are in neither."""
    placed = mask.join(fits.select(FRAME, "e"), FRAME).withColumn("_far", off_ellipse() > F.greatest(F.lit(config.margin_px), config.margin_fraction * F.col("e.major")))
    total = placed.groupBy(FRAME).agg(F.count(F.lit(1)).alias("_all"), F.max("_far").alias("_any")).where("_any").select(FRAME, "_all")
    lab = regions.labelled_runs(placed.where(~F.col("_far")).join(total, FRAME, "left_semi").select(FRAME, "y", "x"), [FRAME], eight=False)
    area = lab.groupBy(FRAME, "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"))
    kept = area.groupBy(FRAME).agg(F.max_by(F.struct("region", "_n"), F.struct("_n", (-F.col("region")).alias("r"))).alias("_m")).select(FRAME, "_m.*").join(total, FRAME).withColumn("concavity_fraction", 1 - F.col("_n") / F.col("_all"))
    fair = written(kept.where(F.col("concavity_fraction").between(config.min_concavity, config.max_concavity) & (F.col("_n") >= 20)))
    return filled(lab.join(fair.select(FRAME, "region"), [FRAME, "region"]).select(FRAME, "y", "x0", "x1")), fair.select(FRAME, "concavity_fraction")


def pupils(frames: DataFrame, keys: list[str], config: PupilConfig = PupilConfig()) -> DataFrame:
    """(keys, index, measures) of frames (keys, index, height, width, pixels): a frame's level and light, and the ellipse of its pupil, fitted
    again without what stands out. A dark frame has no threshold, a frame without a pupil no ellipse: their measures are NULL."""
    index = F.col("index").cast("long")
    named = frames.select(F.struct(*keys, index.alias("index")).alias(FRAME), index.alias("index"), "height", "width", "pixels")
    px = pixel_rows(named, config.roi)
    level = written(levels(px, config))
    sizes = written(named.select(FRAME, "index", "height", "width"))
    mask = bright_masks(px, level)
    first = fit_masks(mask, sizes, config)
    again, lost = trimmed(mask, first, config)
    second = fit_masks(again, sizes, config)
    fits = first.join(lost, FRAME, "left_anti").withColumn("concavity_fraction", F.lit(0.0)).unionByName(second.join(lost, FRAME))
    out = sizes.select(FRAME).join(level, FRAME, "left").join(fits, FRAME, "left")
    lit = F.coalesce(F.col("active"), F.lit(False))
    of = {"active": lit.cast("double"), "threshold": F.when(lit, F.col("threshold")), **{c: F.col(f"e.{c}") for c in FIT}, "area": F.pi() * F.col("e.major") * F.col("e.minor"), "axis_ratio": F.col("e.minor") / F.col("e.major"), "inlier_fraction": F.col("n_on") / F.col("n_all"), "diameter": 2 * F.sqrt(F.col("e.major") * F.col("e.minor"))}
    return out.select(*[F.col(f"{FRAME}.{k}").alias(k) for k in [*keys, "index"]], *[of.get(c, F.col(c)).cast("double").alias(c) for c in FIELDS])
