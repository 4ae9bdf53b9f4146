"""Eye frames: bright pupils, ellipses, blinks. A frame is one row (key, index, height, width, pixels as bytes); frames are worked on
one by one, in any order, in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import images
from ..functions.columns import safe_ratio


@dataclass(frozen=True)
class PupilConfig:
    """roi: (y0, y1, x0, x1). Fixed values are the defaults."""

    roi: tuple[int, int, int, int] | None = None
    bright_percentile: float = 97.0
    threshold_offset: float = 0.0
    least_contrast: float = 5.0
    residual_px: float = 2.0
    trials: int = 200
    margin_px: float = 6.0
    margin_fraction: float = 0.06
    min_concavity: float = 0.02
    max_concavity: float = 0.20
    dark_peak: float = 60.0
    least_inliers: float = 0.55
    max_residual_px: float = 3.0
    axis_ratio: float = 0.25
    collapse_fraction: float = 0.25
    max_rate_px_s: float = 150.0
    max_bad_fraction: float = 0.20
    seed: int = 0

    def part(self, frame: np.ndarray) -> tuple[slice, slice]:
        y0, y1, x0, x1 = self.roi or (0, frame.shape[0], 0, frame.shape[1])
        return slice(y0, y1), slice(x0, x1)


def segment_bright(frame: np.ndarray, config: PupilConfig = PupilConfig()) -> tuple[np.ndarray, float]:
    """(mask, threshold) of the bright pupil: of the parts (4 neighbours) above the threshold between dark and bright the one with the
    most of the very brightest pixels, holes filled. A frame without contrast has none."""
    out, at = np.zeros(frame.shape, bool), config.part(frame)
    part = frame[at]
    if not part.size:
        return out, float("nan")
    threshold = float(np.clip(images.level(part) + config.threshold_offset, 0, 255))
    if np.percentile(part, 99) - np.percentile(part, 10) < config.least_contrast:
        return out, threshold
    lab, n = images.label(part > threshold)
    bright = np.bincount(lab[part >= max(threshold, float(np.percentile(part, config.bright_percentile)))].ravel(), minlength=n + 1)[1:]
    if n and bright.any():
        out[at] = images.fill_holes(lab == 1 + int(np.argmax(bright)))
    return out, threshold


FIELDS = ["peak", "threshold", "active", "cy", "cx", "major", "minor", "angle", "area", "axis_ratio", "residual", "inlier_fraction", "chord_fraction", "concavity_fraction", "used_ransac", "diameter"]


def analyze(frame: np.ndarray, index: int, config: PupilConfig = PupilConfig()) -> dict:
    """A frame's pupil: the ellipse through its mask, fitted again without what stands out. active: whether the light is on; a dark
    frame has no pupil. The seed follows the frame's index, so that a frame gives the same wherever it is worked on."""
    part = frame[config.part(frame)]
    peak = float(np.percentile(part, 99.9)) if part.size else float("nan")
    out = dict.fromkeys(FIELDS, float("nan")) | {"peak": peak, "active": 0.0}
    if not part.size or peak < config.dark_peak:
        return out
    mask, threshold = segment_bright(frame, config)
    out |= {"active": 1.0, "threshold": threshold}
    e = images.fit_ellipse(mask, config.residual_px, config.trials, config.seed + index)
    trimmed, removed = images.trim_protrusions(mask, e, config.margin_px, config.margin_fraction, config.min_concavity, config.max_concavity)
    if removed:
        e = images.fit_ellipse(trimmed, config.residual_px, config.trials, config.seed + index)
    return out | (e | {"concavity_fraction": removed} if e else {})


def pupils(frames: DataFrame, keys: list[str], config: PupilConfig = PupilConfig()) -> DataFrame:
    """(keys, index, measures) of frames (keys, index, height, width, pixels); NaN becomes NULL."""
    schema = ", ".join([*[f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys], "index long", *[f"{f} double" for f in FIELDS]])

    def run(batches):
        for pdf in batches:
            rows = [analyze(np.frombuffer(p, np.uint8).reshape(h, w), int(i), config) for p, h, w, i in zip(pdf["pixels"], pdf["height"], pdf["width"], pdf["index"])]
            out = pd.DataFrame(rows, columns=FIELDS)
            yield pd.concat([pdf[[*keys, "index"]].reset_index(drop=True), out], axis=1)

    got = frames.select(*keys, F.col("index").cast("long"), "height", "width", "pixels").mapInPandas(run, schema)
    return got.withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in FIELDS})


def classify(measures: DataFrame, keys: list[str], order: str, config: PupilConfig = PupilConfig(), seconds: str | None = None, active: str | None = None, period: float = 1.0) -> DataFrame:
    """measures with rate (pixels a second), blink and clipped. seconds: the camera's time of each frame (by default its order).
    period: the seconds that its unit stands for, so that whole numbers of frames keep a jump free of a clock's rounding.
    A collapse (a quarter of the median area, or a very long ellipse), a bad fit (few inliers, a large residual or none) and a
    jump (the diameter's rate): two of them make a blink; a bad fit without a blink is a clipped pupil. Frames that are not
    active are neither."""
    w, last = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    yes = lambda c: F.coalesce(c, F.lit(False))
    at = F.col(seconds or order)
    rate = safe_ratio(F.abs(F.col("diameter") - F.lag("diameter").over(last)), (at - F.lag(at).over(last)) * F.lit(period))
    collapse = yes(F.col("area") < config.collapse_fraction * F.median("area").over(w)) | yes(F.col("axis_ratio") < config.axis_ratio)
    bad = F.col("diameter").isNull() | yes(F.col("inlier_fraction") < config.least_inliers) | yes(F.col("residual") > config.max_residual_px)
    on = F.lit(True) if active is None else yes(F.col(active).cast("boolean"))
    m = measures.withColumns({"rate": rate, "_bad": bad & on, "_n": collapse.cast("int") + bad.cast("int") + yes(rate > config.max_rate_px_s).cast("int"), "_on": on})
    return m.withColumn("blink", F.col("_on") & (F.col("_n") >= 2)).withColumn("clipped", F.col("_bad") & ~F.col("blink")).drop("_bad", "_n", "_on")
