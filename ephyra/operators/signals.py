"""Breath-like signals: filters, onsets, rates and quality. A session's samples are one ordered series; sessions go side by side.

The kernels on arrays define what is computed; `longseries` computes the same over series of any length, in blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import clock

#: Fixed values of the respiration channel.
FILTER_HZ, SNIFF_HZ, NOISE_HZ, ORDER = (1.0, 50.0), (0.5, 15.0), (20.0, 100.0), 2
THRESHOLD, SMOOTH, RETENTION, MASKED = 5.0, 3, 0.7, 0.2
MEDIAN_S, ENVELOPE_S, ENVELOPE_PCT, EXCURSION, QUALITY_S, QUIET = 0.3, 2.0, 90.0, 0.7, 1.0, 0.2


def butterworth(low: float, high: float, rate: float, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital band-pass by the bilinear transform of the analog prototype's poles."""
    w = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    mid, wide = w[0] * w[1], w[1] - w[0]
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * wide / 2
    root = np.sqrt(poles**2 - mid + 0j)
    p = np.concatenate([poles + root, poles - root])
    fs = 2 * rate
    zp = (fs + p) / (fs - p)
    a = np.real(np.poly(zp))
    b = np.poly(np.concatenate([np.ones(order), -np.ones(order)])).real
    z0 = np.exp(1j * 2 * np.arctan(np.sqrt(mid) / fs))
    gain = abs(np.polyval(b, z0) / np.polyval(a, z0))
    return b / gain, a


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, zi: np.ndarray) -> np.ndarray:
    out, z, n = np.empty_like(x), list(zi), len(b) - 1
    b, a, xs = b.tolist(), a.tolist(), x.tolist()
    for i, v in enumerate(xs):
        y = b[0] * v + z[0]
        for k in range(n - 1):
            z[k] = b[k + 1] * v + z[k + 1] - a[k + 1] * y
        z[n - 1] = b[n] * v - a[n] * y
        out[i] = y
    return out


def bandpass(x: np.ndarray, rate: float, band=FILTER_HZ, order: int = ORDER) -> np.ndarray:
    """A filter run forward and back, so without delay, over the series and an odd reflection at either end."""
    b, a = butterworth(*band, rate, order)
    n = len(b) - 1
    pad = 3 * (n + 1)
    if len(x) <= pad:
        return np.zeros(len(x))
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    zi = np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = _filter(b, a, ext, zi * ext[0])
    return _filter(b, a, y[::-1], zi * y[-1])[::-1][pad:-pad]


def running_median(x: np.ndarray, k: int) -> np.ndarray:
    """The centred median of k (odd) values, the ends repeated, in pieces of bounded size."""
    h = k // 2
    e = np.concatenate([np.full(h, x[0]), x, np.full(h, x[-1])])
    step = max(1, 4_000_000 // k)
    return np.concatenate([np.median(np.lib.stride_tricks.sliding_window_view(e[i : i + step + 2 * h], k), axis=1) for i in range(0, len(x), step)])


def envelope(x: np.ndarray, rate: float, window_s: float = ENVELOPE_S) -> np.ndarray:
    """The 90th percentile of |x| in tiles of at least 8 samples, on lines between the tiles' middles. Quiet tiles count as a
    fifth of the median tile, so that silence is not blown up to breaths."""
    k = max(int(window_s * rate), 8)
    tiles = np.array([np.percentile(np.abs(x[i : i + k]), ENVELOPE_PCT) for i in range(0, len(x), k)])
    return np.interp(np.arange(len(x)), (np.arange(len(tiles)) + 0.5) * k, np.maximum(tiles, QUIET * np.median(tiles)))


def onsets(x: np.ndarray, rate: float, band=SNIFF_HZ, excursion: float = EXCURSION) -> np.ndarray:
    """The last samples at or below 0 before the signal over its envelope rises above it: the first one, and each that comes at least
    one period of the band's top after the last that counted, with a trough deep enough between them. Missing samples lie on lines
    between their neighbours; a flat signal has no onset."""
    fine = np.isfinite(x)
    if fine.sum() < 3:
        return np.zeros(0, np.int64)
    y = x - x[fine].mean()
    y = np.interp(np.arange(len(x)), np.flatnonzero(fine), y[fine])
    y = y - running_median(y, max(int(MEDIAN_S * rate) | 1, 3))
    size = envelope(y, rate)
    y = np.divide(y, size, out=np.zeros(len(y)), where=size > 0)
    up = np.flatnonzero((y[:-1] <= 0) & (y[1:] > 0))
    if len(up) < 2:
        return up
    deep = np.flatnonzero(y <= excursion * min(float(np.percentile(y, 10)), 0.0))
    trough = np.append(deep, -1)[np.searchsorted(deep, up, "right") - 1]  # the last deep sample up to each rise
    out = [int(up[0])]
    for at, low in zip(up[1:].tolist(), trough[1:].tolist()):
        if at - out[-1] >= rate / band[1] and low > out[-1]:
            out.append(at)
    return np.array(out, np.int64)


def band_quality(x: np.ndarray, rate: float, window_s: float = QUALITY_S, band=SNIFF_HZ, noise=NOISE_HZ) -> np.ndarray:
    """The mean power in the breath band over that in the noise band, in tiles under a Hann window; 0 without noise."""
    k = int(round(window_s * rate))
    if k < 8:
        raise ValueError(f"a window of {window_s} s has fewer than 8 samples at {rate} Hz")
    if len(x) < k:
        return np.zeros(0)
    t = x[: len(x) // k * k].reshape(-1, k)
    p = np.abs(np.fft.rfft((t - t.mean(axis=1, keepdims=True)) * np.hanning(k), axis=1)) ** 2
    f = np.fft.rfftfreq(k, 1 / rate)
    mean = lambda lo, hi: p[:, (f >= lo) & (f <= hi)].mean(axis=1) if ((f >= lo) & (f <= hi)).any() else np.zeros(len(p))
    s, n = mean(*band), mean(*noise)
    return np.where(n > 0, s / np.where(n > 0, n, 1), 0.0)


def filtered(samples: DataFrame, keys: list[str], order: str, value: str, rate: float, band=FILTER_HZ) -> DataFrame:
    """(keys, order, value) after the band-pass."""
    from . import longseries

    return longseries.bandpassed(samples, keys, order, value, rate, band).select(*keys, order, value)


def inhalations(samples: DataFrame, keys: list[str], order: str, value: str, rate: float) -> DataFrame:
    """(keys, sample): onsets of the filtered signal."""
    from . import longseries

    return longseries.inhalations(samples, keys, order, value, rate)


def quality(samples: DataFrame, keys: list[str], order: str, value: str, rate: float) -> DataFrame:
    """(keys, tile, score)."""
    from . import longseries

    return longseries.quality(samples, keys, order, value, rate)


def tile_lines(at: DataFrame, scores: DataFrame, keys: list[str], place: str, width: float, name: str = "quality") -> DataFrame:
    """at with the score on the line between the middles of the tiles (keys, tile, score) around it; NULL before the first middle and
    after the last. width: a tile's in units of `place`."""
    held = scores.select(*keys, F.col("tile").alias("_tile"), F.col("score").alias("_a"), F.lead("score").over(Window.partitionBy(*keys).orderBy("tile")).alias("_z"))
    where = F.col(place) / F.lit(float(width)) - 0.5
    share = where - F.col("_tile")
    line = F.when(share == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_z") - F.col("_a")) * share)
    return at.withColumn("_tile", F.floor(where).cast("long")).join(held, [*keys, "_tile"], "left").withColumn(name, line).drop("_tile", "_a", "_z")


def breath_rates(onsets: DataFrame, scores: DataFrame, at: DataFrame, keys: list[str], place: str, per: float, width: float, threshold: float = THRESHOLD, smooth: int = SMOOTH) -> DataFrame:
    """at (keys, place) with `frequency`, `unmasked` (its median over `smooth` breaths), `quality`, and `frequency_masked` and `rate`, the
    two where the quality reaches the threshold.

    onsets (keys, place) in the same units as `at`, of which `per` are a second; scores (keys, tile, score) in tiles of `width`. A rate holds
    from the onset that begins its interval until the next one, the last beyond its end; it is NULL before the first onset and for
    intervals outside the breath band. A series with fewer than two onsets has neither rates nor quality."""
    r = clock.step_rate(onsets, keys, place, *SNIFF_HZ, per=per)
    r = clock.rolling_median(r, keys, [place], "rate", smooth, "unmasked").withColumnRenamed("rate", "frequency")
    held = clock.asof(at, r, keys, place, ["frequency", "unmasked"]).drop("at_right")
    breathing = r.select(*keys).distinct().withColumn("_breathes", F.lit(True))
    lined = tile_lines(held, scores, keys, place, width).join(breathing, keys, "left")
    good = F.col("quality") >= threshold
    return lined.withColumn("quality", F.when(F.col("_breathes"), F.col("quality"))).drop("_breathes").withColumns({"frequency_masked": F.when(good, F.col("frequency")), "rate": F.when(good, F.col("unmasked"))})


def breath_report(onsets: DataFrame, scores: DataFrame, rated: DataFrame, keys: list[str], threshold: float = THRESHOLD, least: float = RETENTION) -> DataFrame:
    """(keys, n_breaths, median_hz, fraction_good, flags) of each series with onsets, scores or rated rows (`breath_rates`): flags say that
    too few tiles reach the threshold, or that there is no onset at all."""
    n = onsets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    good = scores.groupBy(*keys).agg(F.avg((F.col("score") >= threshold).cast("double")).alias("_g"))
    mid = rated.groupBy(*keys).agg(F.median("frequency").alias("median_hz"))
    breaths = F.coalesce(F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(0))
    share = F.when(breaths > 0, F.col("_g")).otherwise(0.0)
    few = F.concat(F.lit("only "), F.format_string("%.0f%%", 100 * F.col("fraction_good")), F.lit(f" of the windows reach a ratio of {threshold:g} (at least {least:.0%} are needed): the masked rate rests on these alone, and the recording's rate isn't to be used"))
    flags = F.when(F.col("n_breaths") == 0, F.array(F.lit("no onset was found: the channel held no respiration"))).when(F.col("fraction_good") < least, F.array(few)).otherwise(F.array().cast("array<string>"))
    both = n.join(good, keys, "full").join(mid, keys, "full")
    return both.select(*keys, breaths.cast("long").alias("n_breaths"), "median_hz", share.alias("fraction_good")).withColumn("flags", flags)


def instantaneous_rate(samples: DataFrame, keys: list[str], order: str, value: str, rate: float, at: DataFrame, threshold: float = THRESHOLD, smooth: int = SMOOTH) -> DataFrame:
    """at (keys, sample) with the columns of `breath_rates`, from the onsets and the quality of the samples."""
    return breath_rates(inhalations(samples, keys, order, value, rate), quality(samples, keys, order, value, rate), at, keys, "sample", rate, QUALITY_S * rate, threshold, smooth)


def quality_report(scores: DataFrame, keys: list[str], thresholds=(0.1, 0.2, 0.25, 0.3, 0.4, 0.5)) -> DataFrame:
    """(keys, threshold, percent) of tiles that reach each threshold."""
    aggs = [F.struct(F.lit(t).alias("threshold"), (100 * F.avg((F.col("score") >= t).cast("double"))).alias("percent")).alias(f"_{i}") for i, t in enumerate(thresholds)]
    return scores.groupBy(*keys).agg(*aggs).select(*keys, F.explode(F.array(*[f"_{i}" for i in range(len(thresholds))])).alias("_t")).select(*keys, "_t.*")


def tile_envelope(samples: DataFrame, keys: list[str], at: str, value: str, width: int, q: float = ENVELOPE_PCT / 100) -> DataFrame:
    """(keys, tile, n, envelope): a percentile of |value| in tiles of `width` along `at`."""
    return samples.groupBy(*keys, F.floor(F.col(at) / width).cast("long").alias("tile")).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.abs(F.col(value)), q).alias("envelope"))


def trial_frames(rates: DataFrame, keys: list[str], trial: str, most: float = 0.2) -> DataFrame:
    """(keys, trial, masked_fraction, flagged)."""
    return rates.groupBy(*keys, trial).agg(F.avg(F.col("rate").isNull().cast("double")).alias("masked_fraction")).withColumn("flagged", F.col("masked_fraction") > most)
