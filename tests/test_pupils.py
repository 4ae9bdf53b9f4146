"""Pupils by joins and sums against floods of single images and known ellipses."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ephyra.functions import images
from ephyra.operators import frames, pupils


def disk(shape, cy, cx, ry, rx):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    return ((yy - cy) / ry) ** 2 + ((xx - cx) / rx) ** 2 <= 1


def seen(spark, frames_):
    """Frames (key, index, array) as rows."""
    rows = [(k, i, *f.shape, bytearray(f.astype(np.uint8).tobytes())) for k, i, f in frames_]
    return spark.createDataFrame(rows, "k string, index long, height int, width int, pixels binary")


@pytest.fixture(scope="module")
def eyes(spark):
    """One run over frames of many kinds."""
    shape = (120, 140)
    lit = lambda m: np.where(m, 200, 20)
    full = disk(shape, 60, 70, 24, 35)
    clipped, hole, tail, corner = full.copy(), full.copy(), disk(shape, 60, 65, 25, 35), disk(shape, 60, 65, 25, 35)
    clipped[:54], hole[55:65, 65:75], tail[55:66, 95:125], corner[30:33, 60:64] = False, False, True, True
    two = lit(full)
    two[5:10, 5:10] = 120  # a second piece, dimmer and small
    kinds = {"full": lit(full), "clipped": lit(clipped), "hole": lit(hole), "tail": lit(tail), "corner": lit(corner), "two": two, "dark": np.full((40, 50), 42), "plain": np.full((9, 9), 90), "dot": lit(disk((30, 30), 15, 15, 1, 1)), "tilted": lit(tilted(shape, 60, 70, 20, 36, 0.6))}
    rows = [(k, 0, f) for k, f in kinds.items()] + [(None, 0, kinds["full"]), ("full", 1, kinds["full"])]
    return {(r["k"], r["index"]): r for r in pupils.pupils(seen(spark, rows), ["k"]).collect()}


def tilted(shape, cy, cx, ry, rx, turn):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    u, v = (xx - cx) * np.cos(turn) + (yy - cy) * np.sin(turn), (yy - cy) * np.cos(turn) - (xx - cx) * np.sin(turn)
    return (u / rx) ** 2 + (v / ry) ** 2 <= 1


def test_ellipses_of_pupils(eyes):
    e = eyes["full", 0]
    assert abs(e["cy"] - 60) < 1 and abs(e["cx"] - 70) < 1 and abs(e["major"] - 35) < 1.5 and abs(e["minor"] - 24) < 1.5
    assert e["area"] == pytest.approx(math.pi * e["major"] * e["minor"]) and e["residual"] < 1 and e["used_ransac"] == 0 and e["concavity_fraction"] == 0
    assert e["diameter"] == pytest.approx(2 * math.sqrt(e["major"] * e["minor"])) and e["axis_ratio"] == pytest.approx(e["minor"] / e["major"])
    assert e["inlier_fraction"] + e["chord_fraction"] == pytest.approx(1, abs=0.02)
    t = eyes["tilted", 0]
    assert abs(t["angle"] - 0.6) < 0.05 and abs(t["major"] - 36) < 1.5 and abs(t["minor"] - 20) < 1.5
    c = eyes["clipped", 0]
    assert c["inlier_fraction"] < 0.9 and c["chord_fraction"] >= 0.16  # of the whole boundary, the lid's edge too
    assert abs(c["cy"] - 60) < 4 and abs(c["cx"] - 70) < 3 and abs(c["major"] - 35) < 5 and abs(c["minor"] - 24) < 5
    for same in (("hole", 0), ("two", 0), (None, 0), ("full", 1)):  # holes are filled, other pieces don't count, a NULL key is a key
        assert all(eyes[same][f] == pytest.approx(e[f]) for f in ("cy", "cx", "major", "minor", "residual"))


def test_protrusions_and_frames_without_a_pupil(eyes):
    assert 0.02 <= eyes["tail", 0]["concavity_fraction"] <= 0.2 and abs(eyes["tail", 0]["cx"] - 65) < 2 and abs(eyes["tail", 0]["major"] - 35) < 2
    assert eyes["corner", 0]["concavity_fraction"] == 0
    dark, plain, dot = eyes["dark", 0], eyes["plain", 0], eyes["dot", 0]
    assert dark["peak"] == 42 and dark["active"] == 0 and dark["threshold"] is None and dark["diameter"] is None
    assert plain["active"] == 1 and plain["threshold"] == 0 and plain["diameter"] is None
    assert dot["active"] == 0 or dot["diameter"] is None  # five pixels have no ellipse


def masks_by_hand(f, roi=None):
    """The bright piece by flooding one image: labels, the core's pixels, holes."""
    y0, y1, x0, x1 = roi or (0, f.shape[0], 0, f.shape[1])
    part, out = f[y0:y1, x0:x1], np.zeros(f.shape, bool)
    best = max(range(256), key=lambda t: ((lo := part[part <= t]).size and (hi := part[part > t]).size and lo.size * hi.size * (lo.mean() - hi.mean()) ** 2) or 0)
    if np.percentile(part, 99) - np.percentile(part, 10) < 5 or np.percentile(part, 99.9) < 60:
        return out
    lab, n = images.label(part > best)
    core = np.bincount(lab[part >= max(best, np.percentile(part, 97))], minlength=n + 1)[1:]
    out[y0:y1, x0:x1] = images.fill_holes(lab == 1 + core.argmax())
    return out


@pytest.mark.parametrize("roi", [None, (4, 22, 2, 27)])
def test_masks_equal_a_flood_of_each_image(spark, roi):
    rng = np.random.default_rng(3)
    kinds = [np.kron(rng.integers(0, 255, (8, 10)), np.ones((3, 3))).astype(int) for _ in range(6)] + [rng.integers(0, 255, (24, 30)) for _ in range(3)]
    df = seen(spark, [("a", i, f) for i, f in enumerate(kinds)]).select(F.struct("k", "index").alias("_frame"), "height", "width", "pixels")
    px = pupils.pixel_rows(df, roi)
    got = [np.zeros(f.shape, bool) for f in kinds]
    for r in pupils.bright_masks(px, pupils.levels(px)).collect():
        got[r["_frame"]["index"]][r["y"], r["x"]] = True
    assert all((g == masks_by_hand(f, roi)).all() for g, f in zip(got, kinds))
    level = {r["_frame"]["index"]: r for r in pupils.levels(px).collect()}
    y0, y1, x0, x1 = roi or (0, 24, 0, 30)
    assert all(level[i]["peak"] == pytest.approx(np.percentile(f[y0:y1, x0:x1], 99.9)) for i, f in enumerate(kinds))


def test_sums_give_the_ellipse_of_the_points():
    turn = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b, t, cy, cx = *sorted(rng.uniform(0.2, 0.9, 2), reverse=True), rng.uniform(0, np.pi), *rng.uniform(-0.3, 0.3, 2)
        x, y = cx + a * np.cos(turn) * np.cos(t) - b * np.sin(turn) * np.sin(t), cy + a * np.cos(turn) * np.sin(t) + b * np.sin(turn) * np.cos(t)
        got = pupils._ellipse_of_sums(pd.Series([[np.sum(x**i * y**j) for i, j in pupils.POWERS], [0.0] * 15]))
        assert np.allclose(got.iloc[0, :4], [cy, cx, a, b], atol=1e-6) and min(abs(got["angle"][0] - t), np.pi - abs(got["angle"][0] - t)) < 1e-5
        assert got.iloc[1].isna().all()


def test_a_vote_finds_the_ellipse_among_strays(spark):
    """Half of the edge lies on no ellipse: a direct fit fails, the vote doesn't."""
    shape, turn = (120, 140), np.linspace(0, 2 * np.pi, 90, endpoint=False)
    rng = np.random.default_rng(1)
    ring = {(int(round(60 + 24 * np.sin(a))), int(round(70 + 33 * np.cos(a)))) for a in turn}
    stray = {(int(y), int(x)) for y, x in zip(rng.integers(0, 120, 70), rng.integers(0, 140, 70))}
    mask = spark.createDataFrame([((("a", 7),) + p) for p in sorted(ring | stray)], "_frame struct<k:string,index:long>, y int, x int")
    sizes = spark.createDataFrame([(("a", 7), 7, *shape)], "_frame struct<k:string,index:long>, index long, height int, width int")
    got = pupils.fit_masks(mask, sizes).collect()
    assert len(got) == 1 and got[0]["used_ransac"] == 1
    e = got[0]["e"]
    assert abs(e["cy"] - 60) < 2 and abs(e["cx"] - 70) < 2 and abs(e["major"] - 33) < 2.5 and abs(e["minor"] - 24) < 2.5
    assert pupils.fit_masks(mask.where("false"), sizes).count() == 0


def test_pupil_frames(spark):
    eye = np.where(disk((80, 80), 40, 40, 15, 20), 200, 20)
    rows = [("v", i, eye) for i in range(4)] + [("v", 4, np.full((40, 50), 42))]
    got = frames.classify(pupils.pupils(seen(spark, rows), ["k"]), ["k"], "index").orderBy("index").collect()
    assert [r["blink"] for r in got] == [False] * 5 and [r["clipped"] for r in got] == [False] * 4 + [True] and abs(got[0]["diameter"] - 2 * math.sqrt(300)) < 2
    assert pupils.pupils(seen(spark, rows).where("false"), ["k"]).count() == 0
