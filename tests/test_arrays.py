"""Stacks, bundles and staged files against files that the tests build byte by byte or with NumPy."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ephyra.sources import arrays, staging


def classic(path, images, order="<", deflate=False, strip_rows=None, description=None):
    """A classic TIFF file of 16-bit images in strips, directories after their images."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for im in images:
        h, w = im.shape
        rows, offsets, counts = strip_rows or h, [], []
        for y in range(0, h, rows):
            raw = im[y : y + rows].astype(order + "u2").tobytes()
            raw = zlib.compress(raw) if deflate else raw
            offsets.append(len(out)), counts.append(len(raw))
            out += raw + bytes(len(raw) % 2)
        lists = len(out)
        if len(offsets) > 1:
            out += struct.pack(f"{order}{2 * len(offsets)}I", *offsets, *counts)
        text = (description or "").encode() + b"\0"
        at_text = len(out)
        out += text + bytes(len(text) % 2)
        n, many = len(offsets), len(offsets) > 1
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16), (259, 3, 1, 8 if deflate else 1), (273, 4, n, lists if many else offsets[0]), (278, 4, 1, rows), (279, 4, n, lists + 4 * n if many else counts[0])]
        if description and len(text) > 4:
            tags.append((270, 2, len(text), at_text))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag, kind, count, v in sorted(tags):
            out += struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
        link = len(out)
        out += struct.pack(order + "I", 0)
    path.write_bytes(bytes(out))


def read(df):
    held = {}
    for r in df.collect():
        held.setdefault((r.file, r.frame), {})[r.y] = r.v
    return {k: np.array([lines[y] for y in sorted(lines)]) for k, lines in held.items()}


@pytest.mark.parametrize("order, deflate, rows", [("<", False, None), (">", False, 2), ("<", True, 3), (">", True, None)])
def test_stack_of_either_order_in_strips(spark, tmp_path, order, deflate, rows):
    images = np.random.default_rng(0).integers(0, 65536, (7, 5, 4))
    classic(tmp_path / "a.tif", images, order, deflate, rows)
    got = read(arrays.stacks(spark, str(tmp_path), frames=3))
    assert len(got) == 7 and all(np.array_equal(got["a.tif", i], images[i]) for i in range(7))


def test_frames_without_directories_of_their_own(spark, tmp_path):
    images = np.random.default_rng(1).integers(0, 65536, (5, 3, 4))
    classic(tmp_path / "a.tif", images[:1], description="ImageJ=1.53\nimages=5\n")
    whole = (tmp_path / "a.tif").read_bytes()
    # the images that follow the first one directly: its strip is moved to the end of the file
    moved = bytearray(whole + images.astype("<u2").tobytes())
    at = whole.index(struct.pack("<HHI", 273, 4, 1))
    struct.pack_into("<I", moved, at + 8, len(whole))
    (tmp_path / "a.tif").write_bytes(bytes(moved))
    got = read(arrays.stacks(spark, str(tmp_path / "a.tif"), frames=2))
    assert sorted(f for _, f in got) == [0, 1, 2, 3, 4] and all(np.array_equal(got["a.tif", i], images[i]) for i in range(5))
    assert [f for _, f in sorted(read(arrays.stacks(spark, str(tmp_path)).where("frame > 2")))] == [3, 4]


def test_filters_prune_partitions(spark, tmp_path):
    for name in "ab":
        classic(tmp_path / f"{name}.tif", np.arange(40 * 4).reshape(40, 2, 2))
    df = arrays.stacks(spark, str(tmp_path), frames=10)
    assert df.rdd.getNumPartitions() == 8
    assert df.where("frame >= 10 and frame < 20").rdd.getNumPartitions() == 2
    assert df.where("file = 'b.tif' and frame = 7").rdd.getNumPartitions() == 1
    some = df.where("frame in (3, 25) and v[0] > 0 and file <> 'a.tif'")
    assert sorted((r.file, r.frame, r.y) for r in some.collect()) == [("b.tif", f, y) for f in (3, 25) for y in (0, 1)]
    assert df.where("frame > 5 and frame < 3").count() == 0 and df.where("frame > 99").count() == 0 and df.where("file = 'c.tif'").count() == 0
    assert df.where("frame is null").count() == 0 and df.where("frame = 3 or file = 'a.tif'").count() == 2 * 40 + 2


def test_broken_and_foreign_stacks_are_errors(spark, tmp_path):
    classic(tmp_path / "a.tif", np.ones((3, 4, 4)))
    raw = (tmp_path / "a.tif").read_bytes()
    (tmp_path / "b.tif").write_bytes(raw[:-60])
    (tmp_path / "c.tif").write_bytes(b"no image at all, whatever it is named")
    for name in ("b.tif", "c.tif"):
        with pytest.raises(Exception):
            arrays.stacks(spark, str(tmp_path / name)).count()
    (tmp_path / "none").mkdir()
    assert arrays.stacks(spark, str(tmp_path / "none")).count() == 0


def cube(spark, shapes):
    """Lines of stacks by name: pixel values are frame * 100 + y * 10 + x."""
    rows = [(f, t, y, [float(t * 100 + y * 10 + x) for x in range(w)]) for f, (n, h, w) in shapes.items() for t in range(n) for y in range(h)]
    return spark.createDataFrame(rows, "file string, frame long, y int, v array<double>")


@pytest.mark.parametrize("sample", ["float32", "float64", "uint16", "int32"])
def test_written_stacks_are_read_back(spark, tmp_path, sample):
    df = cube(spark, {"a.tif": (5, 3, 4), "sub/b.tif": (1, 1, 1), "c.tiff": (2, 7, 3)})
    arrays.write_stacks(df.orderBy(F.rand(3)), str(tmp_path / "out"), sample)
    back = arrays.stacks(spark, str(tmp_path / "out"), frames=2)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, arrays.lines(arrays.pixels(back)).collect())) == sorted(map(tuple, df.collect()))
    assert not list((tmp_path / "out/_parts").iterdir())


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    arrays.write_stacks(cube(spark, {"a.tif": (2, 2, 2)}), path)
    before = (tmp_path / "out/a.tif").read_bytes()
    good = cube(spark, {"a.tif": (3, 2, 2), "b.tif": (3, 2, 2)})
    bad = {
        "gap": good.where("not (file = 'b.tif' and frame = 1)"), "line": good.where("not (file = 'b.tif' and frame = 1 and y = 0)"), "null": good.withColumn("v", F.when(F.col("file") == "b.tif", F.array(F.lit(None).cast("double"))).otherwise(F.col("v"))),
        "shape": good.withColumn("v", F.when(F.col("frame") == 2, F.slice("v", 1, 1)).otherwise(F.col("v"))), "name": good.withColumn("file", F.lit("x.png")), "there": good,
    }
    for df in bad.values():
        with pytest.raises(Exception):
            arrays.write_stacks(df, path)
        assert (tmp_path / "out/a.tif").read_bytes() == before and not (tmp_path / "out/b.tif").exists()
    with pytest.raises(Exception):
        arrays.write_stacks(cube(spark, {"c.tif": (700, 1, 2)}), path, "uint16")
    arrays.write_stacks(cube(spark, {"b.tif": (1, 2, 2)}), path, mode="overwrite")
    assert [r.file for r in arrays.stacks(spark, path).select("file").distinct().collect()] == ["b.tif"]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_bundles(spark, tmp_path, save):
    held = {"a": np.random.default_rng(2).normal(size=(3, 5, 2)), "b": np.arange(1000, dtype="int16"), "flag": np.array([True, False]), "one": np.float32(2.5), "none": np.zeros((0, 4))}
    save(tmp_path / "x.npz", **held)
    df = arrays.bundles(spark, str(tmp_path), values=7)
    for name, want in held.items():
        rows = sorted(df.where(F.col("member") == name).collect(), key=lambda r: r.start)
        assert np.array_equal([v for r in rows for v in r.v], np.ravel(want)) and tuple(rows[0].shape) == np.shape(want)
    got = {tuple(r["at"]): r["v"] for r in arrays.cells(df.where("member = 'a'")).collect()}
    assert got == {i: held["a"][i] for i in np.ndindex(3, 5, 2)}
    if save is np.savez:
        big = arrays.bundles(spark, str(tmp_path), values=2)
        assert big.where("member = 'b'").rdd.getNumPartitions() == -(-1000 // 128) and big.where("file = 'no.npz'").count() == 0
    save(tmp_path / "x.npz", o=np.array([{}], dtype=object))
    with pytest.raises(Exception):
        arrays.bundles(spark, str(tmp_path)).count()


def test_staging_resumes(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    for name in ("a.mp4", "sub/b.mp4", "c.mp4"):
        (source / name).write_bytes(np.random.default_rng(len(name)).bytes(70_000))
    (source / "note.txt").write_text("x")
    files = staging.found(spark, str(source), "*.mp4")
    assert sorted(r.name for r in files.collect()) == ["a.mp4", "c.mp4", "sub/b.mp4"]

    def run():
        return {r.name: r for r in staging.stage(staging.found(spark, str(source), "*.mp4"), str(target)).collect()}

    first = run()
    assert {r.status for r in first.values()} == {"absent"} and (target / "sub/b.mp4").read_bytes() == (source / "sub/b.mp4").read_bytes()
    times = {n: (target / n).stat().st_mtime_ns for n in first}
    # a run that broke off: one file without a record, one record that is cut short, one part of a copy
    (target / "a.mp4.source.json").unlink()
    (target / "sub/b.mp4.source.json").write_text('{"source": ')
    (target / "a.mp4.0.part").write_bytes(b"half")
    second = run()
    assert {n: r.status for n, r in second.items()} == {"a.mp4": "stale", "sub/b.mp4": "stale", "c.mp4": "hit"}
    assert {n: r.sha256 for n, r in second.items()} == {n: r.sha256 for n, r in first.items()} and (target / "c.mp4").stat().st_mtime_ns == times["c.mp4"]
    (source / "a.mp4").write_bytes(b"another recording")
    third = run()
    assert {n: r.status for n, r in third.items()} == {"a.mp4": "stale", "sub/b.mp4": "hit", "c.mp4": "hit"}
    assert json.loads((target / "a.mp4.source.json").read_text())["size"] == 17
    manifest = staging.stage(staging.found(spark, str(source), "*.mp4"), str(target))
    (target / "sub/b.mp4").write_bytes(bytes(70_000))
    assert {r.name: r.whole for r in staging.verified(manifest).collect()} == {"a.mp4": True, "sub/b.mp4": False, "c.mp4": True}


def test_staging_of_nothing_and_of_two_of_a_name(spark, tmp_path):
    schema = "source string, name string, size long, modified_us long"
    assert staging.stage(spark.createDataFrame([], schema), str(tmp_path)).count() == 0
    assert staging.stage(spark.createDataFrame([(None, "a", 1, 1)], schema), str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        staging.stage(spark.createDataFrame([("/x/a", "a", 1, 1), ("/y/a", "a", 1, 1)], schema), str(tmp_path))
    (tmp_path / "s").write_bytes(b"12")
    (tmp_path / "e").write_bytes(b"")
    empty = staging.stage(spark.createDataFrame([(str(tmp_path / "e"), "e", 0, 1)], schema), str(tmp_path / "t"))
    assert [(r.status, r.size) for r in empty.collect()] == [("absent", 0)] and (tmp_path / "t/e").read_bytes() == b""
    with pytest.raises(Exception):
        staging.stage(spark.createDataFrame([(str(tmp_path / "s"), "a", 3, 1)], schema), str(tmp_path / "t")).count()
    assert not (tmp_path / "t/a").exists()


def test_remote_paths():
    assert all(map(staging.is_remote, ["/Volumes/lab/x.db", "\\\\host\\x.db", "s3://b/x.db"])) and not any(map(staging.is_remote, ["/home/x.db", "file:/x.db", "x.db"]))
