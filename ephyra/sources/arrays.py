"""Files of arrays as Spark data sources: stacks of images (TIFF) and bundles of arrays (NPZ), read in ranges; and a sink for stacks.

Paths are local ones or URIs that pyarrow's file systems open. Only the directory of a stack is read while a query is planned, and only up to
the last frame that its filters ask for; a task reads the bytes of its own frames.
"""

from __future__ import annotations

import io
import math
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

#: Frames and values in one partition or row, where an option doesn't say otherwise.
FRAMES, VALUES = 256, 65_536

# Fixed values of the file format: tags, bytes of a field by its type, compressions, and kinds of samples.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, PREDICTOR, TILE, KIND = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 317, 322, 339
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
PLAIN, DEFLATE = 1, (8, 32946)
KINDS = {1: "u", 2: "i", 3: "f"}


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _below(path: str, suffixes: tuple[str, ...]) -> dict[str, str]:
    """Path by name of the files at or below path; a name is relative to path."""
    fs, root = located(path)
    info = fs.get_file_info(root)
    if info.type == pa.fs.FileType.File:
        return {info.base_name: root}
    found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
    return {f.path.removeprefix(root.rstrip("/") + "/"): f.path for f in sorted(found, key=lambda f: f.path) if f.type == pa.fs.FileType.File and f.path.lower().endswith(suffixes)}


@dataclass
class Page:
    """What a directory says of its image."""

    shape: tuple[int, int]
    dtype: np.dtype
    compression: int
    strips: list[tuple[int, int]]
    strip_rows: int


class Stack:
    """The directories of one open TIFF file, of either byte order, classic or big."""

    def __init__(self, f):
        self.f = f
        head = self._at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{self.order}H", head[2:4])[0] if self.order else 0
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = version == 43
        self.word, self.first = ("Q", self._one("Q", 8)) if self.big else ("I", self._one("I", 4))

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _one(self, kind: str, at: int) -> int:
        return struct.unpack(self.order + kind, self._at(at, struct.calcsize(self.order + kind)))[0]

    def directory(self, at: int) -> tuple[list[tuple[int, int, int, int]], int]:
        """([(tag, type, count, place of the value's field)], the next directory or 0)."""
        kind, entry = ("Q", "HHQ") if self.big else ("H", "HHI")
        start, field = at + struct.calcsize(self.order + kind), struct.calcsize(self.order + entry)
        n, step = self._one(kind, at), field + (8 if self.big else 4)
        raw = self._at(start, n * step + struct.calcsize(self.order + self.word))
        if len(raw) < n * step:
            raise ValueError("the file ends inside a directory")
        tags = [(*struct.unpack_from(self.order + entry, raw, i * step), start + i * step + field) for i in range(n)]
        return tags, struct.unpack_from(self.order + self.word, raw, n * step)[0]

    def values(self, kind: int, count: int, place: int) -> tuple:
        code, size = FIELD[kind]
        at = place if size * count <= (8 if self.big else 4) else self._one(self.word, place)
        return struct.unpack(f"{self.order}{count}{code}", self._at(at, size * count))

    def pages(self, start: int | None = None) -> Iterator[tuple[int, list[tuple]]]:
        """(place, tags) of the directories from start on, one after the other."""
        at, seen = self.first if start is None else start, set()
        while at:
            if at in seen:
                raise ValueError("the directories run in a circle")
            seen.add(at)
            tags, following = self.directory(at)
            yield at, tags
            at = following

    def contiguous(self, tags: list[tuple]) -> int:
        """How many frames lie behind the image of a single directory, which only its description tells; else 1."""
        for tag, kind, count, place in tags:
            if tag == DESCRIPTION:
                text = self.values(kind, count, place)[0].decode("latin-1")
                found = re.search(r"^images=(\d+)", text, re.M) if text.startswith("ImageJ=") else None
                return int(found[1]) if found else 1
        return 1

    def page(self, tags: list[tuple]) -> Page:
        held = {tag: self.values(kind, count, place) for tag, kind, count, place in tags if kind in FIELD and tag != DESCRIPTION}
        one = {tag: v[0] for tag, v in held.items() if v}
        if TILE in held or one.get(SAMPLES, 1) != 1 or one.get(PREDICTOR, 1) != 1 or one.get(COMPRESSION, PLAIN) not in (PLAIN, *DEFLATE):
            raise ValueError("images must be of one sample, in strips, plain or deflated without a predictor")
        if one.get(BITS, 1) % 8:
            raise ValueError(f"samples of {one.get(BITS, 1)} bits aren't read")
        dtype = np.dtype(f"{self.order}{KINDS[one.get(KIND, 1)]}{one[BITS] // 8}")
        return Page((one[HEIGHT], one[WIDTH]), dtype, one.get(COMPRESSION, PLAIN), list(zip(held[OFFSETS], held[COUNTS])), min(one.get(STRIP_ROWS, one[HEIGHT]), one[HEIGHT]))

    def image(self, page: Page, skip: int = 0) -> np.ndarray:
        """The image of a page; skip: that many images lie between its own and the wanted one, without directories."""
        h, w = page.shape
        size = h * w * page.dtype.itemsize
        if skip:
            raw = self._at(page.strips[0][0] + skip * size, size)
        else:
            raw = b"".join(self._at(at, n) if page.compression == PLAIN else zlib.decompress(self._at(at, n)) for at, n in page.strips)
        if len(raw) < size:
            raise ValueError(f"an image has {len(raw)} of {size} bytes")
        return np.frombuffer(raw, page.dtype, h * w).reshape(h, w)


@dataclass
class _Frames(InputPartition):
    """Frames first to last of a file, whose directories begin at `at`; in a file of one directory, `apart` images lie before the first."""

    file: str
    path: str
    first: int
    last: int
    at: int
    apart: int | None = None


def _narrowed(low: float, high: float, f) -> tuple[float, float]:
    """The range that is left of [low, high] under a filter of whole numbers."""
    if isinstance(f, EqualTo):
        return max(low, f.value), min(high, f.value)
    if isinstance(f, In):
        return max(low, min(f.value)), min(high, max(f.value))
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return max(low, f.value + isinstance(f, GreaterThan)), high
    return low, min(high, f.value - isinstance(f, LessThan))


class TiffStacks(DataSource):
    """Lines of the images of TIFF files: (file, frame, y, v). Options: path (a file or folder), frames (of one partition); for writing,
    sample (float32, float64, or a whole-number type, which must hold all values exactly)."""

    @classmethod
    def name(cls) -> str:
        return "ephyra_tiff"

    def schema(self) -> str:
        return "file string, frame long, y int, v array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _StackReader(self.options["path"], int(self.options.get("frames", FRAMES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _StackWriter(self.options["path"], np.dtype(self.options.get("sample", "float32")).newbyteorder("<"), overwrite)


#: What a batch of a stack's lines looks like.
LINES = pa.schema([("file", pa.string()), ("frame", pa.int64()), ("y", pa.int32()), ("v", pa.list_(pa.float64()))])


class _StackReader(DataSourceReader):
    def __init__(self, path: str, frames: int):
        self.path, self.frames, self.low, self.high, self.files = path, frames, 0, math.inf, None

    def pushFilters(self, filters):
        """Ranges of frames and names of files narrow what is planned; all else, In of frames too, is left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "frame" and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.low, self.high = _narrowed(self.low, self.high, f)
                if isinstance(f, In):
                    yield f
            elif column == "file" and isinstance(f, (EqualTo, In)):
                names = set(f.value if isinstance(f, In) else [f.value])
                self.files = names if self.files is None else self.files & names
            elif not (column in ("frame", "file") and isinstance(f, IsNotNull)):
                yield f

    def partitions(self):
        fs, _ = located(self.path)
        parts = [p for name, path in _below(self.path, (".tif", ".tiff")).items() if self.files is None or name in self.files for p in self._planned(fs, name, path)]
        return parts or [_Frames("", "", 0, -1, 0)]

    def _planned(self, fs, name: str, path: str) -> list[_Frames]:
        if self.high < self.low:
            return []
        parts: list[_Frames] = []
        with fs.open_input_file(path) as f:
            stack, alone = Stack(f), None
            for i, (at, tags) in enumerate(stack.pages()):
                if i == 0:
                    alone = at, stack.contiguous(tags)
                if i > self.high:
                    break
                if i >= self.low:
                    if not parts or i - parts[-1].first >= self.frames:
                        parts.append(_Frames(name, path, i, i, at))
                    parts[-1].last = i
            else:
                if alone and i == 0 and alone[1] > 1:
                    low, high = max(0, self.low), min(alone[1] - 1, self.high)
                    return [_Frames(name, path, a, min(a + self.frames - 1, high), alone[0], a) for a in range(low, high + 1, self.frames)]
        return parts

    def read(self, part):
        if part.last < part.first:
            return
        fs, _ = located(self.path)
        with fs.open_input_file(part.path) as f:
            stack = Stack(f)
            pages = stack.pages(part.at)
            page = stack.page(next(pages)[1])
            for frame in range(part.first, part.last + 1):
                if part.apart is None and frame > part.first:
                    page = stack.page(next(pages)[1])
                v = stack.image(page, frame if part.apart is not None else 0).astype(np.float64)
                h, w = v.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h * w + 1, w, dtype=np.int32) if w else np.zeros(h + 1, np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * h), pa.array(np.full(h, frame)), pa.array(np.arange(h, dtype=np.int32)), lists], schema=LINES)


@dataclass
class _Written(WriterCommitMessage):
    files: dict  # name: (path of the part file, bytes, frames, place of the last directory)


class _Output:
    """One stack while it is written: a directory goes before its image, so that bytes are only ever appended."""

    def __init__(self, fs, path: str, dtype: np.dtype):
        self.path, self.dtype, self.at, self.n, self.last = path, dtype, 16, 0, 0
        self.stream, self.shape, self.lines = fs.open_output_stream(path), None, []
        self.stream.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))

    def add(self, frame: int, y: int, v: np.ndarray) -> None:
        if frame != self.n:
            self._page(more=True)
        if frame != self.n or y != len(self.lines):
            raise ValueError(f"line {y} of frame {frame} came where line {len(self.lines)} of frame {self.n} was due in {self.path}")
        kept = v.astype(self.dtype)
        if self.dtype.kind in "iu" and not np.array_equal(kept.astype(np.float64), v):
            raise ValueError(f"{self.dtype} doesn't hold all values of frame {frame}")
        self.lines.append(kept)

    def _page(self, more: bool) -> None:
        image = np.stack(self.lines)
        if self.shape not in (None, image.shape):
            raise ValueError(f"frame {self.n} is of another shape than those before it: {image.shape}, {self.shape}")
        self.shape, (h, w) = image.shape, image.shape
        tags = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, 8 * self.dtype.itemsize), (COMPRESSION, 3, PLAIN), (PHOTOMETRIC, 3, 1), (OFFSETS, 16, None), (SAMPLES, 3, 1), (STRIP_ROWS, 4, h), (COUNTS, 16, image.nbytes), (KIND, 3, next(k for k, c in KINDS.items() if c == self.dtype.kind))]
        data = self.at + 8 + 20 * len(tags) + 8
        end = data + image.nbytes + -image.nbytes % 8
        fields = b"".join(struct.pack("<HHQQ", tag, kind, 1, data if v is None else v) for tag, kind, v in tags)
        self.stream.write(struct.pack("<Q", len(tags)) + fields + struct.pack("<Q", end if more else 0) + image.tobytes() + bytes(-image.nbytes % 8))
        self.last, self.at, self.n, self.lines = self.at, end, self.n + 1, []

    def close(self) -> tuple:
        self._page(more=False)
        self.stream.close()
        return self.path, self.at, self.n, self.last


class _StackWriter(DataSourceArrowWriter):
    """Tasks write part files under names of their own; the commit reads the end of each back and only then gives it its name."""

    def __init__(self, path: str, dtype: np.dtype, overwrite: bool):
        self.path, self.dtype, self.overwrite = path, dtype, overwrite

    def write(self, iterator):
        (fs, root), done, out, name = located(self.path), {}, None, None
        try:
            for batch in iterator:
                if any(c.null_count for c in batch.columns) or batch.column(3).flatten().null_count:
                    raise ValueError("a line of a stack has no NULLs")
                names, frames, ys = (batch.column(i).to_pylist() for i in range(3))
                v, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))]
                for i, file in enumerate(names):
                    if file != name:
                        if out:
                            done[name] = out.close()
                        if file in done:
                            raise ValueError(f"lines of {file} don't come in one run")
                        if not file.lower().endswith((".tif", ".tiff")) or ".." in file.split("/"):
                            raise ValueError(f"not a name of a stack: {file!r}")
                        part = f"{root}/_parts/{uuid.uuid4().hex}"
                        fs.create_dir(f"{root}/_parts", recursive=True)
                        name, out = file, None
                        out = _Output(fs, part, self.dtype)
                        done[name] = (part, 0, 0, 0)
                    out.add(frames[i], ys[i], v[ends[i] : ends[i + 1]])
            if out:
                done[name] = out.close()
        except BaseException:
            self._dropped(done)
            raise
        return _Written(done)

    def _dropped(self, files: dict) -> None:
        fs, _ = located(self.path)
        for part, *_ in files.values():
            if fs.get_file_info(part).type == pa.fs.FileType.File:
                fs.delete_file(part)

    def commit(self, messages):
        fs, root = located(self.path)
        files: dict = {}
        for m in filter(None, messages):
            twice = files.keys() & m.files.keys()
            if twice:
                raise ValueError(f"lines of {sorted(twice)} came from two tasks")
            files |= m.files
        there = _below(self.path, (".tif", ".tiff")) if fs.get_file_info(root).type == pa.fs.FileType.Directory else {}
        if not self.overwrite and there.keys() & files.keys():
            raise ValueError(f"already there: {sorted(there.keys() & files.keys())}")
        for name, (part, size, frames, last) in files.items():
            with fs.open_input_file(part) as f:
                if f.size() != size or Stack(f).directory(last)[1] != 0:
                    raise ValueError(f"{name} wasn't written whole")
        for name, (part, *_) in files.items():
            fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            fs.move(part, f"{root}/{name}")
        if self.overwrite:
            for name in there.keys() - files.keys():
                fs.delete_file(there[name])

    def abort(self, messages):
        for m in filter(None, messages):
            self._dropped(m.files)


def stacks(spark: SparkSession, path: str, frames: int = FRAMES) -> DataFrame:
    """(file, frame, y, v) of the TIFF files at path. Filters on frame and file reach the plan of the scan, for which this sets Spark's own
    setting that lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffStacks)
    return spark.read.format("ephyra_tiff").option("path", path).option("frames", frames).load()


def write_stacks(lines: DataFrame, path: str, sample: str = "float32", mode: str = "append") -> None:
    """Writes lines (file, frame, y, v), each file by one task that holds one image at a time. Frames and lines count from 0 without gaps;
    NULLs, gaps and images of unlike shapes are errors. mode: append (no file may be there) or overwrite (the folder's other stacks go)."""
    lines.sparkSession.dataSource.register(TiffStacks)
    ordered = lines.select("file", F.col("frame").cast("long"), F.col("y").cast("int"), F.col("v").cast("array<double>")).repartition("file").sortWithinPartitions("file", "frame", "y")
    ordered.write.format("ephyra_tiff").option("path", path).option("sample", sample).mode(mode).save()


def pixels(lines: DataFrame) -> DataFrame:
    """(file, frame, y, x, v) of lines."""
    return lines.select("file", "frame", "y", F.posexplode("v").alias("x", "v"))


def lines(pixels_: DataFrame) -> DataFrame:
    """Lines of pixels (file, frame, y, x, v); a list is as long as an image is wide."""
    return pixels_.groupBy("file", "frame", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]).alias("v"))


# -- bundles of arrays


@dataclass
class _Values(InputPartition):
    file: str
    path: str
    member: str
    first: int
    last: int


class ArrayBundles(DataSource):
    """Values of the arrays of NPZ files: (file, member, shape, start, v), v being the values from place start on in the order of storage.
    Options: path (a file or folder), values (of one row). A stored member is read in ranges, a deflated one by one task."""

    @classmethod
    def name(cls) -> str:
        return "ephyra_npz"

    def schema(self) -> str:
        return "file string, member string, shape array<long>, start long, v array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _BundleReader(self.options["path"], int(self.options.get("values", VALUES)))


def _opened(archive: zipfile.ZipFile, member: str):
    """(stream at the first value, shape, dtype) of a member. Arrays of objects would have to be unpickled and are refused."""
    f = archive.open(f"{member}.npy")
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.kind not in "biuf" or (fortran and len(shape) > 1):
        raise ValueError(f"{member}: only arrays of numbers in C order are read, not {dtype}")
    return f, shape, dtype


class _BundleReader(DataSourceReader):
    #: Rows in one partition of a stored member.
    ROWS = 64

    def __init__(self, path: str, values: int):
        self.path, self.values, self.wanted = path, values, {"file": None, "member": None}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.wanted and isinstance(f, (EqualTo, In)):
                names = set(f.value if isinstance(f, In) else [f.value])
                self.wanted[column] = names if self.wanted[column] is None else self.wanted[column] & names
            elif not (column in self.wanted and isinstance(f, IsNotNull)):
                yield f

    def _takes(self, column: str, name: str) -> bool:
        return self.wanted[column] is None or name in self.wanted[column]

    def partitions(self):
        fs, _ = located(self.path)
        parts = []
        for file, path in _below(self.path, (".npz",)).items():
            if not self._takes("file", file):
                continue
            with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                for info in z.infolist():
                    member = info.filename.removesuffix(".npy")
                    if info.filename.endswith(".npy") and self._takes("member", member):
                        n = math.prod(_opened(z, member)[1])
                        step = self.values * self.ROWS if info.compress_type == zipfile.ZIP_STORED else max(n, 1)
                        parts += [_Values(file, path, member, a, min(a + step, n)) for a in range(0, max(n, 1), step)]
        return parts or [_Values("", "", "", 0, -1)]

    def read(self, part):
        if part.last < part.first:
            return
        fs, _ = located(self.path)
        with fs.open_input_file(part.path) as raw, zipfile.ZipFile(raw) as z:
            f, shape, dtype = _opened(z, part.member)
            f.seek(part.first * dtype.itemsize, io.SEEK_CUR)
            for a in range(part.first, max(part.last, part.first + 1), self.values):
                n = min(self.values, part.last - a)
                v = np.frombuffer(f.read(n * dtype.itemsize), dtype)
                if len(v) < n:
                    raise ValueError(f"{part.member} has fewer values than its header says")
                yield part.file, part.member, list(shape), a, v.astype(np.float64).tolist()


def bundles(spark: SparkSession, path: str, values: int = VALUES) -> DataFrame:
    """(file, member, shape, start, v) of the NPZ files at path; filters on file and member reach the plan of the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayBundles)
    return spark.read.format("ephyra_npz").option("path", path).option("values", values).load()


def cells(bundle: DataFrame) -> DataFrame:
    """(file, member, at, v): a row for each value, `at` its indexes in the array."""
    place = F.col("start") + F.col("i")
    sizes = F.col("shape")
    at = F.transform(sizes, lambda _, k: F.floor(F.col("place") / F.aggregate(F.slice(sizes, k + 2, F.size(sizes)), F.lit(1).cast("long"), lambda a, s: a * s)).cast("long") % F.element_at(sizes, (k + 1).cast("int")))
    return bundle.select("file", "member", "shape", "start", F.posexplode("v").alias("i", "v")).withColumn("place", place).select("file", "member", at.alias("at"), "v")
