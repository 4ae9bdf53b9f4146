"""Files brought near the machines that read them: copied side by side, checked, and copied again only when the source has changed.

A staged file has a record beside it, written after the copy took its name. A run that is broken off at any place leaves files without a
record, which the next run copies again; so an interrupted run ends with the manifest that an undisturbed one gives.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import located

#: Bytes that a task holds of a file, and what a record's name ends in.
BLOCK, RECORD = 4 << 20, ".source.json"
MANIFEST = "source string, name string, size long, modified_us long, sha256 string, staged string, status string"


def found(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(source, name, size, modified_us) of the files below path; contents aren't read. Spark lists no empty files, so they aren't here; a
    row made by hand stages one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    source, root = F.regexp_replace("path", "^file:/+", "/"), re.sub("^file:/+", "/", path).rstrip("/") + "/"
    name = F.when(source.startswith(root), F.substring(source, F.lit(len(root) + 1), F.length(source))).otherwise(F.element_at(F.split(source, "/"), -1))
    return files.select(source.alias("source"), name.alias("name"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_us"))


def _record(fs, path: str) -> dict | None:
    """The record of a staged file; None if there is none that can be read."""
    if fs.get_file_info(path + RECORD).type != pa.fs.FileType.File:
        return None
    with fs.open_input_stream(path + RECORD) as f:
        try:
            held = json.loads(f.read())
        except ValueError:
            return None
    return held if isinstance(held, dict) else None


def _put(fs, path: str, blocks: Iterator[bytes]) -> tuple[int, str]:
    """(bytes, digest) of what now lies at path. It took that name only when it was whole."""
    part, size, seen = f"{path}.{uuid.uuid4().hex}.part", 0, hashlib.sha256()
    with fs.open_output_stream(part) as out:
        for b in blocks:
            out.write(b)
            size += len(b)
            seen.update(b)
    fs.move(part, path)
    return size, seen.hexdigest()


def _staged(row, folder: str) -> tuple[str, str, str]:
    """(digest, place, status) of one file after it was staged."""
    (here, source), (there, root) = located(row.source), located(folder)
    target = f"{root.rstrip('/')}/{row.name_}"
    wanted = {"source": row.source, "size": int(row.size_), "modified_us": int(row.modified_us)}
    record, at = _record(there, target), there.get_file_info(target)
    if record and {k: record.get(k) for k in wanted} == wanted and at.type == pa.fs.FileType.File and at.size == wanted["size"] and "sha256" in record:
        return record["sha256"], target, "hit"
    there.create_dir(target.rpartition("/")[0], recursive=True)
    with here.open_input_stream(source) as f:
        size, digest = _put(there, target, iter(lambda: f.read(BLOCK), b""))
    if size != wanted["size"]:
        there.delete_file(target)
        raise OSError(f"copied {size} of {wanted['size']} bytes of {row.source}")
    _put(there, target + RECORD, iter([json.dumps(wanted | {"sha256": digest}, sort_keys=True).encode()]))
    return digest, target, "stale" if record or at.type == pa.fs.FileType.File else "absent"


def stage(files: DataFrame, folder: str, tasks: int = 64) -> DataFrame:
    """files (source, name, size, modified_us) with (sha256, staged, status) after each was brought to folder/name; status is hit, stale (it
    had changed, or its record was missing) or absent. Large files are dealt out first to last over the tasks by their hash; a task holds one block of a file.

    An empty table gives no rows; names given twice are an error, NULL sources are left out.
    """
    known = files.where("source is not null").select("source", "name", "size", "modified_us")
    twice = known.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two sources would be staged as {twice[0].name}")

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b.rename(columns={"name": "name_", "size": "size_"})
            for i, row in enumerate(rows.itertuples(index=False)):
                digest, target, status = _staged(row, folder)
                yield b.iloc[i : i + 1].assign(sha256=digest, staged=target, status=status)

    return known.repartition(tasks, "source").mapInPandas(copy, MANIFEST)


def verified(manifest: DataFrame) -> DataFrame:
    """manifest with `whole`: the staged file is there and its bytes have the digest that the copy had."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(whole=[_digest(p) == d for p, d in zip(b["staged"], b["sha256"])])

    return manifest.mapInPandas(look, manifest.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", whole boolean")


def _digest(path: str) -> str | None:
    fs, p = located(path)
    if fs.get_file_info(p).type != pa.fs.FileType.File:
        return None
    seen = hashlib.sha256()
    with fs.open_input_stream(p) as f:
        for b in iter(lambda: f.read(BLOCK), b""):
            seen.update(b)
    return seen.hexdigest()


def is_remote(path: str) -> bool:
    """Whether a path lies on a network mount or in another store, where a database must be copied before it is opened."""
    return path.startswith(("/Volumes/", "\\\\", "//")) or ("://" in path and not path.startswith("file:"))
