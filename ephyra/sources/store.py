"""Sessions, rounds, masks and traces as tables: names, sinks, read-back checks, digests, snapshots and resumption."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import digest, micros
from ..operators.pixels import mask_digest

TABLES = ("masks", "traces", "rois", "trials", "detrend", "meta")
#: The tables that a catalog must have.
CATALOG = ("experiments", "acquisitions", "mcor_files", "trials", "programs", "odors", "group_experiments")


def session_name(group_id: int, exp_name: str, kind: str | None = None, stage: str = "stage1", on: dt.date | None = None, suffix: str = "") -> str:
    return "_".join([f"group{group_id}", exp_name, *([kind] if kind else []), stage, (on or dt.date.today()).strftime("%Y%m%d")]) + suffix


def described(df: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """df whose columns carry descriptions as metadata."""
    return df.select(*[F.col(c).alias(c, metadata={"description": descriptions[c]}) if c in descriptions else F.col(c) for c in df.columns])


def write_session(path: str, tables: dict[str, DataFrame], **meta) -> None:
    """The tables of a round below a path, each committed by Spark as a whole; meta, with the mask's digest, last: a round without
    it isn't there."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    stored = mask_digest(tables["masks"]).first()
    rows = {**{k: str(v) for k, v in meta.items()}, "mask_hash": stored["digest"] if stored else ""}
    spark.createDataFrame(sorted(rows.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_session(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if "meta" not in out:
        raise ValueError(f"no complete round at {path}")
    return out


def verify_session(spark: SparkSession, path: str) -> str:
    """ok, STALE (the mask isn't the one that traces were taken with), mask only, or no rounds found."""
    try:
        t = read_session(spark, path)
    except ValueError:
        return "no rounds found"
    stored = {r["key"]: r["value"] for r in t["meta"].collect()}["mask_hash"]
    now = mask_digest(t["masks"]).first()
    if "traces" not in t:
        return "mask only"
    return "ok" if (now["digest"] if now else "") == stored else "STALE"


def verified_rows(spark: SparkSession, path: str, expected: int, required: list[str]) -> DataFrame:
    """A table read back; an error unless it has so many rows and the columns."""
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing or df.count() != expected:
        raise ValueError(f"{path}: missing {missing}, or not {expected} rows")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    if df.isEmpty():
        raise ValueError("an empty table isn't written")
    df.write.mode("overwrite").option("header", True).csv(path)


def csv_frames(spark: SparkSession, path: str) -> int:
    """Rows of a CSV that aren't blank, less a first row that isn't numeric."""
    rows = spark.read.text(path, wholetext=False).where(F.trim("value") != "")
    head = rows.first()
    if head is None:
        return 0
    numeric = re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", re.split(r"[,;\t]", head[0])[0].strip().strip('"'))
    return rows.count() - (0 if numeric else 1)


def check_counts(**counts: int) -> int:
    """The common count; an error that names all if they differ."""
    if len(set(counts.values())) != 1:
        raise ValueError("counts differ: " + ", ".join(f"{k} {v}" for k, v in counts.items()))
    return next(iter(counts.values()))


def recording_times(videos: DataFrame) -> DataFrame:
    """videos (path, sidecar JSON, container tag, modified) with at and at_source: the first time there is, of the sidecar, the tag,
    the path and the file."""
    side = F.try_to_timestamp(F.regexp_replace(F.get_json_object("sidecar", "$.mm_summary.StartTime"), r"\s+([-+]\d{4})$", "$1"), F.lit("yyyy-MM-dd HH:mm:ss.SSSZ"))
    tag = F.try_to_timestamp("container")
    path = F.try_to_timestamp(F.concat_ws("", F.regexp_extract("path", r"(\d{8})_(\d{6})", 1), F.regexp_extract("path", r"(\d{8})_(\d{6})", 2)), F.lit("yyyyMMddHHmmss"))
    at = F.coalesce(side, tag, path, F.col("modified"))
    return videos.withColumn("at", at).withColumn("at_source", F.when(side.isNotNull(), "sidecar").when(tag.isNotNull(), "container").when(path.isNotNull(), "path").otherwise("file"))


def ordered_pair(videos: DataFrame) -> DataFrame:
    """The two recordings before and after, in order of time; an error unless there are two at different times."""
    n, times = videos.agg(F.count(F.lit(1)), F.countDistinct("at")).first()
    if (n, times) != (2, 2):
        raise ValueError(f"two recordings of different times are needed, not {n} of {times}")
    return videos.orderBy("at")


def source_choice(files: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """The first file of the best kind for each key."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return files.where(rank > 0).groupBy(*keys).agg(F.min_by(F.struct("kind", "path"), F.struct(rank, F.col("path"))).alias("_f")).select(*keys, "_f.*")


def cache_key(files: DataFrame, keys: list[str], **parameters) -> DataFrame:
    """(keys, key): changes if and only if a file (name, size, modified) or a parameter does."""
    own = F.array_sort(F.collect_list(F.struct("name", "size", micros("modified").alias("modified"))))
    return files.groupBy(*keys).agg(digest(F.to_json(own), *[F.lit(f"{k}={v!r}") for k, v in sorted(parameters.items())]).alias("key"))


def snapshot(df: DataFrame, path: str, source_modified: float, max_age_s: float = 0.0, refresh: bool = False) -> tuple[DataFrame, str]:
    """A Parquet copy of a live table and how it came about: reused while it is younger than max_age_s or the source is no newer,
    else copied; if that fails, the copy before."""
    import time

    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else None
    if old is not None and not refresh and (time.time() - old < max_age_s or old >= source_modified):
        return spark.read.parquet(path), "reused"
    try:
        new = jvm.org.apache.hadoop.fs.Path(f"{path}.partial")
        df.write.mode("overwrite").parquet(str(new))
        if spark.read.parquet(str(new)).count() != df.count():
            raise ValueError("the copy isn't whole")
        fs.delete(p, True)
        fs.rename(new, p)
        return spark.read.parquet(path), "copied"
    except Exception:
        if old is None:
            raise
        return spark.read.parquet(path), "reused_previous"


def check_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each of the catalog's tables, all of them read; an error if one is missing."""
    missing = sorted(set(CATALOG) - set(tables))
    if missing:
        raise ValueError(f"tables missing: {missing}")
    return {k: tables[k].count() for k in CATALOG}


class Extraction:
    """Traces of trials that are added as they are done: partitions by trial, replaced as a whole, so that a run that is broken off
    goes on where it stopped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path).select("trial_id").distinct()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return self.spark.createDataFrame([], "trial_id long")

    def pending(self, trials: DataFrame) -> DataFrame:
        return trials.join(self.done(), "trial_id", "left_anti")

    def add(self, traces: DataFrame) -> None:
        traces.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trial_id").parquet(self.path)


# -- bundles, rounds on disk, tuning


def write_bundle(path: str, kind: str, tables: dict[str, DataFrame], version: int = 2, **config) -> None:
    """Tables below a path with a kind and a version that readers insist on, and their configuration."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = [("file_type", kind), ("schema_version", str(version)), ("tables", ",".join(sorted(tables))), *[(f"config.{k}", repr(v)) for k, v in sorted(config.items())]]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/bundle")


def read_bundle(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/bundle").collect()}
    if meta.get("file_type") != kind:
        raise ValueError(f"{path} is {meta.get('file_type')!r}, not {kind!r}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"].split(",")}, meta


def replayed(stored: DataFrame, replay: DataFrame) -> DataFrame:
    """The stored mask, if replaying its edits gives it; else an error."""
    if not stored.exceptAll(replay).isEmpty() or not replay.exceptAll(stored).isEmpty():
        raise ValueError("the stored mask isn't what its edits give")
    return stored


def listed(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """(path, time of change in seconds) of what a folder holds, by name; nothing if it isn't there. Any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted((str(s.getPath()), s.getModificationTime() / 1000) for s in fs.listStatus(p))


def find_rounds(spark: SparkSession, folder: str, stage: str = "stage1") -> list[str]:
    """Complete rounds of a stage (those with meta and a mask), by name; mask bundles aren't rounds."""
    out = []
    for path, _ in listed(spark, folder):
        inside = {p.rpartition("/")[2] for p, _ in listed(spark, path)}
        if f"_{stage}_" in path and "_masks_" not in path and {"meta", "masks"} <= inside:
            out.append(path)
    return out


def latest_mask(spark: SparkSession, folder: str) -> DataFrame:
    """The mask of the round or bundle that changed last."""
    found = [(m, p) for p, m in listed(spark, folder) if any(x.endswith("/masks") for x, _ in listed(spark, p))]
    if not found:
        raise ValueError(f"no masks in {folder}")
    return spark.read.parquet(max(found)[1] + "/masks")


def tuning(spark: SparkSession, path: str) -> dict:
    """Settings of a JSON file, its region as four whole numbers."""
    got = spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)
    if got.get("roi") is not None:
        if len(got["roi"]) != 4:
            raise ValueError("a region has four numbers")
        got["roi"] = tuple(int(x) for x in got["roi"])
    return got


def signed(signature: str, stored: str | None) -> None:
    """An error if a checkpoint was made of other inputs."""
    if stored is not None and stored != signature:
        raise ValueError("the checkpoint belongs to other inputs")
