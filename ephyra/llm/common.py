"""What the operators of this subpackage share: materialised tables, Arrow maps, checked broadcasts, sketches."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A table is broadcast only if a count of the written table shows at most so many rows.
BROADCAST_ROWS = 200_000
#: Rows that a worker turns to Python objects at a time.
SLICE_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or in local mode without one a temporary folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="ephyra-")
        sc.setCheckpointDir(root)
        import atexit

        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = sc.getCheckpointDir()
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads it back: cuts the lineage, and outlives a lost
    executor. The files go by discard() or when the driver's JVM ends. Its rows are counted as they are written (written_rows)."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/ephyra-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written, out._rows = path, seen.get["n"]
    return out


def written_rows(df: DataFrame) -> int:
    """The rows of a table that materialize returned, without a job."""
    return df._rows


def discard(*tables: DataFrame | None) -> None:
    """Deletes written tables (as materialize returned them) that nothing will read again."""
    for df in tables:
        if df is not None and getattr(df, "_written", None):
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are done: it does so when the driver's JVM finds their plans unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_checked(df: DataFrame, small: DataFrame, on, how: str = "left", limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Joins a written table: broadcast behind a count of its rows, else by shuffle, where AQE splits hot keys. rows: so many at
    most, where that is known; a table that materialize returned knows them, others are counted."""
    rows = getattr(small, "_rows", rows)
    if rows is None:
        rows = small.limit(limit + 1).count()
    return df.join(F.broadcast(small) if rows <= limit else small, on, how)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that clash with the names (as Spark compares names), so that an operator's own columns win."""
    own = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])


def with_arrow(df: DataFrame, fn, inputs: list, fields: list[T.StructField]) -> DataFrame:
    """df with the columns `fields` that fn(iterator state) makes. fn() is called once in each task and returns a function
    from a batch's input arrays (Python lists) to one list for each field. inputs: columns or names, read under
    private names so that no column of df can clash."""
    df = without(df, *[f.name for f in fields])
    n, schema = len(df.columns), T.StructType([*df.schema.fields, *fields])
    private = [f"__in{i}__" for i in range(len(inputs))]
    given = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(p) for c, p in zip(inputs, private, strict=True)])
    types = [pa_type(f.dataType) for f in fields]

    def run(batches):
        f = fn()
        for whole, lo in ((b, i) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            batch = whole.slice(lo, SLICE_ROWS)
            cols = f(*[batch.column(n + i).to_pylist() for i in range(len(inputs))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=schema.names)

    return given.mapInArrow(run, schema)


def pa_type(t: T.DataType) -> pa.DataType:
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}.get(type(t)) or pa.list_(pa_type(t.elementType))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def quantized(v: Column) -> Column:
    """A whole number >= 0 kept to its 6 leading bits: the buckets of a log-linear sketch, exact below 64 and within 1/32
    above. Counts of buckets add, so that sketches of parts merge exactly, in any order and without chance."""
    e = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", v, e), e)


def sketch(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys..., metric, v, n): the mergeable quantile sketch of each metric (long, >= 0) for each key. Tasks sum their
    counts before the shuffle; a key has at most 64 + 32 buckets for each power of two, however many rows it has."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), quantized(F.col(m)).alias("v")) for m in metrics]))
    return df.select(*keys, pairs.alias("_p")).groupBy(*keys, "_p.metric", "_p.v").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sk: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """(keys..., metric, total, one column for each prob): the least v whose share of rows reaches prob."""
    w = Window.partitionBy(*keys, "metric")
    c = sk.withColumn("_cum", F.sum("n").over(w.orderBy("v"))).withColumn("total", F.sum("n").over(w))
    return c.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *[F.min(F.when(F.col("_cum") >= F.ceil(F.col("total") * p), F.col("v"))).alias(a) for a, p in probs.items()])
