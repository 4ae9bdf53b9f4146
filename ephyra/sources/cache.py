"""Results kept by the digest of what they were made of: entries that still hold are read again, the others alone are made anew.

A cache is a folder with two tables, both partitioned by entry (one for each key): `data`, whose rows carry the digest that they were made
for, and `manifest`, with the digest, the number of rows and notes, written after the data were read back. An entry holds if the
manifest has the wanted digest and as many rows with that digest are there. So a run that is broken off at any place
leaves a miss, never a wrong hit, and a file that can't be read is a miss too.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import digest, slug
from .shared import saved
from .store import listed

#: Names that a cache adds to the rows of results.
ENTRY, MADE_FOR = "_entry", "_made_for"
_MANIFEST = "digest string, rows long, notes string, _entry string"


def derived_key(wanted: DataFrame, **parameters) -> DataFrame:
    """wanted (keys, key) with the keys of what is made of those results with these parameters (a version, say)."""
    return wanted.withColumn("key", digest("key", *[F.lit(f"{k}={v!r}") for k, v in sorted(parameters.items())]))


def matching(df: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys are among those of entries; NULL is a key like any other."""
    theirs = entries.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(theirs, on, "left_semi")


class ResultCache:
    """Results by `keys`. wanted: a DataFrame (keys, key) as `store.cache_key` makes it, one row for each entry."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _named(self, df: DataFrame) -> DataFrame:
        """df with the name of its entry: legible, and another one for unlike keys (NULLs too)."""
        return df.withColumn(ENTRY, F.concat(F.lit("e_"), F.substring(F.concat_ws("-", *[slug(k) for k in self.keys]), 1, 80), F.lit("-"), digest(*self.keys)))

    def _table(self, name: str, schema: str | T.StructType) -> DataFrame:
        """One of the tables; files that are broken have no rows."""
        path = f"{self.path}/{name}"
        if not listed(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)

    def manifest(self) -> DataFrame:
        return self._table("manifest", _MANIFEST)

    def schema(self) -> T.StructType | None:
        """The columns of the results, as the first that were written had them."""
        found = listed(self.spark, f"{self.path}/schema")
        if not found:
            return None
        return T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))

    def _data(self) -> DataFrame | None:
        schema = self.schema()
        return None if schema is None else self._table("data", T.StructType([*schema.fields, T.StructField(MADE_FOR, T.StringType()), T.StructField(ENTRY, T.StringType())]))

    def status(self, wanted: DataFrame) -> DataFrame:
        """wanted with `status`: hit, stale (made for another digest), broken (not all rows are there) or absent. Rows are counted by
        files and footers; results are not read."""
        data = self._data()
        there = self.spark.createDataFrame([], f"{ENTRY} string, digest string, there long") if data is None else data.groupBy(ENTRY, F.col(MADE_FOR).alias("digest")).agg(F.count(F.lit(1)).alias("there"))
        held = self.manifest().join(there, [ENTRY, "digest"], "left").select(ENTRY, "digest", (F.col("rows") == F.coalesce("there", F.lit(0))).alias("_whole"))
        state = F.when(F.col("digest").isNull(), "absent").when(F.col("digest") != F.col("key"), "stale").when(F.col("_whole"), "hit").otherwise("broken")
        return self._named(wanted).join(held, ENTRY, "left").select(*wanted.columns, state.alias("status"))

    def read(self, wanted: DataFrame) -> DataFrame:
        """The results (without the cache's columns) of the wanted entries that hold. Only partitions of these are read."""
        data = self._data()
        if data is None:
            raise ValueError(f"nothing was ever written to {self.path}")
        hits = self._named(self.status(wanted).where("status = 'hit'")).select(ENTRY, F.col("key").alias(MADE_FOR))
        return data.join(hits, [ENTRY, MADE_FOR]).drop(ENTRY, MADE_FOR)

    def write(self, results: DataFrame, made: DataFrame, notes: dict | None = None) -> None:
        """Replaces the entries of `made` (keys, key) by the results (with the keys among their columns); entries without a result
        are empty. Other entries' files stay as they are."""
        fields = [f for f in results.schema.fields]
        if self.schema() is None:
            text = json.dumps(T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]).jsonValue())
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        elif [(f.name, f.dataType) for f in self.schema().fields] != [(f.name, f.dataType) for f in fields]:
            raise ValueError(f"results have other columns than those in {self.path}")
        entries = self._named(made)
        named = self._named(results).join(entries.select(ENTRY, F.col("key").alias(MADE_FOR)), ENTRY)
        self._replace("data", named.select(*results.columns, MADE_FOR, ENTRY))
        there = self._data().groupBy(ENTRY, F.col(MADE_FOR).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
        rows = entries.join(there, [ENTRY, "key"], "left")
        self._replace("manifest", rows.select(F.col("key").alias("digest"), F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(json.dumps(notes or {}, sort_keys=True)).alias("notes"), ENTRY))

    def _replace(self, name: str, rows: DataFrame) -> None:
        # gathered by entry for few files, but an entry that is large is split
        rows.hint("rebalance", ENTRY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ENTRY).parquet(f"{self.path}/{name}")

    def refresh(self, wanted: DataFrame, make, notes: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(results of all wanted entries, wanted with the status that was found). make(keys) is called once, with the keys whose
        entry doesn't hold, and gives their results; it isn't called if all hold."""
        found = saved(self.status(wanted))
        missing = found.where("status <> 'hit'").drop("status")
        if not missing.isEmpty():
            self.write(make(missing.select(*self.keys)), missing, notes)
        return self.read(wanted), found

    def drop(self, entries: DataFrame) -> int:
        """Deletes entries (keys), manifest first; how many were there."""
        jvm, n = self.spark.sparkContext._jvm, 0
        for (name,) in self._named(entries.select(*self.keys)).select(ENTRY).distinct().toLocalIterator():
            for kind in ("manifest", "data"):
                p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{ENTRY}={name}")
                fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
                n += fs.exists(p) and fs.delete(p, True) and kind == "manifest"
        return n


def converted(source: ResultCache, wanted: DataFrame, target: ResultCache, make, delete_source: bool = False, **parameters) -> DataFrame:
    """Results made of cached results, not of what these were made of: entries of `source` that hold are read and make(results)
    gives those of `target`, under keys derived with the parameters. Entries that `target` has already stay. With delete_source the
    source's entries go once the target's hold. Returns wanted with `converted`: done, kept, or why not."""
    state = saved(source.status(wanted))
    whole = state.where("status = 'hit'").drop("status")
    keys = saved(derived_key(whole, **parameters))
    _, found = target.refresh(keys, lambda missing: make(source.read(matching(whole, missing, source.keys))), {"converted_from": source.path})
    if delete_source:
        source.drop(target.status(keys).where("status = 'hit'"))
    done = source._named(found).select(ENTRY, F.when(F.col("status") == "hit", "kept").otherwise("done").alias("converted"))
    named = source._named(state).join(done, ENTRY, "left").withColumn("converted", F.coalesce("converted", F.concat(F.lit("source is "), F.col("status"))))
    return named.select(*wanted.columns, "converted")
