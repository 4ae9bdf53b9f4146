"""Group movies and their correlation maps behind caches, and the query that shows which groups are made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import cache, store
from ..sources.shared import new_path
from . import reports
from .queries import query, table

#: To be raised when a map is made otherwise of the same movie.
MAPS_VERSION = 1


def cached_movies(held: cache.ResultCache, frames: DataFrame, trials: DataFrame, files: DataFrame, n_pre: int, n_span: int, pooled: str = "mean") -> tuple[DataFrame, DataFrame]:
    """(movies (keys, t, y, x, z, ...), status of each group): `reports.group_z_movies` for groups whose files (keys, name, size,
    modified), windows or trials' onsets have changed; the other groups' movies are read. Frames of unchanged groups aren't read."""
    keys = held.keys
    onsets = trials.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("trial", "on"))).cast("string").alias("_on"))
    own = store.cache_key(files, keys, n_pre=n_pre, n_span=n_span, pooled=pooled)
    same = [onsets[k].eqNullSafe(own[k]) for k in keys]
    wanted = own.join(onsets, same).select(*[own[k] for k in keys], store.digest("key", "_on").alias("key"))

    def make(missing: DataFrame) -> DataFrame:
        some = cache.matching(trials, missing, keys)
        return reports.group_z_movies(frames.join(some.select("trial"), "trial", "left_semi"), some, n_pre, n_span, keys, pooled)[0]

    return held.refresh(wanted, make)


def cached_maps(movies: cache.ResultCache, wanted: DataFrame, maps: cache.ResultCache, delete_movies: bool = False) -> DataFrame:
    """Correlation maps of cached movies, kept in a cache of their own; wanted with what was done."""
    return cache.converted(movies, wanted, maps, lambda z: reports.correlation_maps(z, movies.keys), delete_movies, maps=MAPS_VERSION)


@query("""with o as (select c_mktsegment as grp, c_nationkey as nation, o_orderkey, o_totalprice, o_orderdate, c_nationkey % 5 = 0 and o_orderpriority = '1-URGENT' as changed from orders join customer on o_custkey = c_custkey),
 g as (select grp, nation, count(*) as n, round(sum(o_totalprice + case when changed then 1 else 0 end), 2) as total, bool_or(changed) as changed from o group by all)
 select grp, nation, case when nation = 24 then 'absent' when changed then 'stale' else 'hit' end as status, n, total from g""")
def cached_groups(spark, d):
    """Totals of orders by segment and nation from a cache. It was filled before a nation's orders came and others' prices changed: those
    groups alone are made anew."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("nation"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").cast("double").alias("size"),
        F.col("o_orderdate").cast("timestamp").alias("modified"), "o_orderpriority",
    )
    now = o.withColumn("size", F.when((F.col("nation") % 5 == 0) & (F.col("o_orderpriority") == "1-URGENT"), F.col("size") + 1).otherwise(F.col("size")))
    keys = ["grp", "nation"]
    held = cache.ResultCache(spark, new_path(spark, "cache"), keys)

    def totals(files: DataFrame):
        return lambda missing: files.join(missing, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("size"), 2).alias("total"))

    before = o.where("nation <> 24")
    held.refresh(store.cache_key(before, keys), totals(before))
    results, found = held.refresh(store.cache_key(now, keys), totals(now))
    return results.join(found.select(*keys, "status"), keys).select(*keys, "status", "n", "total")
