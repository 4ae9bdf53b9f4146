"""Queries over regions and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions
from ..sources.shared import written
from .queries import query, table


@query("""with recursive m as (select distinct o_custkey % 61 as y, o_orderkey % 700 as x from orders where o_orderkey % 3 = 0), o as (select * from (values (0,1),(0,-1),(1,0),(-1,0)) o(dy, dx)),
 e as (select a.y as ay, a.x as ax, b.y as by_, b.x as bx from m a, o, m b where b.y = a.y + dy and b.x = a.x + dx), r(y, x, fy, fx) as (select y, x, y, x from m union select e.by_, e.bx, r.fy, r.fx from r join e on e.ay = r.y and e.ax = r.x),
 f as (select y, x, min((fy, fx)) as first from r group by all) select y, x, cast(dense_rank() over (order by first) as int) as region from f""")
def labelled_regions(spark, d):
    """Connected regions of the pixels that orders hit, numbered line by line."""
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0")
    mask = o.select((F.col("o_custkey") % 61).cast("int").alias("y"), (F.col("o_orderkey") % 700).cast("int").alias("x")).distinct()
    return regions.labelled(mask, eight=False).select("y", "x", F.col("region").cast("int").alias("region"))


@query()
def linkage_clusters(spark, d):
    """Suppliers' parts by return flag as rois of three masks; rois of different masks that share enough parts are one."""
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_suppkey") * 3 + F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)).alias("roi"), "l_partkey").distinct()
    area = written(li.groupBy("roi").agg(F.count(F.lit(1)).alias("n")))
    shared = regions.sharing(li.select("roi", F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("item")), 0.1)
    iou = shared.join(area.select(F.col("roi").alias("a"), F.col("n").alias("na")), "a").join(area.select(F.col("roi").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("overlap"))
    return regions.clusters(area.select("roi"), iou, 0.1)
