"""Queries through files of arrays and staged files, written by Spark in the shared folder from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import arrays, staging
from ..sources.shared import new_path
from .queries import query, table

#: Frames of a month, from the first of the data; the query reads one year of them.
MONTHS = "(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1"


@query(f"""with p as (select l_returnflag as flag, cast({MONTHS} as bigint) as frame, l_linenumber % 7 as y, l_suppkey % 16 as x, count(*) as n, cast(sum(l_quantity) as double) as v from lineitem group by all)
 select concat(flag, '.tif') as file, frame, cast(y as int) as y, cast(x as int) as x, v from p where frame between 24 and 35""")
def stack_frames(spark, d):
    """Quantities by month, line and supplier as image stacks, one a return flag: written as TIFF, and one year of frames read back from
    them. Pixels without a row are NaN."""
    li = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", F.lit(".tif")).alias("file"), F.expr(MONTHS).cast("long").alias("frame"), (F.col("l_linenumber") % 7).cast("int").alias("y"), (F.col("l_suppkey") % 16).cast("int").alias("x"), F.col("l_quantity").cast("double").alias("q"),
    )
    known = li.groupBy("file", "frame", "y", "x").agg(F.sum("q").alias("v"))
    # every frame up to a file's last one, whole: the grid is as large as the images are
    last = known.groupBy("file").agg(F.max("frame").alias("last"))
    grid = last.select("file", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame")).select("file", "frame", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("y")).select("file", "frame", "y", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
    full = grid.join(known, ["file", "frame", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(float("nan"))))
    path = new_path(spark, "stacks")
    arrays.write_stacks(arrays.lines(full), path, sample="float64")
    year = arrays.stacks(spark, path, frames=6).where("frame between 24 and 35")
    return arrays.pixels(year).where(~F.isnan("v")).select("file", "frame", "y", "x", "v")


@query("""select o_orderpriority as priority, count(*) as n, round(sum(cast(o_totalprice as double)), 2) as total, true as whole, 'absent' as first, 'hit' as again from orders group by all""")
def staged_files(spark, d):
    """Orders by priority as files that are staged, verified and read where they were staged; a second run copies none again."""
    source, target = new_path(spark, "source"), new_path(spark, "staged")
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("double").alias("price"))
    o.withColumn("_p", F.col("priority")).repartition("_p").write.partitionBy("_p").parquet(source)
    files = staging.found(spark, source, "*.parquet")
    once = staging.stage(files, target).groupBy().agg(F.max("status").alias("first")).first().first
    again = staging.verified(staging.stage(files, target)).groupBy().agg(F.max("status").alias("again"), F.min("whole").alias("whole")).first()
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(target)
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total")).select("priority", "n", "total", F.lit(again.whole).alias("whole"), F.lit(once).alias("first"), F.lit(again.again).alias("again"))
