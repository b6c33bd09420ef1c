"""Connected components by alternating large and small stars.

Every pass is a grouped minimum and an equi join on edges; the edge set shrinks
to one star per component, centred on its smallest id. Passes are written to
the shared folder, so lost executors cost no more than the current pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import dropped, saved


def _stars(edges: DataFrame) -> bool:
    """Whether every id is either a centre or the end of one edge: done."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("ends"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("ends"), F.lit(1).alias("centre")))
    return ends.groupBy("id").agg(F.sum("ends").alias("ends"), F.max("centre").alias("centre")).where(
        "ends > 1 or ends > 0 and centre > 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every id on an edge between two different ids:
    the smallest id reachable. Ids of type long without nulls; the order and
    repetition of edges are free. No edges: no rows."""
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    cur = saved(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(cur):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        dropped(cur)
        cur = new
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
