"""Connected components of a distributed edge table, by alternating large and small stars.

Each round is two joins with the least neighbour of a vertex and shrinks the longest
chain by half or more. Rounds are cut from each other by written tables; only one test
a round reaches the driver. A vertex with very many edges is a skewed join key, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b: long): component is the smallest vertex reachable.

    Repeated edges count once; edges from a vertex to itself are left out, and so are
    vertices that have no other.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e = written(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        across = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, written(across.union(down).distinct())
        discard(before)
        roles = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        open_ = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
        if open_.isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
