"""Connected components by alternating large and small stars.

Each round is two aggregations of minima and two joins; every round's edges are
written to the shared folder, so lineage stays short and a lost executor costs
a reread. Minima are pre-aggregated before the shuffle; the joins are plain
equi-joins on the node, which adaptive execution splits where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_path, release, scratch, write


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """e has a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; component: the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once; without edges
    the result is empty.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    path, before, schema = None, None, now.schema
    while True:
        new = scratch(spark, "stars")
        write(now, new)
        now = spark.read.schema(schema).parquet(new)
        if path:
            drop_path(spark, path)
        path = new
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            release(spark)
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
        now = _small(_large(now))
