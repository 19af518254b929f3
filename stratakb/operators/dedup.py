"""Duplicate refusal and conflicts among entries that share a file anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import conflict, features, jaccard, near_duplicate
from .fts import bm25


def compare(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """pairs (a, b) of ids with j, jb and the two verdicts; each body is tokenized once, before the joins."""
    f = entries.select("id", features(F.col("body")).alias("f"))
    j = pairs.join(f.select(F.col("id").alias("a"), F.col("f").alias("fa")), "a").join(f.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b")
    x, y = F.col("fa"), F.col("fb")
    return j.select("a", "b", F.round(jaccard(x["tokens"], y["tokens"]), 6).alias("j"), F.round(jaccard(x["bigrams"], y["bigrams"]), 6).alias("jb"), near_duplicate(x, y).alias("near"), conflict(x, y).alias("conflict"))


def candidates(new: DataFrame, entries: DataFrame, anchors: DataFrame, *, limit: int, stem: bool = True) -> DataFrame:
    """(query_id, id): for each new (query_id, task, files) the live entries on the same files that match best."""
    hits = bm25(entries, new.select("query_id", "task"), stem=stem)
    on = new.select("query_id", F.explode("files").alias("file")).join(anchors, "file").select("query_id", F.col("entry_id").alias("id")).distinct()
    live = entries.where("status != 'superseded'").select("id")
    own = hits.join(on, ["query_id", "id"], "left_semi").join(live, "id", "left_semi").where("query_id != id")
    return own.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("n") <= limit).select("query_id", "id")


def refused(new: DataFrame, entries: DataFrame, anchors: DataFrame, *, limit: int = 5) -> DataFrame:
    """(query_id, twin): new bodies that restate one of their five best matches on the same file."""
    pairs = candidates(new, entries, anchors, limit=limit)
    bodies = entries.select("id", features(F.col("body")).alias("y"))
    j = pairs.join(new.select("query_id", features(F.col("task")).alias("x")), "query_id").join(bodies, "id")
    return j.where(near_duplicate(F.col("x"), F.col("y"))).groupBy("query_id").agg(F.min("id").alias("twin"))


def twins_within(new: DataFrame) -> DataFrame:
    """(query_id, twin): new bodies that restate one of a smaller id on a file of both."""
    f = new.select("query_id", F.array_distinct("files").alias("files"), features(F.col("task")).alias("f")).withColumn("file", F.explode("files"))
    x, y = f.alias("x"), f.alias("y")
    j = x.join(y, (F.col("x.file") == F.col("y.file")) & (F.col("y.query_id") < F.col("x.query_id")))
    return j.where(near_duplicate(F.col("x.f"), F.col("y.f"))).groupBy(F.col("x.query_id").alias("query_id")).agg(F.min("y.query_id").alias("twin"))


def surfaced(new: DataFrame, entries: DataFrame, anchors: DataFrame, *, limit: int = 3) -> DataFrame:
    """(query_id, id, preview, conflict): what the best three matches may duplicate or contradict."""
    pairs = candidates(new, entries, anchors, limit=limit)
    j = pairs.join(new.select("query_id", features(F.col("task")).alias("x")), "query_id").join(entries.select("id", "body", features(F.col("body")).alias("y")), "id")
    return j.select("query_id", "id", F.substring("body", 1, 120).alias("preview"), conflict(F.col("x"), F.col("y")).alias("conflict"))
