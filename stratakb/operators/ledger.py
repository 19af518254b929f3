"""Savings ledger: an append-only log of recall receipts and its totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import short_hash
from ..functions.text import fts_query


def receipts(queries: DataFrame, costs: DataFrame) -> DataFrame:
    """A log row (ts, query_hash, served, baseline, reads_avoided) for each query; one with nothing packed costs nothing."""
    j = queries.join(costs, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select(F.col("now").alias("ts"), short_hash(fts_query(F.col("task")), 16).alias("query_hash"), z("served"), z("baseline"), z("reads_avoided"))


def totals(log: DataFrame, since: str | None = None) -> DataFrame:
    """Lifetime sums, or those since a stamp; saved may be negative."""
    rows = log if since is None else log.where(F.col("ts") >= since)
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("recalls"), F.count_distinct("query_hash").alias("distinct_queries"), z("served").alias("served"), z("baseline").alias("baseline"), (z("baseline") - z("served")).alias("saved"), z("reads_avoided").alias("reads_avoided"), F.min("ts").alias("since"))


def session(lifetime: DataFrame, base: DataFrame) -> DataFrame:
    """Lifetime minus what it was when the session began."""
    a, b = lifetime.alias("a"), base.alias("b")
    cols = ("recalls", "distinct_queries", "served", "baseline", "saved", "reads_avoided")
    return a.crossJoin(b).select(*[(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(c) for c in cols])
