"""Incremental sweep: what changed between the known files and a snapshot of the disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SWEEP_BUDGET


def diff(known: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change): new, changed (time stamp or size differs) or removed; unchanged paths are left out."""
    j = known.select("path", "mtime_ns", "size").alias("k").join(disk.select("path", "mtime_ns", "size").alias("d"), "path", "full_outer")
    on_disk, was = F.col("d.size").isNotNull() | F.col("d.mtime_ns").isNotNull(), F.col("k.size").isNotNull() | F.col("k.mtime_ns").isNotNull()
    same = F.col("k.mtime_ns").eqNullSafe(F.col("d.mtime_ns")) & F.col("k.size").eqNullSafe(F.col("d.size"))
    change = F.when(~was, "new").when(~on_disk, "removed").when(~same, "changed")
    return j.select("path", change.alias("change")).where("change is not null")


def plan(changes: DataFrame, anchors: DataFrame, entries: DataFrame, budget: int = SWEEP_BUDGET) -> DataFrame:
    """changes with action: removed, reindex (the first of the budget; files with live anchors, then known ones before new ones, by path) or dirty.

    Only the budget's rows need an order: the top of each side is taken with a
    limit, so no task sorts all changes.
    """
    live = entries.where("status != 'superseded'").select(F.col("id").alias("entry_id"))
    anchored = anchors.join(live, "entry_id", "left_semi").select(F.col("file").alias("path"), F.lit(True).alias("anchored")).distinct()
    todo = changes.where("change != 'removed'").join(anchored, "path", "left").select("path", "change", (~F.coalesce("anchored", F.lit(False))).alias("late"))
    first = todo.orderBy("late", F.col("change") == "new", "path").limit(budget).select("path", F.lit("reindex").alias("action"))
    rest = changes.join(first, "path", "left")
    return rest.select("path", "change", F.when(F.col("change") == "removed", "removed").otherwise(F.coalesce("action", F.lit("dirty"))).alias("action"))


def purge(table: DataFrame, gone: DataFrame, key: str = "file") -> DataFrame:
    """A derived table without the rows of paths in gone."""
    return table.join(gone.select(F.col("path").alias(key)), key, "left_anti").select(*table.columns)


def replace(table: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "file") -> DataFrame:
    """A derived table with the touched paths' rows replaced."""
    return purge(table, touched, key).unionByName(fresh.select(*table.columns))


def freshness(planned: DataFrame, first: int = 10) -> DataFrame:
    """One row: how many are reindexed, removed and dirty, and the first few dirty paths."""
    head = planned.where("action = 'dirty'").orderBy("path").limit(first).agg(F.array_sort(F.collect_list("path")).alias("dirty"))
    counts = planned.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("reindex", "reindexed_now"), ("removed", "removed"), ("dirty", "dirty_total"))])
    return counts.crossJoin(head)  # one row each


def latest(table: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
