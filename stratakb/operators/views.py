"""Status counts, briefs, the verify queue and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RELS


def status_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def brief(entries: DataFrame, archived: DataFrame) -> DataFrame:
    """One row over the entries that aren't archived: active, needing attention, verified but stale."""
    shown = entries.join(archived.select(F.col("entry_id").alias("id")), "id", "left_anti")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    attention = F.col("status").isin("stale", "invalidated")
    return shown.agg(F.count(F.lit(1)).alias("total"), n(F.col("status") == "active").alias("active"), n(attention).alias("attention"), n((F.col("source") == "verified") & (F.col("status") == "stale")).alias("reverify"))


def statusline(brief_row: DataFrame) -> DataFrame:
    return brief_row.select(F.format_string("%d memories, %d stale", F.col("active"), F.col("attention")).alias("segment"))


def verify_queue(entries: DataFrame, archived: DataFrame) -> DataFrame:
    """Stale verified entries, oldest evidence first; place from 1."""
    from pyspark.sql import Window

    rows = entries.where("status = 'stale' and source = 'verified'").join(archived.select(F.col("entry_id").alias("id")), "id", "left_anti")
    per_day = Window.partitionBy(F.substring("evidence_ran_at", 1, 10)).orderBy("evidence_ran_at", "id")
    days = rows.groupBy(F.substring("evidence_ran_at", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("c"))
    before = days.select("day", (F.sum("c").over(Window.orderBy(F.asc_nulls_first("day"))) - F.col("c")).alias("before"))  # a row for each day
    numbered = rows.withColumn("in_day", F.row_number().over(per_day)).withColumn("day", F.substring("evidence_ran_at", 1, 10))
    j = numbered.join(before, numbered["day"].eqNullSafe(before["day"]))
    return j.select((F.col("before") + F.col("in_day")).cast("long").alias("place"), "id", "evidence_cmd", "evidence_ran_at", "stale_reason")


def archived_flag(entries: DataFrame, archived: DataFrame) -> DataFrame:
    """Every entry's id with whether it is archived."""
    hidden = archived.select(F.col("entry_id").alias("id"), F.lit(True).alias("hidden")).distinct()
    return entries.join(hidden, "id", "left").select("id", F.coalesce("hidden", F.lit(False)).alias("archived"))


def add_links(new: DataFrame, links: DataFrame, entries: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(links, entries) after adding (src, dst, rel): unknown relations and targets are left out, known links stay; what is superseded gets that status."""
    ok = new.where(F.col("rel").isin(RELS)).join(entries.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "rel")
    dead = ok.where("rel = 'supersedes'").select(F.col("dst").alias("id"), F.lit(True).alias("dead")).distinct()
    j = entries.join(dead, "id", "left")
    changed = {"status": F.when(F.col("dead"), "superseded").otherwise(F.col("status")), "updated_at": F.when(F.col("dead"), now).otherwise(F.col("updated_at"))}
    return links.unionByName(ok).distinct(), j.select(*[changed.get(c, F.col(c)).alias(c) for c in entries.columns])


def forget(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The store's tables without the entries of ids and all that hangs on them."""
    keys = {"entries": ["id"], "anchors": ["entry_id"], "links": ["src", "dst"], "archived": ["entry_id"]}
    out = {}
    for name, df in tables.items():
        kept = df
        for k in keys.get(name, []):
            kept = kept.join(ids.select(F.col("id").alias(k)), k, "left_anti")
        out[name] = kept.select(*df.columns)
    return out


def precision_at(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Share of queries whose expected id is among the first k; ranked: query_id, id, place."""
    hit = ranked.where(F.col("place") <= k).join(expected, ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    return expected.select("query_id").distinct().join(hit, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
