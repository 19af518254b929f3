"""Anchor resolution: what became of every anchor, and of the entries that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.trust import stale_penalty
from ..schemas import BODY_FLOOR, EMPTY_REASON, FILE_FLOOR


def fates(anchors: DataFrame, entries: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The live anchors with fate (fresh, followed, stale, invalidated), reason, and where they point now.

    The lookups are aggregated to one row for each key before they are joined,
    so no join multiplies anchors and a key with many rows is pre-aggregated. An
    anchor without a symbol or a hash gets a key of its own there, so that null
    keys don't meet in one task.
    """
    key = lambda c: F.concat(F.lit("k"), F.col(c))
    live = anchors.join(entries.where("status != 'superseded'").select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    by_path = files.groupBy(F.col("path").alias("file")).agg(F.min("hash").alias("path_hash"))
    by_content = files.groupBy(key("hash").alias("file_key")).agg(F.count(F.lit(1)).alias("n_files"), F.min_by("path", "path").alias("to_path"), F.min_by("size", "path").alias("to_size"))
    by_pair = symbols.select(key("fqn").alias("name_key"), key("body_hash").alias("body_key"), F.lit(True).alias("pair")).distinct()
    by_name = symbols.select(key("fqn").alias("name_key"), F.lit(True).alias("named")).distinct()
    by_body = symbols.groupBy(key("body_hash").alias("body_key")).agg(
        F.count(F.lit(1)).alias("n_symbols"), F.min_by("fqn", "id").alias("to_fqn"), F.min_by("file", "id").alias("to_file"), F.min_by(F.struct("body_len"), "id")["body_len"].alias("to_len")
    )
    own, of_file = F.concat(F.lit("n"), F.col("id").cast("string")), F.col("symbol_fqn").isNull()
    live = live.withColumns({"name_key": F.coalesce(key("symbol_fqn"), own), "body_key": F.when(of_file, own).otherwise(F.coalesce(key("ast_body_hash"), own)), "file_key": F.when(of_file, F.coalesce(key("ast_body_hash"), own)).otherwise(own)})
    a = live.join(by_path, "file", "left").join(by_content, "file_key", "left").join(by_pair, ["name_key", "body_key"], "left").join(by_name, "name_key", "left").join(by_body, "body_key", "left")
    is_file, known, there = F.col("symbol_fqn").isNull(), F.col("ast_body_hash").isNotNull(), F.col("path_hash").isNotNull()
    n_files, n_symbols = F.coalesce("n_files", F.lit(0)), F.coalesce("n_symbols", F.lit(0))
    case = (
        F.when(is_file & there & ~known, "fresh:adopt")
        .when(is_file & there & (F.col("path_hash") == F.col("ast_body_hash")), "fresh:")
        .when(is_file & there, "stale:file_edited")
        .when(is_file & (~known | (n_files == 0)), "invalidated:")
        .when(is_file & (n_files > 1), "stale:ambiguous_anchor")
        .when(is_file & (F.col("to_size") < FILE_FLOOR), "stale:low_entropy")
        .when(is_file, "followed:")
        .when(~known, "stale:missing_hash")
        .when(F.col("pair"), "fresh:")
        .when(F.col("named"), "stale:body_edited")
        .when(n_symbols == 0, "invalidated:")
        .when(n_symbols > 1, "stale:ambiguous_anchor")
        .when(F.coalesce(F.col("to_len") < BODY_FLOOR, F.lit(False)), "stale:low_entropy")
        .otherwise("followed:")
    )
    a = a.withColumn("case", case).withColumn("fate", F.split("case", ":")[0])
    followed = F.col("fate") == "followed"
    return a.select(
        "id", "entry_id", F.when(followed, F.when(is_file, F.col("to_path")).otherwise(F.col("to_file"))).otherwise(F.col("file")).alias("file"),
        F.when(followed & ~is_file, F.col("to_fqn")).otherwise(F.col("symbol_fqn")).alias("symbol_fqn"),
        F.when(F.col("case") == "fresh:adopt", F.col("path_hash")).otherwise(F.col("ast_body_hash")).alias("ast_body_hash"), "context_hint", "fate",
        F.when(F.col("fate") == "stale", F.split("case", ":")[1]).alias("reason"),
    )


def tally(resolved: DataFrame) -> DataFrame:
    """(entry_id, total, invalidated, stale, first_reason): the reason of the first stale anchor by id."""
    first = F.min(F.when(F.col("fate") == "stale", F.struct("id", "reason")))["reason"]
    return resolved.groupBy("entry_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("fate") == "invalidated").alias("invalidated"), F.count_if(F.col("fate") == "stale").alias("stale"), first.alias("first_reason"))


def apply_fates(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """The entries after resolution. Superseded ones and those without anchors stay; the penalty falls once, on active to stale."""
    t = tally(resolved).select(F.col("entry_id").alias("id"), "total", "invalidated", "stale", "first_reason")
    j = entries.join(t, "id", "left")
    touched = F.col("total").isNotNull() & (F.col("status") != "superseded")
    all_gone, some_gone, some_stale = F.col("invalidated") == F.col("total"), F.col("invalidated") > 0, F.col("stale") > 0
    status = F.when(all_gone, "invalidated").when(some_gone | some_stale, "stale").otherwise("active")
    reason = F.when(all_gone, EMPTY_REASON).when(some_gone, "anchor_lost").when(some_stale, F.col("first_reason"))
    falls = touched & (F.col("status") == "active") & (status == "stale")
    changed = {
        "confidence": F.when(falls, stale_penalty(F.col("source"), F.col("confidence"))).otherwise(F.col("confidence")),
        "stale_reason": F.when(touched, reason).otherwise(F.col("stale_reason")),
        "status": F.when(touched, status).otherwise(F.col("status")),
    }
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in entries.columns])


def apply_moves(anchors: DataFrame, resolved: DataFrame) -> DataFrame:
    """The anchors after resolution: followed ones moved, hashes filled in."""
    new = resolved.select("id", F.struct("file", "symbol_fqn", "ast_body_hash").alias("now"))
    j = anchors.join(new, "id", "left")
    return j.select(*[(F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)) if c in ("file", "symbol_fqn", "ast_body_hash") else F.col(c)).alias(c) for c in anchors.columns])


def report(resolved: DataFrame) -> DataFrame:
    return resolved.agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("fresh", "followed", "stale", "invalidated")])


def resolve_anchor(specs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Write-time resolution of specs (n, file, symbol): the symbol by fqn or name within the file, or the indexed file.

    outcome is ok, ambiguous (with candidates), unknown_symbol (with up to 10
    known names) or unknown_file.
    """
    found = specs.join(symbols, (specs["file"] == symbols["file"]) & ((symbols["fqn"] == specs["symbol"]) | (symbols["name"] == specs["symbol"]))).groupBy("n").agg(
        F.array_sort(F.collect_set("fqn")).alias("fqns"), F.min_by("body_hash", symbols["id"]).alias("body_hash"), F.min_by(F.struct("parent_fqn"), symbols["id"])["parent_fqn"].alias("hint")
    )
    known = symbols.groupBy("file").agg(F.slice(F.array_sort(F.collect_set("fqn")), 1, 10).alias("known"))
    j = specs.join(found, "n", "left").join(known, "file", "left").join(files.select(F.col("path").alias("file"), F.col("hash").alias("file_hash")), "file", "left")
    none = F.array().cast("array<string>")
    whole, n = F.col("symbol").isNull(), F.coalesce(F.size("fqns"), F.lit(0))
    outcome = F.when(whole & F.col("file_hash").isNotNull(), "ok").when(whole, "unknown_file").when(F.coalesce(n, F.lit(0)) == 1, "ok").when(n > 1, "ambiguous").otherwise("unknown_symbol")
    return j.select("n", "file", F.when(~whole & (n == 1), F.col("fqns")[0]).alias("symbol_fqn"), F.when(whole, F.col("file_hash")).otherwise(F.col("body_hash")).alias("ast_body_hash"), F.when(~whole, F.col("hint")).alias("context_hint"), outcome.alias("outcome"), F.when(outcome == "ambiguous", F.col("fqns")).when(outcome == "unknown_symbol", F.coalesce("known", none)).otherwise(none).alias("candidates"))
