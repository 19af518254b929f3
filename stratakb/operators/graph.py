"""Code graph: name resolution, bounded lineage, map and affected views, the knowledge-graph payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import last_segment
from ..schemas import NODE_CAP


def resolution(symbols: DataFrame) -> DataFrame:
    """(name, n, first_fqn, candidates): rows, not distinct names, decide between unique and ambiguous; at most 8 candidates."""
    ranked = symbols.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("fqn", "file"))).where("k <= 8")
    return ranked.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("fqn").alias("first_fqn"), F.array_sort(F.collect_list("fqn")).alias("candidates"))


def label(n):
    return F.when(F.coalesce(n, F.lit(0)) == 0, "unresolved").when(n == 1, "unique").otherwise("ambiguous")


def resolve_names(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """names (name) with resolved and fqn: the unique or first match, else the name itself."""
    return names.join(resolution(symbols), "name", "left").select("name", label(F.col("n")).alias("resolved"), F.coalesce("first_fqn", "name").alias("fqn"), F.coalesce("n", F.lit(0)).alias("candidates"))


def capped(edges: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    """The first cap edges of each target by depth, fqn and rel, with truncated. Only cap rows of a target leave each task."""
    w = Window.partitionBy("target")
    kept = edges.withColumn("k", F.row_number().over(w.orderBy("depth", "fqn", "rel", "via"))).where(F.col("k") <= cap + 1)
    return kept.withColumn("truncated", F.max("k").over(w) > cap).where(F.col("k") <= cap).drop("k", "via")


def ancestors(targets: DataFrame, inherits: DataFrame, symbols: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    """(target, fqn, rel, resolved, depth, truncated) up to depth 2; only unique parents are followed, no child twice."""
    names = resolution(symbols).select(F.col("name").alias("parent_name"), "n", "first_fqn")

    def up(frontier: DataFrame, depth: int) -> DataFrame:
        j = frontier.join(inherits.select("child_fqn", "parent_name", "rel"), "child_fqn").join(names, "parent_name", "left")
        return j.select("target", F.coalesce("first_fqn", "parent_name").alias("fqn"), "rel", label(F.col("n")).alias("resolved"), F.lit(depth).alias("depth"), F.col("child_fqn").alias("via"))

    one = up(targets.select("target", F.col("target").alias("child_fqn")), 1)
    two = up(one.where("resolved = 'unique' and fqn != target").select("target", F.col("fqn").alias("child_fqn")).distinct(), 2)
    return capped(one.unionByName(two), cap)


def descendants(targets: DataFrame, inherits: DataFrame, calls: DataFrame, symbols: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    """Children by the target's last segment, then the target's direct callees."""
    t = targets.withColumn("leaf", last_segment(F.col("target")))
    children = t.join(inherits, t["leaf"] == inherits["parent_name"]).select("target", F.col("child_fqn").alias("fqn"), "rel", F.lit("unique").alias("resolved"), F.lit(1).alias("depth"), F.lit("0").alias("via"))
    names = resolution(symbols).select(F.col("name").alias("callee_name"), "n", "first_fqn")
    callees = targets.join(calls, F.col("target") == F.col("caller_fqn")).join(names, "callee_name", "left").select("target", F.coalesce("first_fqn", "callee_name").alias("fqn"), F.lit("calls").alias("rel"), label(F.col("n")).alias("resolved"), F.lit(1).alias("depth"), F.lit("1").alias("via"))
    return capped(children.unionByName(callees), cap)


def callers(targets: DataFrame, calls: DataFrame, cap: int = NODE_CAP) -> DataFrame:
    t = targets.withColumn("leaf", last_segment(F.col("target")))
    found = t.join(calls.select("caller_fqn", "callee_name").distinct(), t["leaf"] == F.col("callee_name")).select("target", F.col("caller_fqn").alias("fqn"), F.lit("calls").alias("rel"), F.lit("unique").alias("resolved"), F.lit(1).alias("depth"), F.lit("").alias("via"))
    return capped(found.distinct(), cap)


def first_k(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("k") <= k).drop("k")


def visible_memories(entries: DataFrame, archived: DataFrame) -> DataFrame:
    return entries.where("status != 'superseded'").join(archived.select(F.col("entry_id").alias("id")), "id", "left_anti")


def map_files(targets: DataFrame, symbols: DataFrame, calls: DataFrame, entries: DataFrame, anchors: DataFrame, archived: DataFrame) -> DataFrame:
    """(target, part, key, detail) of files: outline, up to 100 calls and the 20 latest memories, each with the honest total."""
    t = targets.select(F.col("target").alias("file"))

    def part(name: str, rows: DataFrame, order: list, cap: int | None) -> DataFrame:
        totals = rows.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
        rows = (first_k(rows, "file", order, cap) if cap else rows).join(totals, "file")
        return rows.select(F.col("file").alias("target"), F.lit(name).alias("part"), "key", "detail", F.col("total").cast("long").alias("total"))

    outline = symbols.join(t, "file", "left_semi").select("file", F.col("fqn").alias("key"), F.concat_ws(":", "kind", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("detail"))
    called = calls.join(t, "file", "left_semi").select("file", F.col("caller_fqn").alias("key"), F.col("callee_name").alias("detail"))
    memories = anchors.join(t, "file", "left_semi").select("file", F.col("entry_id").alias("id")).distinct().join(visible_memories(entries, archived), "id").select("file", F.col("id").alias("key"), F.concat_ws(":", "kind", "status").alias("detail"))
    return part("symbol", outline, ["key"], None).unionByName(part("call", called, ["key", "detail"], 100)).unionByName(part("memory", memories, [F.desc("key")], 20))


def map_symbols(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target, fqn, kind, file): the first 20 symbols with that fqn or name."""
    by = symbols.select(F.col("fqn").alias("target"), "fqn", "kind", "file", "id").union(symbols.where("name != fqn").select(F.col("name").alias("target"), "fqn", "kind", "file", "id"))
    return first_k(by.join(targets.select("target").distinct(), "target", "left_semi"), "target", ["fqn", "id"], 20).drop("id")


def symbol_details(targets: DataFrame, symbols: DataFrame, calls: DataFrame, entries: DataFrame, anchors: DataFrame, archived: DataFrame) -> DataFrame:
    """(target, fqn, kind, file, start_line, end_line, calls, calls_total, memories) of the symbols of map_symbols: the first 100 names each calls, the latest 20 memories on it."""
    found = map_symbols(targets, symbols).join(symbols.select("fqn", "file", "kind", "start_line", "end_line"), ["fqn", "file", "kind"])
    wanted = found.select("fqn").distinct()
    called = calls.select(F.col("caller_fqn").alias("fqn"), "callee_name").join(wanted, "fqn", "left_semi").distinct()
    names = first_k(called, "fqn", ["callee_name"], 100).groupBy("fqn").agg(F.array_sort(F.collect_list("callee_name")).alias("calls")).join(called.groupBy("fqn").agg(F.count(F.lit(1)).alias("calls_total")), "fqn")
    on = anchors.select(F.col("symbol_fqn").alias("fqn"), F.col("entry_id").alias("id")).join(wanted, "fqn", "left_semi").distinct().join(visible_memories(entries, archived), "id").select("fqn", "id", "kind", "status")
    held = first_k(on, "fqn", [F.desc("id")], 20).groupBy("fqn").agg(F.reverse(F.array_sort(F.collect_list(F.struct("id", "kind", "status")))).alias("memories"))
    return found.join(names, "fqn", "left").join(held, "fqn", "left").select("target", "fqn", "kind", "file", "start_line", "end_line", "calls", F.coalesce("calls_total", F.lit(0)).alias("calls_total"), "memories")


def affected(changed: DataFrame, symbols: DataFrame, entries: DataFrame, anchors: DataFrame, archived: DataFrame) -> DataFrame:
    """(part, id, file, kind, status) for changed (file): up to 50 symbols of each file and every visible memory on it (decisions constrain)."""
    hit = first_k(symbols.join(changed, "file", "left_semi"), "file", ["fqn", "id"], 50).select(F.lit("symbol").alias("part"), F.col("fqn").alias("id"), "file", "kind", F.lit(None).cast("string").alias("status"))
    on = anchors.join(changed, "file", "left_semi").groupBy(F.col("entry_id").alias("id")).agg(F.min("file").alias("file"))
    memories = visible_memories(entries, archived).join(on, "id").select(F.when(F.col("kind") == "decision", "decision").otherwise("memory").alias("part"), "id", "file", "kind", "status")
    return hit.unionByName(memories)


def graph_nodes(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, type, kind, status, conf, file): every entry, archived ones too, and each anchor target once (its first anchor decides)."""
    memory = entries.select("id", F.lit("memory").alias("type"), "kind", "status", F.round("confidence", 2).alias("conf"), F.lit(None).cast("string").alias("file"))
    target = anchors.select(F.coalesce("symbol_fqn", "file").alias("t"), F.when(F.col("symbol_fqn").isNotNull(), "symbol").otherwise("file").alias("type"), "file", F.col("id").alias("n")).groupBy("t").agg(F.min_by("type", "n").alias("type"), F.min_by("file", "n").alias("file"))
    none = F.lit(None).cast("string")
    return memory.unionByName(target.select(F.col("t").alias("id"), "type", none.alias("kind"), none.alias("status"), F.lit(None).cast("double").alias("conf"), "file"))


def graph_edges(anchors: DataFrame, links: DataFrame) -> DataFrame:
    return anchors.select(F.col("entry_id").alias("from_id"), F.coalesce("symbol_fqn", "file").alias("to_id"), F.lit("anchor").alias("rel")).unionByName(links.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "rel"))


def graph_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("active", "stale", "invalidated", "superseded")])


def shown(nodes: DataFrame, edges: DataFrame, *, kinds: list[str] | None = None, only_stale: bool = False) -> DataFrame:
    """The nodes a view shows: memories of the kinds (stale and invalidated ones only, if so asked), and code nodes attached to one of them."""
    m = nodes.where("type = 'memory'")
    m = m.where(F.col("kind").isin(kinds)) if kinds is not None else m
    m = m.where(F.col("status").isin("stale", "invalidated")) if only_stale else m
    attached = edges.where("rel = 'anchor'").join(m.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    return m.unionByName(nodes.where("type != 'memory'").join(attached, "id", "left_semi"))


def all_projects(projects: dict[str, DataFrame]) -> DataFrame:
    """Node tables of several projects as one, ids prefixed by the project's key."""
    out = None
    for key, nodes in sorted(projects.items()):
        one = nodes.withColumn("id", F.concat(F.lit(f"{key}:"), F.col("id"))).withColumn("project", F.lit(key))
        out = one if out is None else out.unionByName(one)
    return out
