"""Batch recall: candidates, blended score, relevance floor, budget packing and receipts.

Every query of a batch is answered by the same plan; nothing loops on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import file_stem, token_estimate
from ..functions.timeutil import decayed
from ..functions.trust import BESIDE, BY_IMPORT, IN_SET, score
from ..runtime import materialize
from ..schemas import CANDIDATES, ITEM_OVERHEAD, RECALL_FLOOR, SEARCH_OVERHEAD
from .fts import bounded, ranked, ranks


GRAM = 3  # characters of a file stem that are looked up
STEPS = 1024  # of a text score from 0 to 1


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _grams(c: Column) -> Column:
    """All substrings of up to GRAM characters, the empty one too, each once."""
    of = lambda k: F.when(F.char_length(c) >= k, F.transform(F.sequence(F.lit(1), F.char_length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(k) for k in range(1, GRAM + 1)]))


def neighbours(queries: DataFrame, imports: DataFrame) -> DataFrame:
    """(query_id, file): what working files import, and the files whose import names a working file's stem (ASCII case ignored)."""
    imports = materialize(imports, "imports")  # read three times
    ws = queries.select("query_id", F.explode("working_set").alias("ws")).distinct()
    forward = ws.join(imports, F.col("ws") == F.col("file")).select("query_id", F.col("target").alias("file"))
    stems = ws.select("query_id", ascii_lower(file_stem(F.col("ws"))).alias("stem"))
    #: a stem is looked up by its first characters among those that stand anywhere in a target
    keyed = stems.select("stem").distinct().withColumn("gram", F.substring("stem", 1, GRAM))
    targets = imports.select("target").distinct().withColumn("folded", ascii_lower(F.col("target")))
    listed = targets.select("target", "folded", F.explode(_grams(F.col("folded"))).alias("gram"))
    named = listed.join(keyed, "gram").where(F.col("folded").contains(F.col("stem"))).select("target", "stem").distinct()
    backward = imports.join(named, "target").join(stems, "stem").select("query_id", "file")
    return forward.union(backward).distinct()


def nearness(queries: DataFrame, anchors: DataFrame, imports: DataFrame) -> DataFrame:
    """(query_id, file, near) of the files with proximity to a query: found once for a file, however many entries are anchored there."""
    working = queries.select("query_id", F.explode("working_set").alias("file"))
    first = F.split("file", "/")[0].alias("first")
    beside = anchors.select("file").distinct().select("file", first).join(working.select("query_id", first).distinct(), "first")
    at = lambda df, near: df.select("query_id", "file", F.lit(near).alias("near"))
    parts = at(working, IN_SET).union(at(neighbours(queries, imports), BY_IMPORT)).union(at(beside, BESIDE))
    return parts.groupBy("query_id", "file").agg(F.max("near").alias("near"))


def flags(status: Column, reason: Column, source: Column, command: Column, contradicted: Column) -> Column:
    """stale:, reverify:, invalidated: and contradicted-by: in this order."""
    stale = status == "stale"
    own = F.array(
        F.when(stale, F.concat(F.lit("stale:"), F.coalesce(reason, F.lit("unknown")))),
        F.when(stale & (source == "verified") & command.isNotNull(), F.concat(F.lit("reverify:"), command)),
        F.when(status == "invalidated", F.concat(F.lit("invalidated:"), F.coalesce(reason, F.lit("unknown")))),
    )
    return F.concat(F.filter(own, lambda f: f.isNotNull()), F.transform(F.coalesce(contradicted, F.array().cast("array<string>")), lambda i: F.concat(F.lit("contradicted-by:"), i)))


def contradictions(links: DataFrame) -> DataFrame:
    """(id, contradicted): both directions of the contradicts links."""
    c = links.where("rel = 'contradicts'")
    both = c.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(c.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()
    return both.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("contradicted"))


def _last_candidate(hits: DataFrame) -> DataFrame:
    """(query_id, last): rank and id of a query's match number CANDIDATES, or of its last.

    Only matches in the best steps of text that hold so many are sorted.
    """
    step = F.floor(F.col("text") * STEPS).alias("step")
    matched = hits.where("rank is not null").select("query_id", "id", "rank", step)
    better = Window.partitionBy("query_id").orderBy(F.desc("step"))
    steps = matched.groupBy("query_id", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(better) - F.col("n"))
    least = materialize(steps.where(F.col("before") < CANDIDATES).groupBy("query_id").agg(F.min("step").alias("least")), "steps")
    best = matched.join(bounded(least), "query_id").where("step >= least")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("n") <= CANDIDATES)
    return materialize(best.groupBy("query_id").agg(F.max(F.struct("rank", "id")).alias("last")), "last-candidates")


def scored(queries: DataFrame, entries: DataFrame, anchors: DataFrame, links: DataFrame, imports: DataFrame, archived: DataFrame, *, stem: bool = False) -> DataFrame:
    """A row for each (query, visible candidate) with its score, its flags and text score.

    queries: query_id, task, working_set array, budget, now.
    """
    working = queries.select("query_id", F.explode("working_set").alias("file"))
    held = anchors.select(F.col("entry_id").alias("id"), "file")
    hits = ranked(*ranks(entries, queries, stem=stem, held=held, near=working))
    last = _last_candidate(hits).withColumnRenamed("query_id", "of")
    #: all of a query's files, and its best matches up to the last
    chosen = hits.join(bounded(last), F.col("query_id") == F.col("of"), "left").where(F.col("near") | (F.struct("rank", "id") <= F.col("last")))
    #: dealt out by id once: nearness is found before what else belongs to the entry comes in
    near = bounded(materialize(nearness(queries, anchors, imports), "nearness"))
    rows = chosen.select("query_id", "id", "text").join(held, "id", "left").join(near, ["query_id", "file"], "left")
    rows = rows.groupBy("id", "query_id").agg(F.max("text").alias("text"), F.max("near").alias("near"))
    #: only what an entry's score needs, never its body
    needs = ["kind", "source", "status", "stale_reason", "evidence_cmd", "confidence", "created_at"]
    item_cost = (token_estimate(F.col("body")) + ITEM_OVERHEAD).alias("cost")
    visible = entries.where("status != 'superseded'").select("id", *needs, item_cost).join(archived.select(F.col("entry_id").alias("id")), "id", "left_anti")
    rows = rows.join(visible, "id").join(contradictions(links), "id", "left").join(bounded(queries.select("query_id", "budget", "now")), "query_id")
    text, near = F.coalesce("text", F.lit(0.0)), F.coalesce("near", F.lit(0.0))
    value = score(text, near, F.col("confidence"), F.col("created_at"), F.col("now"), F.col("kind"), F.col("source"), F.col("status"))
    return rows.select(
        "query_id", "id", "kind", "source", "status", "created_at", "budget", text.alias("text"), near.alias("near"), decayed(F.col("confidence"), F.col("created_at"), F.col("now")).alias("conf"), F.round(value, 9).alias("score"),
        flags(F.col("status"), F.col("stale_reason"), F.col("source"), F.col("evidence_cmd"), F.col("contradicted")).alias("flags"), "cost",
    )


def floored(rows: DataFrame) -> DataFrame:
    """With matched, top, cut_by_floor and relevant: below 0.35 of the top score only flagged items stay."""
    rows = materialize(rows, "scored")
    top = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("matched"), F.max("score").alias("top"))
    relevant = (F.col("top") <= 0) | (F.col("score") >= RECALL_FLOOR * F.col("top")) | (F.size("flags") > 0)
    cut = rows.select("query_id", "score", "flags").join(bounded(top), "query_id").groupBy("query_id", "matched", "top").agg(F.sum(F.when(relevant, 0).otherwise(1)).alias("cut_by_floor"))
    return rows.join(bounded(materialize(cut, "floors")), "query_id").withColumn("relevant", relevant)


def packed(rows: DataFrame) -> DataFrame:
    """The relevant items that fit the budget: best first, one that doesn't fit is skipped, the first always stays. place from 1.

    Of items of one cost at most budget / cost can be taken, and they are the
    best of them, as what doesn't fit once never fits later. So a query's items
    are cut to these, the best item of all aside, before they are folded as one
    array, whose length depends on the budget and not on the working set.
    """
    keep = rows.where("relevant")
    item = F.struct((-F.col("score")).alias("order"), F.col("id"), F.col("cost").cast("long").alias("cost"))
    best = keep.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("order"), "id"))["id"].alias("best"))
    same_cost = Window.partitionBy("query_id", "cost").orderBy(F.desc("score"), "id")
    able = keep.where(F.col("cost") <= F.col("budget")).withColumn("n", F.row_number().over(same_cost)).where(F.col("n") <= F.floor(F.col("budget") / F.col("cost")) + 1).drop("n")
    first = keep.join(bounded(best), "query_id").where((F.col("id") == F.col("best")) & (F.col("cost") > F.col("budget"))).drop("best")
    lists = able.unionByName(first.select(*able.columns)).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("budget").cast("long").alias("budget"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["ids"]) == 0) | (acc["used"] + x["cost"] <= F.col("budget"))
        return F.when(fits, F.struct((acc["used"] + x["cost"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids"))).otherwise(acc)

    chosen = materialize(lists.select("query_id", F.posexplode(F.aggregate("items", start, step)["ids"]).alias("place", "id")), "chosen")
    return keep.join(bounded(chosen), ["query_id", "id"]).withColumn("place", F.col("place") + 1)


def cost(packs: DataFrame, anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, served, baseline, reads_avoided) of packed items; saved is baseline - served and may be negative."""
    served = packs.groupBy("query_id").agg(F.sum("cost").cast("long").alias("served"))
    of = packs.select("query_id", "id", "status").join(anchors.select(F.col("entry_id").alias("id"), "file"), "id").join(files.select(F.col("path").alias("file"), "size"), "file", "left")
    per = of.groupBy("query_id", "file").agg(F.max("size").alias("size"), F.max(F.col("status") == "active").alias("active"))
    read = per.groupBy("query_id").agg(F.sum(F.ceil(F.coalesce("size", F.lit(0)) / 4)).alias("tokens"), F.count_if("active").alias("avoided"))
    return served.join(read, "query_id", "left").select("query_id", "served", (F.coalesce("tokens", F.lit(0)) + SEARCH_OVERHEAD).cast("long").alias("baseline"), F.coalesce("avoided", F.lit(0)).cast("long").alias("reads_avoided"))


def wire(packs: DataFrame, entries: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """The compact items, whose bodies come from entries: defaults are null, confidence has 2 digits, on is the day; with anchors, where each item is anchored."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    at = []
    if anchors is not None:
        held = anchors.select(F.col("entry_id").alias("id"), "file", F.col("symbol_fqn").alias("symbol")).join(packs.select("id").distinct(), "id")
        held = held.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("file", "symbol"))).alias("anchors"))
        packs, at = packs.join(held, "id", "left"), ["anchors"]
    packs = packs.join(entries.select("id", "body"), "id")
    return packs.select("query_id", "place", "id", "kind", "body", F.round("conf", 2).alias("conf"), F.when(F.col("source") != "explicit", F.col("source")).alias("source"), F.when(F.col("status") != "active", F.col("status")).alias("status"), some("flags").alias("flags"), F.substring("created_at", 1, 10).alias("on"), *at)


def omitted_reason(matched: Column, returned: Column, cut: Column) -> Column:
    budget = matched - returned - cut
    return F.when(returned >= matched, F.lit(None).cast("string")).when((cut > 0) & (budget > 0), "budget+relevance_floor").when(cut > 0, "relevance_floor").otherwise("budget")


def envelope(queries: DataFrame, rows: DataFrame, packs: DataFrame) -> DataFrame:
    """(query_id, matched, returned, omitted_reason, stale, contradicted); rows from floored, packs from packed."""
    all_ = rows.groupBy("query_id").agg(F.max("matched").alias("matched"), F.max("cut_by_floor").alias("cut"))
    has = lambda prefix: F.exists("flags", lambda f: f.startswith(prefix))
    got = packs.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.count_if(has("stale:")).alias("stale"), F.count_if(has("contradicted-by:")).alias("contradicted"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = queries.select("query_id").join(all_, "query_id", "left").join(got, "query_id", "left").select("query_id", z("matched").alias("matched"), z("returned").alias("returned"), z("cut").alias("cut"), z("stale").alias("stale"), z("contradicted").alias("contradicted"))
    return out.select("query_id", "matched", "returned", omitted_reason(F.col("matched"), F.col("returned"), F.col("cut")).alias("omitted_reason"), "stale", "contradicted")
