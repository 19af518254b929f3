"""JSON-lines change sets: export, and guarded last-writer-wins import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.guards import import_reject
from ..functions.trust import imported_confidence
from ..schemas import CHANGE, MAX_LINE, RELS

_PAYLOAD = [f.name for f in CHANGE if f.name not in ("archived", "anchors", "links")]


def export_lines(entries: DataFrame, anchors: DataFrame, links: DataFrame, archived: DataFrame) -> DataFrame:
    """(id, line): public entries in the order of ids, keys in alphabetical order; nulls are kept, archived only where true."""
    a = anchors.groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("n"), "ast_body_hash", "context_hint", "file", "symbol_fqn"))).alias("a"))
    links_of = links.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "rel"))).alias("l"))
    hidden = archived.select(F.col("entry_id").alias("id"), F.lit(True).alias("hidden")).distinct()
    j = entries.where(~F.coalesce("private", F.lit(False))).join(a, "id", "left").join(links_of, "id", "left").join(hidden, "id", "left")
    text = lambda c: F.coalesce(F.to_json(F.array(F.col(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2), F.lit("null"))
    names = sorted([*_PAYLOAD, "anchors", "links", "archived"])
    keep_null = {"ignoreNullFields": "false"}
    part: dict[str, Column] = {n: F.concat(F.lit(f'"{n}":'), text(n)) for n in _PAYLOAD}
    part["anchors"] = F.concat(F.lit('"anchors":'), F.coalesce(F.to_json(F.transform("a", lambda x: F.struct(x["ast_body_hash"].alias("ast_body_hash"), x["context_hint"].alias("context_hint"), x["file"].alias("file"), x["symbol_fqn"].alias("symbol_fqn"))), keep_null), F.lit("[]")))
    part["links"] = F.concat(F.lit('"links":'), F.coalesce(F.to_json("l", keep_null), F.lit("[]")))
    part["archived"] = F.when(F.col("hidden"), '"archived":true')
    return j.select("id", F.concat(F.lit("{"), F.concat_ws(",", *[part[n] for n in names]), F.lit("}")).alias("line"))


def export_report(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if(~F.coalesce("private", F.lit(False))).alias("exported"), F.count_if("private").alias("private_withheld"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(n, rec struct) of (n, value); blank lines are passed over. A malformed line, one without id or one too long raises: nothing is imported."""
    rec = F.from_json("value", StructType([*CHANGE, StructField("_bad", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select("n", "value", rec.alias("rec"))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"line {why}: "), F.col("n").cast("string")))
    checked = F.when(F.octet_length("value") > MAX_LINE, fail("too long")).when(F.col("rec").isNull() | F.col("rec._bad").isNotNull(), fail("not JSON")).when(F.col("rec.id").isNull(), fail("without id"))
    return rows.select("n", "rec", checked.cast("string").alias("fault")).where("fault is null").drop("fault")


def outcomes(changes: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """changes (n and the columns of a change) with reject_reason and outcome: rejected, added, updated or skipped.

    A line's outcome depends on those before it: the newest stamp of its id so
    far, stored or accepted, decides. One window over an id replaces the
    sequential loop; ids are independent, so it scales with them.
    """
    c = changes.withColumn("reject_reason", import_reject({k: F.col(k) for k in ("body", "evidence_cmd", "source", "updated_at", "kind", "status", "origin")}, now))
    #: a line without an origin is a key of its own, so that they don't all meet in one task
    c = c.withColumn("__key", F.coalesce(F.concat(F.lit("o"), F.col("origin")), F.concat(F.lit("n"), F.col("n").cast("string"))))
    owners = entries.where("origin is not null").select(F.concat(F.lit("o"), F.col("origin")).alias("__key"), F.col("id").alias("owner"))
    c = c.join(owners, "__key", "left")
    first = F.first(F.when(F.col("reject_reason").isNull(), F.col("id")), ignorenulls=True).over(Window.partitionBy("__key").orderBy("n"))
    owner = F.when(F.col("origin").isNotNull(), F.coalesce("owner", first))
    c = c.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & owner.isNotNull() & (owner != F.col("id")), "origin_clash").otherwise(F.col("reject_reason"))).drop("owner", "__key")
    c = c.join(entries.select("id", F.col("updated_at").alias("stored")), "id", "left")
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.greatest("stored", F.max(F.when(F.col("reject_reason").isNull(), F.col("updated_at"))).over(before))
    c = c.withColumn("prior", newest)
    outcome = F.when(F.col("reject_reason").isNotNull(), "rejected").when(F.col("prior").isNull(), "added").when(F.col("updated_at") > F.col("prior"), "updated").otherwise("skipped")
    return c.withColumn("outcome", outcome).drop("prior", "stored")


def merged_entries(judged: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries after the merge: an id's last accepted line wins; an absent origin and private keep what is stored."""
    won = judged.where(F.col("outcome").isin("added", "updated"))
    last = won.groupBy("id").agg(F.max_by(F.struct(*[F.col(c) for c in _PAYLOAD if c not in ("id", "origin")]), "n").alias("w"), F.max_by("origin", F.when(F.col("origin").isNotNull(), F.col("n"))).alias("new_origin"))
    j = entries.join(last, "id", "full_outer")
    default = {"created_at": F.lit(""), "kind": F.lit("insight"), "status": F.lit("active"), "source": F.lit("explicit")}
    out = []
    for c in entries.columns:
        if c == "id":
            col = F.col("id")
        elif c == "private":
            col = F.coalesce("private", F.lit(False))
        elif c == "origin":
            col = F.coalesce("new_origin", "origin")
        else:
            new = F.col(f"w.{c}")
            new = imported_confidence(F.coalesce(F.col("w.source"), F.lit("explicit")), new) if c == "confidence" else F.coalesce(new, default[c]) if c in default else new
            col = F.when(F.col("w").isNotNull(), new).otherwise(F.col(c))
        out.append(col.alias(c))
    return j.select(*out)


def merged_anchors(judged: DataFrame, anchors: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The winners' anchors replace the stored ones; a symbol or file known here lends its own hash, whatever the line claims."""
    won = judged.where(F.col("outcome").isin("added", "updated")).groupBy("id").agg(F.max_by("anchors", "n").alias("anchors"))
    new = won.select(F.col("id").alias("entry_id"), F.posexplode("anchors").alias("pos", "a")).select("entry_id", "pos", "a.file", "a.symbol_fqn", "a.ast_body_hash", "a.context_hint")
    by_name = symbols.groupBy(F.col("fqn").alias("symbol_fqn")).agg(F.min_by("body_hash", "id").alias("of_symbol"))
    by_path = files.groupBy(F.col("path").alias("file")).agg(F.min("hash").alias("of_file"))
    j = new.join(by_name, "symbol_fqn", "left").join(by_path, "file", "left")
    here = F.coalesce(F.when(F.col("symbol_fqn").isNotNull(), F.col("of_symbol")).otherwise(F.col("of_file")), F.col("ast_body_hash"))
    fresh = j.select(F.xxhash64("entry_id", "pos").alias("id"), "entry_id", "file", "symbol_fqn", here.alias("ast_body_hash"), "context_hint")
    return anchors.join(won.select(F.col("id").alias("entry_id")), "entry_id", "left_anti").select(*anchors.columns).unionByName(fresh)


def merged_links(judged: DataFrame, links: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links after the merge, dropped ones): a link merges even if its line is skipped; its target must be stored, or accepted on this line or before."""
    said = judged.where("outcome != 'rejected'").select("n", F.col("id").alias("src"), F.explode("links").alias("l")).select("n", "src", "l.dst", F.coalesce("l.rel", F.lit("supports")).alias("rel"))
    there = entries.select(F.col("id").alias("dst"), F.lit(-1).cast("long").alias("since")).union(judged.where("outcome = 'added'").select(F.col("id").alias("dst"), F.col("n").cast("long").alias("since"))).groupBy("dst").agg(F.min("since").alias("since"))
    j = said.join(there, "dst", "left")
    ok = F.coalesce(F.col("since") <= F.col("n"), F.lit(False)) & F.col("rel").isin(RELS)
    return links.unionByName(j.where(ok).select("src", "dst", "rel")).distinct(), j.where(~ok).select("n", "src", "dst", "rel")


def merged_archived(judged: DataFrame, archived: DataFrame, now: Column) -> DataFrame:
    """Winning lines dictate visibility: true archives, absent or false restores."""
    won = judged.where(F.col("outcome").isin("added", "updated")).groupBy("id").agg(F.max_by(F.coalesce("archived", F.lit(False)), "n").alias("hide"), F.max(F.coalesce("archived", F.lit(False))).alias("any"))
    kept = archived.join(won.where("not hide").select(F.col("id").alias("entry_id")), "entry_id", "left_anti")
    new = won.where("hide").join(archived.select(F.col("entry_id").alias("id")), "id", "left_anti").select(F.col("id").alias("entry_id"), now.alias("archived_at"))
    return kept.select("entry_id", "archived_at").unionByName(new)


def report(judged: DataFrame) -> DataFrame:
    return judged.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "updated", "skipped", "rejected")])
