"""The public operations over a store: recall, remember, map, affected, verify_queue and admin."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.guards import bad_path, write_reject
from .functions.hashing import normal_path, short_hash
from .functions.timeutil import bumped
from .functions.trust import default_confidence, quantized
from .operators import anchors as anchor_ops
from .operators import dedup, graph, ledger, merge, recall, sweep, views
from .runtime import materialize
from .schemas import ARCHIVED
from .sources import extract, files, languages
from .store import Store

IGNORE_FILE, CONFIG_FILE, SHARED_FILE = ".stratakbignore", ".stratakb.json", ".stratakb/memory.jsonl"


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Engine:
    def __init__(self, spark: SparkSession, path: str, root: str | None = None):
        self.spark, self.store, self.root = spark, Store(spark, path), root
        self._opened = self.ledger().drop("since").first().asDict()  # one row

    def _t(self, *names: str) -> list[DataFrame]:
        return [self.store.read(n) for n in names]

    def _text(self, name: str) -> str | None:
        """A file of the tree, hidden ones too; None if there is none."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _config(self, *, strict: bool) -> dict:
        """The tree's settings; wrong ones raise if strict, else the defaults hold."""
        try:
            return languages.load_config(self._text(CONFIG_FILE))
        except ValueError:
            if strict:
                raise
            return languages.load_config(None)

    def _scan(self, config: dict, *, content: bool) -> DataFrame:
        root, own = self.root.rstrip("/") + "/", self.store.path.rstrip("/") + "/"
        ignore = [x for x in (self._text(IGNORE_FILE) or "").splitlines() if x.strip()]
        return files.scan(self.spark, self.root, ignore=ignore or None, exclude=own[len(root) :] if own.startswith(root) else None, overrides=config["extensions"] or None, content=content)

    def _reindex(self, config: dict, todo: DataFrame, touched: DataFrame) -> dict[str, DataFrame]:
        """Parse the files of todo (path) once, and replace the rows of all touched paths in the derived tables."""
        fresh = extract.index(self._scan(config, content=True).join(todo, "path", "left_semi"))
        self.store.commit(**{n: sweep.replace(self.store.read(n), fresh[n], touched, "path" if n == "files" else "file") for n in ("files", "symbols", "imports", "calls", "inherits")})
        self.store.put("indexed_at", _now())
        return fresh

    def index(self, *, full: bool = False) -> dict:
        """Sweep the tree up to the budget of files, or index all of it, and resolve all anchors.

        A sweep returns the paths it parsed, how many were removed, and how many
        stay dirty with the first ten of them. A full index returns how many
        files and symbols there are and which files failed (the first ten); the
        first one imports the tree's shared memories unless its settings say no.
        """
        known, anchors, entries = self._t("files", "anchors", "entries")
        config, first = self._config(strict=full), self.store.get("indexed_at") is None
        disk = self._scan(config, content=False)
        changes = sweep.diff(known, disk)
        if full:
            gone = changes.where("change = 'removed'").select("path", F.lit("removed").alias("action"))
            planned = disk.select("path", F.lit("reindex").alias("action")).unionByName(gone)
        else:
            planned = sweep.plan(changes, anchors, entries)
        planned = materialize(planned, "planned")
        todo, touched = planned.where("action = 'reindex'").select("path"), planned.where("action != 'dirty'").select("path")
        did = {r["action"]: r["count"] for r in planned.groupBy("action").count().collect()}
        if full:
            self._reindex(config, todo, touched)
            failed = self.store.read("files").where("not parse_ok")
            out = {"files": did.get("reindex", 0), "symbols": self.store.read("symbols").count(), "failed": failed.count(), "first_failed": [r.path for r in failed.orderBy("path").limit(10).collect()]}
            shared = self._text(SHARED_FILE) if first and config["auto_import"] else None
            if shared is not None:
                rows = list(enumerate(shared.splitlines()))
                out["imported"] = self.import_(self.spark.createDataFrame(rows, "n long, value string"))
        else:
            out = {"reindex": sorted(r.path for r in todo.collect()), "removed": did.get("removed", 0)}  # the budget's paths
            if touched.limit(1).count():
                self._reindex(config, todo, touched)
            dirty = planned.where("action = 'dirty'")
            out |= {"dirty_total": did.get("dirty", 0), "dirty": [r.path for r in dirty.orderBy("path").limit(10).collect()]}
        self.resolve()
        return out

    def resolve(self) -> dict:
        anchors, entries, known, symbols = self._t("anchors", "entries", "files", "symbols")
        fates = anchor_ops.fates(anchors, entries, known, symbols).cache()
        out = anchor_ops.report(fates).first().asDict()
        self.store.commit(entries=anchor_ops.apply_fates(entries, fates), anchors=anchor_ops.apply_moves(anchors, fates))
        fates.unpersist()
        return out

    def _fresh(self) -> dict | None:
        """What a sweep before a call found; a failed one says so and claims nothing. Without a tree there is none."""
        if self.root is None:
            return None
        try:
            return self.index()
        except Exception as e:  # the call goes on with what is known
            return {"sweep_failed": str(e).splitlines()[0][:200] if str(e) else type(e).__name__}

    def recall(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(compact items, envelope) of queries (query_id, task, working_set, budget, now); the receipts go to the ledger.

        The tree is swept first; the envelope says how fresh the index is.
        """
        swept = self._fresh()
        e, a, links, imports, arch, known = self._t("entries", "anchors", "links", "imports", "archived", "files")
        rows = materialize(recall.floored(recall.scored(queries, e, a, links, imports, arch, stem=True)), "recalled")
        packs = recall.packed(rows)
        log = ledger.receipts(queries, recall.cost(packs, a, known))
        self.store.commit(ledger=self.store.read("ledger").unionByName(log))
        out = recall.envelope(queries, rows, packs)
        if swept is not None:
            number = lambda k: F.lit(len(swept[k]) if isinstance(swept.get(k), list) else swept.get(k)).cast("long")
            out = out.withColumns({"reindexed_now": number("reindex"), "removed": number("removed"), "dirty_total": number("dirty_total"), "dirty": F.array(*[F.lit(p) for p in swept.get("dirty", [])]).cast("array<string>"), "sweep_failed": F.lit("sweep_failed" in swept)})
        return recall.wire(packs, e, a), out

    def remember(self, new: DataFrame, *, now: str | None = None, force: bool = False) -> DataFrame:
        """Store new memories: (id, kind, body, source, confidence, file, symbol, evidence_cmd, evidence_output, private, origin, links).

        Instead of file and symbol there may be anchors, an array of structs of
        the two. Returns (id, outcome, detail, possible_duplicates,
        possible_conflicts): stored, or why it was refused. One anchor that
        can't be resolved refuses its memory whole. Within a call the smaller id
        comes first: a later memory with its id, its origin or, on a file of
        both, its content is refused as if the first had been stored before.
        """
        now = now or _now()
        e, a, links, symbols, known = self._t("entries", "anchors", "links", "symbols", "files")
        if "anchors" not in new.columns:
            new = new.withColumn("anchors", F.when(F.col("file").isNotNull(), F.array(F.struct("file", "symbol"))))
        spot = F.transform(F.coalesce("anchors", F.array().cast("array<struct<file:string,symbol:string>>")), lambda x: F.struct(normal_path(x["file"]).alias("file"), x["symbol"].alias("symbol")))
        rank = lambda c: F.row_number().over(Window.partitionBy(F.coalesce(c, F.concat(F.lit("\0"), F.col("id")))).orderBy("id", "body"))
        new = new.drop("file", "symbol").withColumn("anchors", spot).withColumns({"same_id": F.row_number().over(Window.partitionBy("id").orderBy("body")), "same_origin": rank(F.col("origin"))})
        taken = e.where("origin is not null").select("origin", F.lit(True).alias("taken")).distinct()
        there = e.select("id", F.lit(True).alias("there"))
        n = new.join(taken, "origin", "left").join(there, "id", "left")
        again = F.coalesce(F.col("taken"), F.lit(False)) | (F.col("origin").isNotNull() & (F.col("same_origin") > 1))
        why = write_reject(F.col("kind"), F.col("body"), F.col("source"), F.col("origin"), again, F.col("evidence_cmd"), F.col("evidence_output"))
        why = F.when(F.col("there") | (F.col("same_id") > 1), "id_duplicate").when(F.exists("anchors", lambda x: bad_path(x["file"])), "path").otherwise(why)
        n = materialize(n.withColumn("why", why).withColumn("row", F.monotonically_increasing_id()), "new-memories")
        specs = n.select("row", F.posexplode("anchors").alias("pos", "x")).select("row", "pos", F.concat_ws(":", F.col("row").cast("string"), F.col("pos").cast("string")).alias("n"), "x.file", "x.symbol")
        at = materialize(specs.select("row", "pos", "n").join(anchor_ops.resolve_anchor(specs.select("n", "file", "symbol"), symbols, known), "n"), "new-anchors")
        bad = at.where("outcome != 'ok'").groupBy("row").agg(F.min_by(F.struct(F.col("outcome").alias("anchor"), "candidates"), "pos").alias("bad"))
        n = n.join(bad, "row", "left").withColumn("why", F.coalesce("why", "bad.anchor"))
        asked = n.where("why is null and size(anchors) > 0").select(F.col("id").alias("query_id"), F.col("body").alias("task"), F.transform("anchors", lambda x: x["file"]).alias("files"))
        empty = self.spark.createDataFrame([], "id string, twin string")
        twins = empty if force else dedup.refused(asked, e, a).withColumnRenamed("query_id", "id").unionByName(dedup.twins_within(asked).withColumnRenamed("query_id", "id")).groupBy("id").agg(F.min("twin").alias("twin"))
        n = n.join(twins, "id", "left")
        n = n.withColumn("outcome", F.coalesce("why", F.when(F.col("twin").isNotNull(), "near_duplicate"), F.lit("stored"))).withColumn("detail", F.coalesce("twin", F.when(F.size("bad.candidates") > 0, F.array_join("bad.candidates", ","))))
        n = materialize(n, "judged-memories")
        good = n.where("outcome = 'stored'")
        source = F.when(F.col("evidence_cmd").isNotNull(), "verified").otherwise(F.col("source"))
        seen = F.col("evidence_cmd").isNotNull()
        rows = good.select(
            "id", "kind", "body", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), source.alias("source"), quantized(default_confidence(source, F.col("confidence"))).alias("confidence"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("stale_reason"),
            F.lit(files.branch(self.root) if self.root else None).cast("string").alias("branch"), "evidence_cmd", F.when(seen, short_hash(F.coalesce("evidence_output", F.lit("")))).alias("evidence_digest"), F.when(seen, F.lit(now)).alias("evidence_ran_at"), F.coalesce("private", F.lit(False)).alias("private"), "origin",
        )
        held = at.join(good.select("row", F.col("id").alias("entry_id")), "row").select(F.xxhash64("entry_id", "pos", "file", "symbol_fqn").alias("id"), "entry_id", "file", "symbol_fqn", "ast_body_hash", "context_hint")
        said = good.select(F.col("id").alias("src"), F.explode("links").alias("l")).select("src", "l.dst", "l.rel")
        all_links, all_entries = views.add_links(said, links, e.unionByName(rows), F.lit(now))
        near = dedup.surfaced(asked.join(good.select(F.col("id").alias("query_id")), "query_id", "left_semi"), e, a).groupBy(F.col("query_id").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("id").alias("id"), "preview"))).alias("possible_duplicates"), F.array_sort(F.collect_list(F.when(F.col("conflict"), F.struct(F.col("id").alias("id"), "preview")))).alias("possible_conflicts")
        )
        out = materialize(n.select("id", "outcome", "detail").join(near, "id", "left"), "remembered")
        self.store.commit(entries=all_entries, anchors=a.unionByName(held), links=all_links)
        return out

    def map(self, targets: DataFrame) -> dict[str, DataFrame]:
        """Parts of files, or symbols and lineage of names (target)."""
        symbols, calls, e, a, arch, inherits = self._t("symbols", "calls", "entries", "anchors", "archived", "inherits")
        return {
            "files": graph.map_files(targets, symbols, calls, e, a, arch), "symbols": graph.symbol_details(targets, symbols, calls, e, a, arch), "ancestors": graph.ancestors(targets, inherits, symbols),
            "descendants": graph.descendants(targets, inherits, calls, symbols), "callers": graph.callers(targets, calls),
        }

    def affected(self, changed: DataFrame | None = None) -> DataFrame:
        symbols, e, a, arch = self._t("symbols", "entries", "anchors", "archived")
        return graph.affected(changed if changed is not None else files.changed_files(self.spark, self.root), symbols, e, a, arch)

    def verify_queue(self) -> DataFrame:
        return views.verify_queue(*self._t("entries", "archived"))

    def status(self) -> DataFrame:
        return views.status_counts(self.store.read("entries"))

    def archive(self, id_: str, *, restore: bool = False, now: str | None = None) -> None:
        """Hide an entry or show it again; an unknown one or one already so is an error."""
        now = now or _now()
        e, arch = self._t("entries", "archived")
        if not e.where(F.col("id") == id_).count():
            raise KeyError(id_)
        if bool(arch.where(F.col("entry_id") == id_).count()) != restore:
            raise ValueError(f"{id_} is {'not ' if restore else 'already '}archived")
        kept = arch.where(F.col("entry_id") != id_)
        new = kept if restore else kept.unionByName(self.spark.createDataFrame([(id_, now)], ARCHIVED))
        stamp = F.when(F.col("id") == id_, bumped(F.lit(now), F.col("updated_at"))).otherwise(F.col("updated_at"))
        self.store.commit(archived=new, entries=e.withColumn("updated_at", stamp))

    def forget(self, id_: str) -> None:
        names = ("entries", "anchors", "links", "archived")
        gone = self.spark.createDataFrame([(id_,)], "id string")
        self.store.commit(**views.forget(gone, **dict(zip(names, self._t(*names), strict=True))))

    def export(self, path: str) -> dict:
        e, a, links, arch = self._t("entries", "anchors", "links", "archived")
        merge.export_lines(e, a, links, arch).orderBy("id").select("line").write.mode("overwrite").text(path)
        return merge.export_report(e).first().asDict()

    def import_(self, lines: DataFrame, *, now: str | None = None) -> dict:
        """Merge change lines (n, value); the counts of what became of them."""
        now = F.lit(now or _now())
        e, a, links, arch, symbols, known = self._t("entries", "anchors", "links", "archived", "symbols", "files")
        changes = merge.parse_lines(lines).select("n", "rec.*").drop("_bad")
        judged = merge.outcomes(changes, e, now).cache()
        out = merge.report(judged).first().asDict()
        all_links, dropped = merge.merged_links(judged, links, e)
        out["links_dropped"] = dropped.count()
        self.store.commit(entries=merge.merged_entries(judged, e), anchors=merge.merged_anchors(judged, a, symbols, known), links=all_links, archived=merge.merged_archived(judged, arch, now))
        judged.unpersist()
        return out

    def ledger(self, since: str | None = None) -> DataFrame:
        return ledger.totals(self.store.read("ledger"), since)

    def ledger_session(self) -> DataFrame:
        """The ledger's totals since this engine was opened."""
        return ledger.session(self.ledger(), self.spark.createDataFrame([self._opened]))

    def ledger_reset(self) -> None:
        self.store.commit(ledger=self.store.read("ledger").limit(0))

    def graph(self) -> dict[str, DataFrame]:
        e, a, links = self._t("entries", "anchors", "links")
        return {"nodes": graph.graph_nodes(e, a), "edges": graph.graph_edges(a, links), "stats": graph.graph_stats(e)}
