"""The driver's tables seen as a knowledge store, in Spark and in SQL side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import short_hash
from ..runtime import table
from ..schemas import KINDS

NOW = "2024-07-01T00:00:00Z"


class View:
    """Lazily built tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def entries(self) -> DataFrame:
        d = self.raw("documents").join(self.raw("labels"), "doc_id", "left")
        i = F.col("doc_id")
        source = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "mined").otherwise("explicit")
        day = lambda n: F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")
        status = F.when(i % 17 == 3, "superseded").when(F.col("toxic") == 1, "stale").when(i % 19 == 4, "invalidated").otherwise("active")
        verified = F.col("quality") == 1
        null = F.lit(None).cast("string")
        return d.select(
            i.cast("string").alias("id"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (i % 5 + 1).cast("int")).alias("kind"), F.col("text").alias("body"), day(i % 1000).alias("created_at"), day(i % 1000 + i % 7).alias("updated_at"), source.alias("source"),
            F.round((i % 100) / 100.0, 6).alias("confidence"), status.alias("status"), F.when(status == "stale", "body_edited").when(status == "invalidated", "anchor_deleted").alias("stale_reason"), null.alias("branch"),
            F.when(verified, F.concat(F.lit("check "), i.cast("string"))).alias("evidence_cmd"), null.alias("evidence_digest"), F.when(verified, day(i % 1000 + i % 30)).alias("evidence_ran_at"), (i % 23 == 0).alias("private"), F.when(i % 2 == 0, F.concat(F.lit("doc:"), i.cast("string"))).alias("origin"),
        )

    def anchors(self) -> DataFrame:
        d = self.raw("documents")
        null = F.lit(None).cast("string")
        return d.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("entry_id"), F.concat_ws("/", "source", "lang").alias("file"), null.alias("symbol_fqn"), null.alias("ast_body_hash"), null.alias("context_hint"))

    def archived(self) -> DataFrame:
        return self.raw("documents").where("doc_id % 13 = 0").select(F.col("doc_id").cast("string").alias("entry_id"), F.lit(NOW).alias("archived_at"))

    def links(self) -> DataFrame:
        d = self.raw("documents").select("doc_id")
        rel = F.element_at(F.array(*[F.lit(r) for r in ("supports", "contradicts", "supersedes")]), (F.col("doc_id") % 3 + 1).cast("int"))
        return d.where("doc_id % 4 = 1").select(F.col("doc_id").cast("string").alias("src"), (F.col("doc_id") - 1).cast("string").alias("dst"), rel.alias("rel"))

    def files(self) -> DataFrame:
        d = self.raw("documents").groupBy(F.concat_ws("/", "source", "lang").alias("path")).agg(F.sum("n_chars").cast("long").alias("size"), F.max("lang").alias("lang"))
        return d.select("path", "lang", F.lit(0).cast("long").alias("mtime_ns"), "size", short_hash(F.col("path")).alias("hash"), F.lit(True).alias("parse_ok"))

    def imports(self) -> DataFrame:
        p = self.raw("pages")
        file = F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string"), F.lit("/"), F.regexp_extract("url", "/(en|fr|de|es)/", 1))
        return p.select(file.alias("file"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target")).distinct()

    def queries(self) -> DataFrame:
        b = self.raw("benchmark")
        i = F.col("item_id")
        ws = F.array(F.concat(F.lit("src"), (i % 20).cast("string"), F.lit("/en")), F.concat(F.lit("src"), (i % 7 + 1).cast("string"), F.lit("/fr")))
        return b.select(i.cast("string").alias("query_id"), F.col("text").alias("task"), ws.alias("working_set"), (i % 5 * 600 + 1500).cast("long").alias("budget"), F.lit(NOW).alias("now"))

    def symbols(self) -> DataFrame:
        place = lambda df, prefix, name, key, file: df.select(F.concat(F.lit(prefix), F.col(name)).alias("fqn"), F.col(name).alias("name"), F.lit("class").alias("kind"), F.lit(file).alias("file"), F.col(key).cast("long").alias("start_line"), (F.col(key) + 9).cast("long").alias("end_line"), F.col(key).cast("long").alias("id"))
        part = self.raw("part").select(F.concat_ws(".", "p_brand", "p_name").alias("fqn"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.col("p_type").alias("file"), F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + 9).cast("long").alias("end_line"), (F.col("p_partkey") + 1000).cast("long").alias("id"))
        return place(self.raw("nation"), "world.", "n_name", "n_nationkey", "nation").unionByName(place(self.raw("region"), "world.", "r_name", "r_regionkey", "region")).unionByName(part)

    def inherits(self) -> DataFrame:
        n, r, c = self.raw("nation"), self.raw("region"), self.raw("customer")
        of_nation = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer."), "c_name").alias("child_fqn"), F.col("n_name").alias("parent_name"), F.lit("extends").alias("rel"), F.lit("customer").alias("file"))
        return of_nation.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("world."), "n_name").alias("child_fqn"), F.col("r_name").alias("parent_name"), F.lit("extends").alias("rel"), F.lit("nation").alias("file")))

    def calls(self) -> DataFrame:
        li = self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return li.select(F.concat(F.lit("order."), (F.col("l_orderkey") % 1000).cast("string")).alias("caller_fqn"), F.col("p_name").alias("callee_name"), F.col("p_type").alias("file"))


_DAY = "strftime(DATE '2022-01-01' + CAST({} AS INTEGER), '%Y-%m-%dT00:00:00Z')"
SQL = {
    "entries": f"""SELECT CAST(doc_id AS VARCHAR) AS id, ['fact', 'decision', 'episode', 'insight', 'intent'][doc_id % 5 + 1] AS kind, text AS body, {_DAY.format("doc_id % 1000")} AS created_at, {_DAY.format("doc_id % 1000 + doc_id % 7")} AS updated_at,
      CASE WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'mined' ELSE 'explicit' END AS source, round((doc_id % 100) / 100.0, 6) AS confidence,
      CASE WHEN doc_id % 17 = 3 THEN 'superseded' WHEN toxic = 1 THEN 'stale' WHEN doc_id % 19 = 4 THEN 'invalidated' ELSE 'active' END AS status,
      CASE WHEN doc_id % 17 = 3 THEN NULL WHEN toxic = 1 THEN 'body_edited' WHEN doc_id % 19 = 4 THEN 'anchor_deleted' END AS stale_reason,
      CASE WHEN quality = 1 THEN 'check ' || doc_id END AS evidence_cmd, CASE WHEN quality = 1 THEN {_DAY.format("doc_id % 1000 + doc_id % 30")} END AS evidence_ran_at, doc_id % 23 = 0 AS private, CASE WHEN doc_id % 2 = 0 THEN 'doc:' || doc_id END AS origin
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "anchors": "SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS entry_id, source || '/' || lang AS file FROM documents",
    "archived": "SELECT CAST(doc_id AS VARCHAR) AS entry_id FROM documents WHERE doc_id % 13 = 0",
    "links": "SELECT CAST(doc_id AS VARCHAR) AS src, CAST(doc_id - 1 AS VARCHAR) AS dst, ['supports', 'contradicts', 'supersedes'][doc_id % 3 + 1] AS rel FROM documents WHERE doc_id % 4 = 1",
    "files": "SELECT source || '/' || lang AS path, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1",
    "imports": """SELECT DISTINCT 'src' || (page_id % 20) || '/' || regexp_extract(url, '/(en|fr|de|es)/', 1) AS file, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages""",
    "queries": f"SELECT CAST(item_id AS VARCHAR) AS query_id, text AS task, ['src' || (item_id % 20) || '/en', 'src' || (item_id % 7 + 1) || '/fr'] AS working_set, item_id % 5 * 600 + 1500 AS budget, '{NOW}' AS now FROM benchmark",
    "symbols": """SELECT 'world.' || n_name AS fqn, n_name AS name, 'class' AS kind, 'nation' AS file, n_nationkey AS start_line, n_nationkey + 9 AS end_line, n_nationkey AS id FROM nation
      UNION ALL SELECT 'world.' || r_name, r_name, 'class', 'region', r_regionkey, r_regionkey + 9, r_regionkey FROM region
      UNION ALL SELECT p_brand || '.' || p_name, p_name, 'function', p_type, p_size, p_size + 9, p_partkey + 1000 FROM part""",
    "inherits": """SELECT 'customer.' || c_name AS child_fqn, n_name AS parent_name, 'extends' AS rel FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 'world.' || n_name, r_name, 'extends' FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "calls": "SELECT 'order.' || (l_orderkey % 1000) AS caller_fqn, p_name AS callee_name, p_type AS file FROM lineitem JOIN part ON l_partkey = p_partkey",
}


def with_views(*names: str) -> str:
    """The WITH list of some of the views."""
    return ", ".join(f"v_{n} AS ({SQL[n]})" for n in names)
