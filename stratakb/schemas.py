"""Table schemas, value domains and constants of the knowledge store."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

S, L, D, B = StringType(), LongType(), DoubleType(), BooleanType()


def _t(*cols: tuple) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


ENTRIES = _t(
    ("id", S), ("kind", S), ("body", S), ("created_at", S), ("updated_at", S), ("source", S), ("confidence", D), ("status", S), ("stale_reason", S),
    ("branch", S), ("evidence_cmd", S), ("evidence_digest", S), ("evidence_ran_at", S), ("private", B), ("origin", S),
)
ANCHORS = _t(("id", L), ("entry_id", S), ("file", S), ("symbol_fqn", S), ("ast_body_hash", S), ("context_hint", S))
LINKS = _t(("src", S), ("dst", S), ("rel", S))
FILES = _t(("path", S), ("lang", S), ("mtime_ns", L), ("size", L), ("hash", S), ("parse_ok", B))
SYMBOLS = _t(
    ("id", L), ("fqn", S), ("name", S), ("kind", S), ("file", S), ("start_line", L), ("end_line", L), ("body_hash", S), ("body_len", L), ("parent_fqn", S), ("ordinal", L)
)
IMPORTS = _t(("file", S), ("target", S))
CALLS = _t(("caller_fqn", S), ("callee_name", S), ("file", S))
INHERITS = _t(("child_fqn", S), ("parent_name", S), ("rel", S), ("file", S))
ARCHIVED = _t(("entry_id", S), ("archived_at", S))
META = _t(("k", S), ("v", S))
LEDGER = _t(("ts", S), ("query_hash", S), ("served", L), ("baseline", L), ("reads_avoided", L))
TABLES = {
    "entries": ENTRIES, "anchors": ANCHORS, "links": LINKS, "files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "calls": CALLS, "inherits": INHERITS, "archived": ARCHIVED, "meta": META, "ledger": LEDGER,
}
CHANGE = StructType(
    [StructField(f.name, f.dataType) for f in ENTRIES if f.name != "private"]
    + [
        StructField("archived", B),
        StructField("anchors", ArrayType(_t(("file", S), ("symbol_fqn", S), ("ast_body_hash", S), ("context_hint", S)))),
        StructField("links", ArrayType(_t(("dst", S), ("rel", S)))),
    ]
)

# The store's domains and limits.
KINDS = ["fact", "decision", "episode", "insight", "intent"]
SOURCES = ["explicit", "mined", "verified"]
STATUSES = ["active", "stale", "invalidated", "superseded"]
RELS = ["supports", "contradicts", "supersedes"]
MAX_BODY, MAX_ORIGIN, MAX_LINE, MAX_SKEW_S = 64 * 1024, 256, 1024 * 1024, 3600
FILE_FLOOR, BODY_FLOOR = 34, 124
RECALL_FLOOR, CANDIDATES, ITEM_OVERHEAD, SEARCH_OVERHEAD, QUERY_TERMS = 0.35, 200, 30, 300, 12
SWEEP_BUDGET, NODE_CAP, LINEAGE_DEPTH = 32, 40, 2
EMPTY_REASON = "anchor_deleted"
