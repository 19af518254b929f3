"""State transitions, merges, packing, graph bounds and sweeps on small tables."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratakb.functions.timeutil import iso_seconds
from stratakb.operators import anchors, dedup, graph, ledger, merge, recall, sweep, views
from stratakb.schemas import ANCHORS, ARCHIVED, CALLS, ENTRIES, FILES, IMPORTS, INHERITS, LINKS, SYMBOLS

T0 = "2024-06-01T00:00:00Z"


def rows(spark, schema, *dicts):
    return spark.createDataFrame([tuple(d.get(f.name) for f in schema) for d in dicts], schema)


def entry(id_, **k):
    return {"id": id_, "kind": "fact", "body": "a body", "created_at": T0, "updated_at": T0, "source": "explicit", "confidence": 0.8, "status": "active", "private": False} | k


def test_fates(spark):
    """Every row of the decision table, and what becomes of the entries."""
    e = [entry(x) for x in "abcdefghijklmnop"] + [entry("v", source="verified", confidence=0.95), entry("s", status="superseded"), entry("multi"), entry("gone", status="invalidated"), entry("old", status="stale", confidence=0.48)]
    sym = lambda i, fqn, h, n=500: {"id": i, "fqn": fqn, "name": fqn.split(".")[-1], "file": fqn.split(".")[0], "body_hash": h, "body_len": n, "kind": "function"}
    symbols = rows(spark, SYMBOLS, sym(1, "m.same", "H1"), sym(2, "m.edited", "H2x"), sym(3, "n.moved", "H3"), sym(4, "n.tiny", "H4", 10), sym(5, "n.t1", "H5"), sym(6, "n.t2", "H5"), sym(7, "n.old", "H6", None))
    files = rows(spark, FILES, {"path": "same", "hash": "F1", "size": 99}, {"path": "edited", "hash": "F2x", "size": 99}, {"path": "new/place", "hash": "F3", "size": 99}, {"path": "tiny", "hash": "F4", "size": 3}, {"path": "d1", "hash": "F5", "size": 99}, {"path": "d2", "hash": "F5", "size": 99})
    a = lambda i, e, file, fqn=None, h=None: {"id": i, "entry_id": e, "file": file, "symbol_fqn": fqn, "ast_body_hash": h}
    held = rows(
        spark, ANCHORS, a(1, "a", "m", "m.same", "H1"), a(2, "b", "m", "m.edited", "H2"), a(3, "c", "m", "m.was", "H3"), a(4, "d", "m", "m.was", "H4"), a(5, "e", "m", "m.was", "H5"), a(6, "f", "m", "m.was", "H6"), a(7, "g", "m", "m.was", "H7"), a(8, "h", "m", "m.same"),
        a(9, "i", "same", h="F1"), a(10, "j", "edited", h="F2"), a(11, "k", "was", h="F3"), a(12, "l", "was", h="F4"), a(13, "m", "was", h="F5"), a(14, "n", "was", h="F6"), a(15, "o", "same"), a(16, "p", "was"), a(17, "v", "edited", h="F2"), a(18, "s", "edited", h="F2"),
        a(19, "multi", "was", h="F9"), a(20, "multi", "same", h="F1"), a(21, "gone", "same", h="F1"), a(22, "old", "edited", h="F2"),
    )
    entries = rows(spark, ENTRIES, *e)
    got = anchors.fates(held, entries, files, symbols).cache()
    fate = {r.id: (r.fate, r.reason) for r in got.collect()}
    assert fate == {
        1: ("fresh", None), 2: ("stale", "body_edited"), 3: ("followed", None), 4: ("stale", "low_entropy"), 5: ("stale", "ambiguous_anchor"), 6: ("followed", None), 7: ("invalidated", None), 8: ("stale", "missing_hash"), 9: ("fresh", None), 10: ("stale", "file_edited"), 11: ("followed", None),
        12: ("stale", "low_entropy"), 13: ("stale", "ambiguous_anchor"), 14: ("invalidated", None), 15: ("fresh", None), 16: ("invalidated", None), 17: ("stale", "file_edited"), 19: ("invalidated", None), 20: ("fresh", None), 21: ("fresh", None), 22: ("stale", "file_edited"),
    }
    moved = {r.id: (r.file, r.symbol_fqn, r.ast_body_hash) for r in anchors.apply_moves(held, got).collect()}
    assert moved[3] == ("n", "n.moved", "H3") and moved[11] == ("new/place", None, "F3") and moved[15] == ("same", None, "F1") and moved[18] == ("edited", None, "F2") and len(moved) == 22
    after = {r.id: (r.status, r.stale_reason, r.confidence) for r in anchors.apply_fates(entries, got).collect()}
    assert after["a"] == ("active", None, 0.8) and after["b"] == ("stale", "body_edited", 0.48) and after["v"] == ("stale", "file_edited", 0.5) and after["g"] == ("invalidated", "anchor_deleted", 0.8)
    assert after["s"] == ("superseded", None, 0.8) and after["multi"] == ("stale", "anchor_lost", 0.48) and after["gone"] == ("active", None, 0.8) and after["old"] == ("stale", "file_edited", 0.48)
    assert anchors.report(got).first().asDict() == {"fresh": 5, "followed": 3, "stale": 9, "invalidated": 4}


def change(n, id_, stamp, **k):
    return {"n": n, "id": id_, "updated_at": stamp, "created_at": T0, "body": "text", "kind": "fact", "source": "explicit", "status": "active", "confidence": 0.7} | k


def changes(spark, *items):
    import json

    lines = spark.createDataFrame([(i["n"], json.dumps({k: v for k, v in i.items() if k != "n"})) for i in items], "n long, value string")
    return merge.parse_lines(lines).select("n", "rec.*").drop("_bad")


def test_merge_matches_a_sequential_loop(spark):
    r = random.Random(4)
    stamp = lambda d: f"2024-05-{d:02d}T00:00:00Z"
    items = [change(n, f"e{r.randrange(6)}", stamp(r.randrange(1, 25)), kind=r.choice(["fact", "fact", "rumour"])) for n in range(60)]
    stored = {f"e{i}": stamp(10) for i in range(3)}
    state, expected = dict(stored), {}
    for i in items:
        cur = state.get(i["id"])
        expected[i["n"]] = "rejected" if i["kind"] == "rumour" else "added" if cur is None else "updated" if i["updated_at"] > cur else "skipped"
        if expected[i["n"]] in ("added", "updated"):
            state[i["id"]] = i["updated_at"]
    entries = rows(spark, ENTRIES, *[entry(k, updated_at=v, origin=f"o{k}", private=True) for k, v in stored.items()])
    judged = merge.outcomes(changes(spark, *items), entries, F.lit(T0)).cache()
    assert {x.n: x.outcome for x in judged.collect()} == expected
    merged = {x.id: x for x in merge.merged_entries(judged, entries).collect()}
    assert {k: x.updated_at for k, x in merged.items()} == state
    assert all(merged[k].origin == f"o{k}" and merged[k].private for k in stored)


def test_merge_rules(spark):
    entries = rows(spark, ENTRIES, entry("a", origin="o:a"), entry("b"))
    items = [
        change(0, "x", "9999-01-01T00:00:00Z"), change(1, "x", "2024-05-01T00:00:00Z", body="key ghp_" + "a" * 30), change(2, "x", "2024-05-01T00:00:00Z", confidence=1e300, links=[{"dst": "y", "rel": "supports"}, {"dst": "b", "rel": "likes"}, {"dst": "a", "rel": "supersedes"}], archived=True),
        change(3, "y", "2024-05-01T00:00:00Z", source="verified", evidence_cmd="make", confidence=1.0, anchors=[{"file": "f", "symbol_fqn": None, "ast_body_hash": "forged"}]), change(4, "z", "2024-05-01T00:00:00Z", origin="o:a"), change(5, "y", "2024-05-01T00:00:00Z", links=[{"dst": "x", "rel": "contradicts"}]), change(6, "w", "2024-05-01T00:00:00Z", source="verified"),
    ]
    judged = merge.outcomes(changes(spark, *items), entries, F.lit(T0)).cache()
    assert {x.n: (x.outcome, x.reject_reason) for x in judged.collect()} == {0: ("rejected", "future"), 1: ("rejected", "secret"), 2: ("added", None), 3: ("added", None), 4: ("rejected", "origin_clash"), 5: ("skipped", None), 6: ("rejected", "verified_without_evidence")}
    conf = {x.id: x.confidence for x in merge.merged_entries(judged, entries).collect()}
    assert conf["x"] == 0.85 and conf["y"] == 0.95
    links, dropped = merge.merged_links(judged, rows(spark, LINKS), entries)
    assert {tuple(x) for x in links.collect()} == {("x", "a", "supersedes"), ("y", "x", "contradicts")} and {x.dst for x in dropped.collect()} == {"y", "b"}
    held = merge.merged_anchors(judged, rows(spark, ANCHORS), rows(spark, SYMBOLS), rows(spark, FILES, {"path": "f", "hash": "ours"})).collect()
    assert [(x.entry_id, x.ast_body_hash) for x in held] == [("y", "ours")]
    hidden = merge.merged_archived(judged, rows(spark, ARCHIVED, {"entry_id": "y", "archived_at": T0}), F.lit(T0))
    assert [x.entry_id for x in hidden.collect()] == ["x"]


@pytest.mark.parametrize("line", ['{"id": "a"', "[1]", '{"kind": "fact"}'])
def test_a_malformed_line_stops_the_import(spark, line):
    with pytest.raises(Exception, match="line"):
        merge.parse_lines(spark.createDataFrame([(1, line)], "n long, value string")).collect()


def test_round_trip(spark):
    e = rows(spark, ENTRIES, entry("b", body='quote " and\nline'), entry("a", origin="o"), entry("p", private=True))
    a, links = rows(spark, ANCHORS, {"id": 2, "entry_id": "a", "file": "f"}, {"id": 1, "entry_id": "a", "file": "g"}), rows(spark, LINKS, {"src": "b", "dst": "a", "rel": "supports"})
    hidden = rows(spark, ARCHIVED, {"entry_id": "a", "archived_at": T0})
    lines = [r.line for r in merge.export_lines(e, a, links, hidden).orderBy("id").collect()]
    assert len(lines) == 2 and '"archived":true' in lines[0] and "archived" not in lines[1] and lines[0].index('"file":"g"') < lines[0].index('"file":"f"')
    back = merge.parse_lines(spark.createDataFrame(list(enumerate(lines)), "n int, value string")).select("n", "rec.*").drop("_bad")
    none = rows(spark, ENTRIES)
    judged = merge.outcomes(back, none, F.lit("2024-07-01T00:00:00Z")).cache()
    e2, a2 = merge.merged_entries(judged, none), merge.merged_anchors(judged, rows(spark, ANCHORS), rows(spark, SYMBOLS), rows(spark, FILES))
    kept, dropped = merge.merged_links(judged, rows(spark, LINKS), none)
    assert dropped.count() == 0 or {r.dst for r in dropped.collect()} <= {"a"}
    again = [r.line for r in merge.export_lines(e2, a2.withColumn("id", F.when(F.col("file") == "g", 1).otherwise(2)), links, merge.merged_archived(judged, rows(spark, ARCHIVED), F.lit(T0))).orderBy("id").collect()]
    assert again == lines
    assert {r.outcome for r in merge.outcomes(back, e2, F.lit("2024-07-01T00:00:00Z")).collect()} == {"skipped"}
    assert merge.export_report(e).first().asDict() == {"exported": 2, "private_withheld": 1}
    del kept


def test_packing_skips_what_does_not_fit(spark):
    make = lambda costs, budget: spark.createDataFrame([("q", chr(97 + i), 1.0 - i / 10, c, budget, True) for i, c in enumerate(costs)], "query_id string, id string, score double, cost long, budget long, relevant boolean")
    got = lambda costs, budget: [r.id for r in recall.packed(make(costs, budget)).orderBy("place").collect()]
    assert got([100, 500, 150], 300) == ["a", "c"] and got([900, 10], 300) == ["a"] and got([100, 100, 100], 300) == ["a", "b", "c"]


def test_cost(spark):
    packs = spark.createDataFrame([("q", "a", "active", 32), ("r", "b", "stale", 50), ("r", "c", "active", 50), ("s", "d", "active", 40)], "query_id string, id string, status string, cost long")
    held = rows(spark, ANCHORS, *[{"id": i, "entry_id": e, "file": f} for i, (e, f) in enumerate([("a", "big"), ("b", "x"), ("c", "x"), ("c", "y")])])
    files = rows(spark, FILES, {"path": "big", "size": 4000}, {"path": "x", "size": 400}, {"path": "y", "size": 800})
    got = {r.query_id: (r.served, r.baseline, r.reads_avoided) for r in recall.cost(packs, held, files).collect()}
    assert got == {"q": (32, 1300, 1), "r": (100, 600, 2), "s": (40, 300, 0)}


def test_recall(spark):
    bodies = {"a": "the queue batch size is fifty", "b": "the csv export uses semicolons", "c": "download tokens are valid for an hour", "d": "the queue once lost its jobs", "e": "unrelated words entirely"}
    e = rows(spark, ENTRIES, *[entry(k, body=b, source="verified" if k == "a" else "explicit", evidence_cmd="make" if k == "a" else None, status="stale" if k in "ac" else "active", stale_reason="file_edited" if k in "ac" else None) for k, b in bodies.items()], entry("z", body="the queue batch size", status="superseded"), entry("y", body="the queue batch size"))
    held = rows(spark, ANCHORS, {"id": 1, "entry_id": "b", "file": "src/csv.py"}, {"id": 2, "entry_id": "c", "file": "src/other.py"}, {"id": 3, "entry_id": "e", "file": "lib/x.py"})
    links, hidden = rows(spark, LINKS, {"src": "d", "dst": "a", "rel": "contradicts"}), rows(spark, ARCHIVED, {"entry_id": "y", "archived_at": T0})
    imports = rows(spark, IMPORTS, {"file": "src/other.py", "target": "pkg.CSV"})
    q = spark.createDataFrame([("q", "queue batch size", ["src/csv.py"], 1000, "2024-07-01T00:00:00Z")], "query_id string, task string, working_set array<string>, budget long, now string")
    got = recall.floored(recall.scored(q, e, held, links, imports, hidden, stem=True)).cache()
    by = {r.id: r for r in got.collect()}
    assert set(by) == {"a", "b", "d"} and by["b"].near == 1.0 and by["b"].text == 0.0
    assert list(by["a"].flags) == ["stale:file_edited", "reverify:make", "contradicted-by:d"] and list(by["d"].flags) == ["contradicted-by:a"]
    first = recall.packed(got).orderBy("place").first()
    assert first.id == "a"
    env = recall.envelope(q, got, recall.packed(got)).first()
    assert (env.matched, env.returned, env.omitted_reason, env.stale, env.contradicted) == (3, 3, None, 1, 2)
    near = {r.file for r in recall.neighbours(q, imports).collect()}
    assert near == {"src/other.py"}
    log = ledger.receipts(q, recall.cost(recall.packed(got), held, rows(spark, FILES)))
    t = ledger.totals(log.unionByName(log)).first()
    assert t.recalls == 2 and t.distinct_queries == 1 and t.saved == t.baseline - t.served


def test_bm25_equals_fts5(spark):
    """SQLite's own index as an independent oracle."""
    import sqlite3

    from stratakb.operators.fts import bm25

    r = random.Random(2)
    words = ["running", "runs", "queue", "queues", "batch", "verify", "nonce", "table", "tables", "cafe", "relational"]
    docs = [(f"d{i:02d}", " ".join(r.choice(words) for _ in range(r.randrange(3, 20)))) for i in range(40)] + [("d90", "verify_nonce is called"), ("d91", "nonce verify"), ("d92", "Café tables")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, body, tokenize = 'porter unicode61')")
    db.executemany("insert into f values (?, ?)", docs)
    entries = spark.createDataFrame(docs, "id string, body string")
    tasks = ["run queue", "verify_nonce", "batch batch table", "relational nonce", "cafe"]
    got = bm25(entries, spark.createDataFrame([(t, t) for t in tasks], "query_id string, task string"), stem=True).collect()
    for t in tasks:
        match = " OR ".join(f'"{w}"' for w in t.split())
        expected = dict(db.execute("select id, bm25(f) from f where f match ?", (match,)).fetchall())
        assert {x.id: pytest.approx(x.rank, abs=1e-9) for x in got if x.query_id == t} == expected


def test_dedup_refuses_restatements_only(spark):
    base = "every worker keeps 12 open sockets since the router drops idle peers after 45 seconds"
    e = rows(spark, ENTRIES, entry("a", body=base), entry("dead", body=base.replace("12", "70"), status="superseded"))
    held = rows(spark, ANCHORS, {"id": 1, "entry_id": "a", "file": "f"}, {"id": 2, "entry_id": "dead", "file": "f"})
    new = spark.createDataFrame([("n1", base, ["f"]), ("n2", base.replace("12", "200"), ["f"]), ("n3", base, ["g"]), ("n4", base.replace("12", "70"), ["f"])], "query_id string, task string, files array<string>")
    assert {(r.query_id, r.twin) for r in dedup.refused(new, e, held).collect()} == {("n1", "a")}
    assert {(r.query_id, r.id, r.conflict) for r in dedup.surfaced(new, e, held).collect()} == {("n1", "a", False), ("n2", "a", True), ("n4", "a", True)}


def test_graph_bounds(spark):
    symbols = rows(spark, SYMBOLS, *[{"id": i, "fqn": f, "name": f.split(".")[-1], "kind": "class", "file": "f"} for i, f in enumerate(["m.A", "m.B", "m.C", "x.Twice", "y.Twice"])])
    inh = rows(spark, INHERITS, *[{"child_fqn": c, "parent_name": p, "rel": "extends"} for c, p in [("m.A", "B"), ("m.B", "C"), ("m.C", "A"), ("m.B", "Twice"), ("x.Twice", "C"), ("m.C", "Ext")]])
    target = spark.createDataFrame([("m.A",)], "target string")
    up = {(r.fqn, r.resolved, r.depth) for r in graph.ancestors(target, inh, symbols).collect()}
    assert up == {("m.B", "unique", 1), ("m.C", "unique", 2), ("x.Twice", "ambiguous", 2)}
    calls = rows(spark, CALLS, *[{"caller_fqn": f"c{i:03d}", "callee_name": "A", "file": "f"} for i in range(50)], {"caller_fqn": "m.A", "callee_name": "nobody", "file": "f"})
    down = {(r.fqn, r.rel, r.resolved) for r in graph.descendants(target, inh, calls, symbols).collect()}
    assert down == {("m.C", "extends", "unique"), ("nobody", "calls", "unresolved")}
    who = graph.callers(target, calls).collect()
    assert len(who) == 40 and all(r.truncated for r in who) and who[0].fqn.startswith("c0")


def test_sweep(spark):
    f = lambda *x: rows(spark, FILES, *[{"path": p, "mtime_ns": m, "size": s} for p, m, s in x])
    got = sweep.diff(f(("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), f(("a", 1, 1), ("b", 2, 1), ("d", 1, 1))).cache()
    assert {(r.path, r.change) for r in got.collect()} == {("b", "changed"), ("c", "removed"), ("d", "new")}
    held = rows(spark, ANCHORS, {"id": 1, "entry_id": "e", "file": "d"})
    plan = {r.path: r.action for r in sweep.plan(got, held, rows(spark, ENTRIES, entry("e")), 1).collect()}
    assert plan == {"d": "reindex", "c": "removed", "b": "dirty"}


def test_views(spark):
    e = rows(spark, ENTRIES, entry("a", status="stale", source="verified", evidence_ran_at="2024-01-02T00:00:00Z"), entry("b", status="stale", source="verified"), entry("c", status="stale", source="verified", evidence_ran_at="2024-01-01T00:00:00Z"), entry("d", status="stale"), entry("x", status="stale", source="verified"))
    hidden = rows(spark, ARCHIVED, {"entry_id": "x", "archived_at": T0})
    assert [(r.place, r.id) for r in views.verify_queue(e, hidden).orderBy("place").collect()] == [(1, "b"), (2, "c"), (3, "a")]
    assert views.statusline(views.brief(e, hidden)).first()[0] == "0 memories, 4 stale"
    links, after = views.add_links(rows(spark, LINKS, {"src": "a", "dst": "d", "rel": "supersedes"}, {"src": "a", "dst": "nobody", "rel": "supports"}), rows(spark, LINKS), e, F.lit(T0))
    assert links.count() == 1 and {r.id for r in after.where("status = 'superseded'").collect()} == {"d"}


def test_iso_seconds_against_datetime(spark):
    days = [datetime.datetime(y, m, 1, 3, 4, 5) for y, m in itertools.product((1970, 1999, 2000, 2024, 2100), (1, 2, 3, 12))]
    df = spark.createDataFrame([(d.strftime("%Y-%m-%dT%H:%M:%SZ"), int(d.replace(tzinfo=datetime.timezone.utc).timestamp())) for d in days], "s string, t long")
    assert df.where(iso_seconds(F.col("s")) != F.col("t")).count() == 0
