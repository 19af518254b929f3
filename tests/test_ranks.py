"""Ranks of equal entries, of many terms, and the candidates cut by them."""

import random

from stratakb.operators import fts, recall
from stratakb.schemas import ANCHORS, ARCHIVED, ENTRIES, IMPORTS, LINKS

WORDS = [f"word{i}" for i in range(12)]
TASK = " ".join(WORDS)


def entries(spark, copies):
    """Other entries, with each word in some of them, and copies whose words come in any order."""
    r = random.Random(3)
    bodies = {f"o{i:03d}": " ".join(r.choices([*WORDS[: 1 + i % 12], "other"], k=5)) for i in range(400)}
    equal = [w for i, w in enumerate(WORDS) for _ in range(1 + i % 3)]
    bodies |= {f"e{i:03d}": " ".join(r.sample(equal, len(equal))) for i in range(copies)}
    row = lambda k, b: {"id": k, "kind": "fact", "body": b, "created_at": "2024-06-01T00:00:00Z", "source": "explicit", "confidence": 0.8, "status": "active"}
    return spark.createDataFrame([tuple(row(k, b).get(f.name) for f in ENTRIES) for k, b in bodies.items()], ENTRIES).repartition(7, "id")


def queries(spark):
    return spark.createDataFrame([("q", TASK, ["f"], 1000, "2024-07-01T00:00:00Z")], "query_id string, task string, working_set array<string>, budget long, now string")


def test_equal_entries_tie(spark):
    got = fts.bm25(entries(spark, 300), queries(spark)).where("id like 'e%'").collect()
    assert len(got) == 300 and len({(r.rank, r.text) for r in got}) == 1


def test_candidates_of_equal_rank_go_by_id(spark):
    none = lambda t: spark.createDataFrame([], t)
    held = spark.createDataFrame([(1, "e290", "f", None, None, None), (2, "o000", "g", None, None, None), (3, "e291", "f", None, None, None)], ANCHORS)
    best = sorted((round(r.rank, 9), r.id) for r in fts.bm25(entries(spark, 300), queries(spark)).collect())[:200]
    got = recall.scored(queries(spark), entries(spark, 300), held, none(LINKS), none(IMPORTS), none(ARCHIVED)).collect()
    assert sorted(r.id for r in got) == sorted({i for _, i in best} | {"e290", "e291"}) and best[-1][1].startswith("e")


def test_fewer_matches_than_candidates(spark):
    few = entries(spark, 3).where("id < 'o010'")
    none = lambda t: spark.createDataFrame([], t)
    held = spark.createDataFrame([(1, "o000", "f", None, None, None), (2, "nowhere", "f", None, None, None)], ANCHORS)
    expected = {r.id for r in fts.bm25(few, queries(spark)).collect()} | {"o000"}
    got = recall.scored(queries(spark), few, held, none(LINKS), none(IMPORTS), none(ARCHIVED)).collect()
    assert sorted(r.id for r in got) == sorted(expected)


def test_more_terms_than_stand_in_a_plan(spark, monkeypatch):
    ranked = lambda: {(r.id, r.rank, r.text) for r in fts.bm25(entries(spark, 5), queries(spark), stem=True).collect()}
    listed = ranked()
    monkeypatch.setattr(fts, "LISTED_TERMS", 3)
    monkeypatch.setattr(fts, "PART_ROWS", 100)
    assert ranked() == listed and len(listed) > 300


def test_nearness_is_the_closest_tie(spark):
    working = {"q": ["src/a.py", "lib/b.py"], "r": ["top"]}
    q = spark.createDataFrame([(k, w) for k, w in working.items()], "query_id string, working_set array<string>")
    imports = [("lib/c.py", "pkg.a"), ("src/a.py", "src/d.py"), ("other/e.py", "pkg.top"), ("far/g.py", "nothing")]
    files = ["src/a.py", "src/d.py", "src/x.py", "lib/c.py", "other/e.py", "far/g.py", "top", "top/y", None]
    held = spark.createDataFrame([(i, f"e{i}", f, None, None, None) for i, f in enumerate(files)], ANCHORS)
    around = {(k, f) for k, w in working.items() for x in w for f, t in imports if x.split("/")[-1].split(".")[0] in t} | {(k, t) for k, w in working.items() for f, t in imports if f in w}
    plain = lambda k, f: 1.0 if f in working[k] else 0.6 if (k, f) in around else 0.3 if f.split("/")[0] in {x.split("/")[0] for x in working[k]} else 0.0
    got = {(r.query_id, r.file): r.near for r in recall.nearness(q, held, spark.createDataFrame(imports, IMPORTS)).collect()}
    assert all(got.get((k, f), 0.0) == plain(k, f) for k in working for f in files if f) and {0.3, 0.6, 1.0} == set(got.values())


def test_floor_and_packs_move_no_rows(spark):
    """What a query has in all is added up and broadcast; its rows aren't dealt out or sorted again for it."""
    rows = [("q" if i % 2 else "r", f"i{i:02d}", 1.0 - i / 20, ["stale:x"] if i == 19 else [], 100, 350) for i in range(20)]
    df = spark.createDataFrame(rows, "query_id string, id string, score double, flags array<string>, cost long, budget long")
    floor = recall.floored(df)
    packs = recall.packed(floor)
    assert {(r.query_id, r.matched, r.cut_by_floor) for r in floor.collect()} == {("q", 10, 2), ("r", 10, 3)}
    assert [(r.query_id, r.place, r.id) for r in packs.orderBy("query_id", "place").collect()] == [("q", 1, "i01"), ("q", 2, "i03"), ("q", 3, "i05"), ("r", 1, "i00"), ("r", 2, "i02"), ("r", 3, "i04")]
    for df in (floor, packs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_tasks_grow_with_the_matches(spark, monkeypatch):
    """One task sums at most about PART_ROWS rows, whatever the number of shuffle partitions."""
    monkeypatch.setattr(fts, "PART_ROWS", 100)
    monkeypatch.setattr(fts, "materialize", lambda df, label, real=fts.materialize: parts.setdefault(label, df.rdd.getNumPartitions()) and real(df, label))
    parts = {}
    fts.bm25(entries(spark, 5), queries(spark)).collect()
    assert parts["ranks"] > 10
