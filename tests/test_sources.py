"""Grammars, extraction, body hashes, markdown, ignore files, store and API."""

import pytest
from pyspark.sql import functions as F

from stratakb.sources import extract, files, languages, markdown

CODE = {
    "python": ("import os\nfrom a.b import c\nclass A(Base, metaclass=M):\n    def run(self):\n        return helper(1)\n\ndef top():\n    A().run()\n", {("A", "class"), ("run", "method"), ("top", "function")}, "os", ("run", "helper"), {("A", "Base", "extends")}),
    "php": ("<?php\nuse App\\Queue;\nclass Scan extends Base implements Job {\n  public function run($x) { return check($x); }\n}\nfunction top() { run(); }\n", {("Scan", "class"), ("run", "method"), ("top", "function")}, "App\\Queue", ("run", "check"), {("Scan", "Base", "extends"), ("Scan", "Job", "implements")}),
    "typescript": ("import { x } from './mod';\nexport class A extends B implements C {\n  async load(id: string): Promise<void> { fetchIt(id); }\n}\nfunction top() { load(); }\n", {("A", "class"), ("load", "method"), ("top", "function")}, "./mod", ("load", "fetchIt"), {("A", "B", "extends"), ("A", "C", "implements")}),
    "rust": ("use std::io;\npub struct S;\nimpl Show for S {\n    fn show(&self) { draw(); }\n}\nfn top() { s.show(); }\nconst N: u8 = 1;\n", {("S", "class"), ("show", "method"), ("top", "function"), ("N", "const")}, "std::io", ("show", "draw"), {("S", "Show", "impl_trait")}),
    "cpp": ('#include "a.h"\nclass Engine : public Base {\n  int score(int x) { return calc(x); }\n};\nint top() { return 1; }\n', {("Engine", "class"), ("score", "method"), ("top", "function")}, "a.h", ("score", "calc"), {("Engine", "Base", "extends")}),
    "go": ('package p\nimport "fmt"\ntype T struct {\n\tBase\n}\nfunc (t T) Run() { fmt.Println(go1()) }\nfunc top() { helper() }\n', {("T", "class"), ("Run", "method"), ("top", "function")}, "fmt", ("top", "helper"), {("T", "Base", "embeds")}),
    "ruby": ("require 'json'\nclass A < B\n  include M\n  def run\n    go(1)\n  end\nend\ndef top\nend\n", {("A", "class"), ("run", "method"), ("top", "function")}, "json", ("run", "go"), {("A", "B", "extends"), ("A", "M", "mixin")}),
    "java": ("import a.b.C;\nclass A extends B implements D {\n  int run(int x) { return go(x); }\n}\n", {("A", "class"), ("run", "method")}, "a.b.C", ("run", "go"), {("A", "B", "extends"), ("A", "D", "implements")}),
    "c_sharp": ("using System.IO;\nclass A : B {\n  int Run(int x) { return Go(x); }\n}\n", {("A", "class"), ("Run", "method")}, "System.IO", ("Run", "Go"), {("A", "B", "extends")}),
    "bash": ("source lib.sh\nrun() {\n  top\n}\nfunction top {\n  echo hi\n}\n", {("run", "function"), ("top", "function")}, "lib.sh", ("run", "top"), set()),
}


@pytest.mark.parametrize("lang", CODE)
def test_extraction(lang):
    src, symbols, imported, call, inherits = CODE[lang]
    f = extract.extract(lang, src)
    assert {(s.name, s.kind) for s in f.symbols} == symbols
    assert imported in f.imports and call in f.calls and {(c, b, r) for c, _, b, r in f.inherits} == inherits


HASHED = {  # a body, the same with comments and white space, the comment's own mark
    "python": ("def f(x):\n    return x + 1\n", "def f(x):\n    # why\n\n    return x  +  1\n"),
    "java": ("int f(int x) { return x + 1; }", "int f(int x) {\n  // why\n  return x+1; /* so */\n}"),
    "php": ("function f($x) { return $x + 1; }", "function f($x) {\n  # why\n  // and\n  return $x+1; /* so */\n}"),
    "javascript": ("function f(x) { return x + 1; }", "function f(x) {\n  // why\n  return x+1;\n}"),
    "rust": ("fn f(x: u8) -> u8 { x + 1 }", "fn f(x: u8) -> u8 {\n  // why\n  x+1\n}"),
    "go": ("func f(x int) int { return x + 1 }", "func f(x int) int {\n\t// why\n\treturn x+1\n}"),
    "cpp": ("int f(int x) { return x + 1; }", "int f(int x) {\n  /* why */ return x+1;\n}"),
    "ruby": ("def f(x)\n  x + 1\nend", "def f(x)\n  # why\n  x  + 1\nend"),
    "bash": ("f() {\n  echo 1\n}", "f() {\n  # why\n  echo   1\n}"),
}


@pytest.mark.parametrize("lang", HASHED)
def test_body_hash_properties(lang):
    a, cosmetic = HASHED[lang]
    form = lambda name, s: extract.body_form(lang, name, s)
    assert form("f", a) == form("f", cosmetic) == form("g", a.replace("f(", "g(")) != form("f", a.replace("1", "2"))


def test_calls_without_parentheses():
    ruby = "def run\n  load 1\n  item.save\n  total = count + 1\n  puts 'x' if ready\n  list.each do |x|\n    x.show(2)\n  end\n  a.b = 3\nend\n"
    assert {n for _, n in extract.extract("ruby", ruby).calls} == {"load", "save", "puts", "each", "show"}
    bash = "run() {\n  mkdir -p out\n  X=1\n  if grep -q a b; then\n    rm b | sort\n  fi\n}\nrun\n"
    f = extract.extract("bash", bash)
    assert {n for _, n in f.calls} == {"mkdir", "grep", "rm", "sort", "run"} and ("run", "mkdir") in f.calls


def test_unreadable_files():
    assert extract.index_one("a.py", b"\xff\xfe", "python")["files"][0][1] is None
    assert extract.index_one("a.py", b"def (", "python")["files"][0][4] is False
    rows = extract.index_one("src/a.py", b"class A:\n    def f(self):\n        g()\n", "python")
    assert rows["symbols"][1][0] == "src.a.A.f" and rows["symbols"][1][8] == "src.a.A" and rows["calls"] == [("src.a.f", "g", "src/a.py")]


def test_grammars(spark):
    paths = ["a.py", "b.blade.php", "c.tsx", "d.txt", "Makefile", "e.PY"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(languages.detect(F.col("p"), {"blade.php": "javascript", "txt": "ruby"})).collect()]
    assert got == ["python", "javascript", "typescript", "ruby", None, None] == [languages.detect_one(p, {"blade.php": "javascript", "txt": "ruby"}) for p in paths]
    assert languages.load_config(None) == {"extensions": {}, "auto_import": True}
    with pytest.raises(ValueError, match="suffixes"):
        languages.load_config('{"extensions": {".x": "cobol"}}')


def test_markdown():
    text = "# Title\n\nfirst line\nsecond line\n- bullet one\n1. item\n```\n- code\n```\ntail\n~~~\nnever closed\n- lost"
    assert markdown.chunk_markdown(text) == ["first line second line", "bullet one", "item", "tail"] and markdown.chunk_markdown(None) == []


def test_ignore():
    lines = ["*.log", "/build", "docs/**/x.md", "!keep.log", "tmp/"]
    got = {p: files.ignored(p, lines) for p in ("a.log", "d/a.log", "d/keep.log", "build/x", "d/build/x", "docs/x.md", "docs/a/b/x.md", "tmp/a", "d/tmp/a", "tmp")}
    assert got == {"a.log": True, "d/a.log": True, "d/keep.log": False, "build/x": True, "d/build/x": False, "docs/x.md": True, "docs/a/b/x.md": True, "tmp/a": True, "d/tmp/a": True, "tmp": False}
    assert files.git_status_paths(" M b.py\0?? a.py\0?? a.py\0") == ["a.py", "b.py"]


def test_lifecycle(spark, tmp_path):
    """Index, remember, edit, go stale, restore, heal."""
    from stratakb.api import Engine

    root, src = tmp_path / "repo", "def score(x):\n    total = x * 50\n    return total + len(str(x)) + sum(range(x)) - 7\n"
    root.mkdir()
    (root / "a.py").write_text(src)
    (root / "b.min.js").write_text("x")
    e = Engine(spark, str(tmp_path / "store"), str(root))
    assert e.index()["reindex"] == ["a.py"]
    schema = "id string, kind string, body string, source string, confidence double, file string, symbol string, evidence_cmd string, evidence_output string, private boolean, origin string, links array<struct<dst:string,rel:string>>"
    new = [("m1", "fact", "the batch factor is 50 because hosts time out", "explicit", None, "a.py", "score", None, None, False, None, None), ("m2", "fact", "x", "explicit", None, "a.py", "nothing", None, None, False, None, None), ("m3", "rumour", "x", "explicit", None, None, None, None, None, False, None, None)]
    assert {(r.id, r.outcome) for r in e.remember(spark.createDataFrame(new, schema)).collect()} == {("m1", "stored"), ("m2", "unknown_symbol"), ("m3", "kind")}
    again = [("m4", *new[0][1:])]
    assert e.remember(spark.createDataFrame(again, schema)).first().outcome == "near_duplicate"
    (root / "a.py").write_text(src.replace("50", "60"))
    e.index()
    assert {r.id: r.status for r in e.store.read("entries").collect()} == {"m1": "stale"}
    (root / "a.py").write_text("# a comment\n" + src)
    e.index()
    row = e.store.read("entries").first()
    assert (row.status, row.confidence) == ("active", 0.48)
    q = spark.createDataFrame([("q", "batch factor", ["a.py"], 500, "2024-07-01T00:00:00Z")], "query_id string, task string, working_set array<string>, budget long, now string")
    items, env = e.recall(q)
    assert [r.id for r in items.collect()] == ["m1"] and env.first().returned == 1 and e.ledger().first().recalls == 1
    e.archive("m1")
    with pytest.raises(ValueError, match="already"):
        e.archive("m1")
    assert e.recall(q)[1].first().matched == 0
    e.archive("m1", restore=True)
    assert e.export(str(tmp_path / "out"))["exported"] == 1
    other = Engine(spark, str(tmp_path / "other"))
    lines = spark.read.text(str(tmp_path / "out")).select(F.lit(0).cast("long").alias("n"), "value")
    assert other.import_(lines)["added"] == 1 and other.import_(lines)["skipped"] == 1
    e.forget("m1")
    assert e.store.read("entries").count() == 0 and e.store.read("anchors").count() == 0


def test_whole_trees(spark, tmp_path):
    """Settings, ignored files, the first import, one parse for all tables, several anchors, refusals within a call."""
    import json

    from stratakb.api import Engine

    root = tmp_path / "repo"
    (root / ".stratakb").mkdir(parents=True)
    for k in range(40):
        (root / f"m{k:02}.py").write_text(f"def f{k}(x):\n    return helper(x) + {k}\n")
    (root / "skip.py").write_text("def hidden():\n    pass\n")
    (root / "view.tpl").write_text("<?php function shown() { return 1; }")
    (root / "bad.py").write_text("def (")
    (root / ".stratakbignore").write_text("skip.py\n")
    (root / ".stratakb.json").write_text(json.dumps({"extensions": {".tpl": "php"}}))
    line = {"id": "s1", "kind": "fact", "body": "helpers are shared", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "source": "explicit", "confidence": 0.8, "status": "active"}
    (root / ".stratakb" / "memory.jsonl").write_text(json.dumps(line) + "\n")
    e = Engine(spark, str(root / "store"), str(root))
    did = e.index(full=True)
    assert (did["files"], did["symbols"], did["failed"], did["first_failed"], did["imported"]["added"]) == (42, 41, 1, ["bad.py"], 1)
    assert "shown" in {r.name for r in e.store.read("symbols").collect()} and "imported" not in e.index(full=True)
    (root / "m00.py").unlink()
    swept = e.index()
    assert (swept["removed"], swept["reindex"], swept["dirty_total"]) == (1, [], 0)
    schema = "id string, kind string, body string, source string, confidence double, anchors array<struct<file:string,symbol:string>>, evidence_cmd string, evidence_output string, private boolean, origin string, links array<struct<dst:string,rel:string>>"
    body = "the adder helper clamps inputs above 90 because of overflow"
    rest = (None, None, False, None, None)
    new = [
        ("a1", "fact", body, "explicit", None, [("m01.py", "f1"), ("m02.py", None)], *rest), ("a2", "fact", body, "explicit", None, [("m02.py", None)], *rest), ("a3", "fact", "other words", "explicit", None, [("m01.py", "f1"), ("m02.py", "nothing")], *rest),
        ("s1", "fact", "y", "explicit", None, None, *rest), ("b1", "fact", "z z z", "explicit", None, None, None, None, False, "o", None), ("b2", "fact", "w w w", "explicit", None, None, None, None, False, "o", None),
    ]
    got = {r.id: r.outcome for r in e.remember(spark.createDataFrame(new, schema)).collect()}
    assert got == {"a1": "stored", "a2": "near_duplicate", "a3": "unknown_symbol", "s1": "id_duplicate", "b1": "stored", "b2": "origin_duplicate"}
    assert e.store.read("anchors").where("entry_id = 'a1'").count() == 2
    after = e.remember(spark.createDataFrame([("c1", "fact", body.replace("90", "70"), "explicit", None, [("m01.py", None)], *rest)], schema)).first()
    assert after.outcome == "stored" and [x.id for x in after.possible_duplicates] == ["a1"] and [x.id for x in after.possible_conflicts] == ["a1"]
    (root / "m05.py").write_text("def f5(x):\n    return x\n")
    q = spark.createDataFrame([("q", "adder helper overflow", ["m01.py"], 500, "2024-07-01T00:00:00Z")], "query_id string, task string, working_set array<string>, budget long, now string")
    items, env = e.recall(q)
    first = {r.id: r for r in items.collect()}["a1"]
    assert [(x.file, x.symbol) for x in first.anchors] == [("m01.py", "m01.f1"), ("m02.py", None)]
    assert (env.first().reindexed_now, env.first().dirty_total, env.first().sweep_failed) == (1, 0, False)
    shown = e.map(spark.createDataFrame([("f1",)], "target string"))["symbols"].first()
    assert (shown.start_line, shown.calls, [m.id for m in shown.memories]) == (1, ["helper"], ["a1"])
    assert e.ledger_session().first().recalls == 1
    (root / ".stratakb.json").write_text("{")
    with pytest.raises(ValueError):
        e.index(full=True)
    assert e.index()["dirty_total"] == 0


def test_two_writers(spark, tmp_path):
    """Of two writers of one version the second fails, and the first one's rows stay."""
    from stratakb.store import Store

    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a.put("k", "0")
    old = b._pointer()
    a.put("k", "1")
    b._pointer = lambda: old
    with pytest.raises(RuntimeError, match="first"):
        b.commit(meta=spark.createDataFrame([("k", "2")], "k string, v string"))
    assert Store(spark, str(tmp_path / "s")).get("k") == "1"


def test_status_stream(spark, tmp_path):
    from stratakb.streaming import feeds

    rows = [("a", 1, "stale"), ("a", 2, "active"), ("a", 3, "stale"), ("a", 4, "stale"), ("b", 1, "superseded"), ("b", 2, "active")]
    spark.createDataFrame(rows, "entry_id string, ts long, fate string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("entry_id string, ts long, fate string").parquet(str(tmp_path / "in"))
    got = feeds.run_to_table(feeds.status_machine(s), mode="update")
    assert {(r.entry_id, r.status, r.penalties) for r in got.collect()} == {("a", "stale", 2), ("b", "superseded", 0)}
