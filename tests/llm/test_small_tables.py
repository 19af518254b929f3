"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from stratakb.llm import bagminhash, decontam, embdedup, htmlblocks, langid, linededup, packing, quality, urlrules, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000
EN, DE = "the quick brown fox jumps over the lazy dog and runs away", "der schnelle braune fuchs springt über den faulen hund und rennt"


def docs(spark, *texts, extra=()):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)] + list(extra), DOCS)


def odd(spark):
    return docs(spark, None, "", "   \n\n", EN, EN, LONG, "!!!", "x", "日本語の文章です。" * 5, extra=[(None, EN, None, None, None), (3, EN, "en", "s", 1), (99, None, None, None, None)])


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, EN), (2, None), (3, "!!"), (4, "lazy dog"), (5, EN)], "item_id long, text string")
    d = odd(spark).withColumn("n_hit", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("found", F.lit(2)).withColumn("row", F.lit(3))
    got = decontam.decontaminate(d, bench).collect()
    assert len(got) == 12 and got[0].n_words == 0 and not got[0].contaminated
    three = [r for r in got if r.doc_id == 3]
    assert len(three) == 2 and all(r.n_hit == 12 and r.n_items == 3 and list(r.item_ids) == ["1", "4", "5"] for r in three)
    assert [(s.start, s.end) for s in three[0].spans] == [(0, len(EN))]
    assert decontam.decontaminate(d, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(d.limit(0), bench).count() == 0
    small = decontam.decontaminate(d, bench, max_chars=40).select("doc_id", "n_hit", "items_sha256").collect()
    assert sorted(map(str, small)) == sorted(str(r) for r in decontam.decontaminate(d, bench).select("doc_id", "n_hit", "items_sha256").collect())


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://EXAMPLE.org/", "https://a.example.org/es/1?q#f", "http://x.com/fr/1", "http://x.com/de/1", "http://notorg/es/", "ftp://example.org/en/12", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit(7))
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, None, rules).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("example.org", "", None, "allow"), 5: ("example.org", "/", "org/", "allow"), 6: ("a.example.org", "/es/1", "example.org/es/", "block"), 7: ("x.com", "/fr/1", "com/fr/", "allow"),
        8: ("x.com", "/de/1", "com/de/", "block"), 9: ("notorg", "/es/", None, "allow"), 10: ("example.org", "/en/12", "example.org/en/1", "block"), 11: ("b:", "//c/d", None, "allow"),
    }
    seen = spark.createDataFrame([("http://bad.net/x/1", True)] * 9 + [("http://good.net/x/1", False)] * 9 + [(None, True), ("http://bad.net/x/1", None)], "url string, bad boolean")
    new = spark.createDataFrame([(1, "http://bad.net/y"), (2, "http://good.net/y"), (3, "http://other.de/z"), (4, "http://bad.net/y")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlrules.judge(new, seen, rules).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block"}
    assert urlrules.judge(new.limit(0), seen, rules).count() == 0
    assert urlrules.judge(new, seen.limit(0), rules).where("verdict = 'allow'").count() == 4


def test_rule_matching_equals_brute_force(spark):
    sets = spark.createDataFrame([(["a", "b"],), (["b", "c"],), (["c"],), (["a", "b", "c"],)], "tokens array<string>")
    rules = spark.createDataFrame([(["a"], "=bad", 0.7, 0.5), (["b", "c"], "=good", 0.9, 0.2), (["a", "b"], "=good", 0.8, 0.3)], "antecedent array<string>, label string, confidence double, support double")
    best = {tuple(r.tokens): max((x.confidence, x.label) for x in rules.collect() if set(x.antecedent) <= set(r.tokens)) if any(set(x.antecedent) <= set(r.tokens) for x in rules.collect()) else None for r in sets.collect()}
    for limit in (0, 20_000):
        got = {tuple(r.tokens): (r.best.confidence, r.best.label) for r in urlrules.match(sets, rules, broadcast_rules=limit).collect()}
        assert got == {k: v for k, v in best.items() if v}


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header class="masthead">Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>The &amp; title</h1><div class=share>Share</div></header><p>First   paragraph&nbsp;with <b>bold</b> text.<p>Second.<aside>Related</aside><form><p>Sign up</p></form>
<script>var x = "<p>no</p>";</script><ul><li>one<li>two</ul><section id="comments"><p>Reader says hi</p></section></article><div class="sidebar">Side</div><footer>&copy;</footer></body></html>"""


def test_main_text(spark):
    pages = [PAGE, None, "", "<p>", "plain", PAGE, "<div><p>" + "long text here. " * 30 + "</p><p>short</p></div><div class=footer>foot</div>", "<article>" + "<p>x</p>" * 3000 + "</article>", "<<a <b 'unclosed"]
    df = spark.createDataFrame([(i, "u", p, 1) for i, p in enumerate(pages)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r.text for r in htmlblocks.extract_text(df).collect()}
    assert got[0] == got[5] == "The & title\nFirst paragraph with bold text.\nSecond.\none\ntwo"
    assert got[1] == got[2] == got[3] == "" and got[4] == "plain" and got[6].endswith("here.\nshort") and got[7].count("x") == 3000
    assert htmlblocks.extract_text(df.limit(0)).count() == 0
    assert {r.n_chars == len(r.text) for r in htmlblocks.extract_text(df).collect()} == {True}


def test_embeddings(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, inf]), (8, [nan, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [1e30, 1e29])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([(-1, 0, None, True), (1, 4, 1, True), (2, 4, 1, False), (11, 4, 1, False), (11, 4, 1, False), (12, 4, 1, False), *alone])
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def test_warc(spark):
    df = spark.createDataFrame([(3, "u", "same", 1), (1, "u\r\nX: y", "same", 1), (2, None, None, 1), (4, "u", "", 1), (None, "u", "same", 1), (5, "u", "é" * 99_999, 1), (1, "u", "same", 1)], "page_id long, url string, html string, key int")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.verified) for r in warc.round_trip(df).collect())
    assert got == [(0, 4, "revisit", 1, True), (1, 4, "response", None, True), (1, 4, "response", None, True), (2, 0, "response", None, True), (3, 4, "revisit", 1, True), (4, 0, "revisit", 2, True), (5, 199_998, "response", None, True)]
    assert {r.record_type for r in warc.round_trip(df, min_bytes=5).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_bytes_round_trip(spark, tmp_path):
    import base64
    import hashlib

    df = spark.createDataFrame([(1, "http://a/", "päge"), (2, "http://b/", "päge")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    recs = {r.page_id: bytes(r.record) for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    digest = base64.b32encode(hashlib.sha1("päge".encode()).digest())
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 5\r\n\r\n"
    assert recs[1].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and recs[1].endswith(b"\r\n\r\n" + head + "päge".encode() + b"\r\n\r\n") and b"WARC-Payload-Digest: sha1:" + digest in recs[1]
    assert b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\nHTTP" % (len(head) + 5) in recs[1]
    parsed = {r.page_id: r for r in warc.parse(warc.read_archive(spark, str(tmp_path / "w")).select("page_id", "record")).collect()}
    assert bytes(parsed[1].body) == "päge".encode() and parsed[1].refers_to is None and parsed[2].body is None and parsed[2].refers_to == "1" and parsed[2].digest == digest.decode()
    assert not spark.catalog.listTables()
    assert b"WARC-Refers-To: <urn:page:1>" in recs[2] and recs[2].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 1


def test_lines(spark):
    d = odd(spark).withColumn("kept", F.lit(1))
    rows = linededup.line_classes(d).collect()
    assert [(r.doc_id, r.line_no) for r in rows if r.kept and r.doc_id in (3, 4)] == [(3, 0)] * 2 and sum(r.doc_id is None and r.kept for r in rows) == 1
    out = linededup.dedup(d)
    assert out.columns == d.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted([0, 1, 2, 3, 3, 5, 6, 7, 8, None, 99], key=str)
    assert linededup.line_classes(d.limit(0)).count() == 0


def test_near_duplicates(spark):
    got = bagminhash.near_duplicates(odd(spark).withColumn("key", F.lit(0))).collect()
    by = {(r.doc_id, r.group_id, r.kept) for r in got}
    assert len(got) == 12 and {(3, 3, True), (4, 3, False), (0, 0, True), (1, 1, True), (6, 6, True), (None, None, True), (99, 99, True)} <= by
    assert bagminhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_language(spark):
    model = langid.fit([("en", EN)] * 3 + [("de", DE)] * 3)
    got = langid.identify(odd(spark).withColumn("score", F.lit("clash")), model).collect()
    assert {r.lang_pred for r in got if r.text in (None, "", "!!!")} == {"und"} and {r.lang_pred for r in got if r.text == EN} == {"en"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(odd(spark).limit(0), model).count() == 0 and langid.identify(odd(spark), None).where("lang_pred <> 'und'").count() == 0
    assert langid.train(odd(spark).limit(0)) is None
    assert langid.identify(docs(spark, EN), langid.fit([("en", EN)])).first().lang_pred == "en"


def test_packing(spark):
    d = odd(spark).withColumn("length", F.lit("clash"))
    got = packing.pack(d, TOKENIZER).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and {r.length for r in got if r.doc_id in (0, 1, 99)} == {1}
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert packing.pack(d.limit(0), TOKENIZER).count() == 0
    salted = packing.pack(d, TOKENIZER, group=2).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in salted) == sorted((str(r.doc_id), r.piece, r.length) for r in got) and len({(r.sequence_id, r.offset) for r in salted}) == len(salted)


def test_quality(spark):
    net = quality.Net().fit([(1, EN + " more. " * k) for k in range(20)] + [(0, "$$$ ### " * (k + 3)) for k in range(20)], epochs=12)
    d = odd(spark).withColumn("score", F.lit(1))
    got = quality.classify(d, net).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.text in (None, "")}) == 1
    assert quality.classify(d.limit(0), net).count() == 0
    assert quality.Net().fit([]).score(["x"])[0] == 0.5 and quality.Net().fit([(1, "x")]).score(["x", None])[1] == 1.0


def test_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, EN), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    filler = [f"{a} story about {b} and the {a} that went over the {b} with nothing else to do {k}" for k, (a, b) in enumerate([("cat", "moon"), ("dog", "sun"), ("cow", "sea")])]
    table = docs(spark, None, "", "!!!", *filler, filler[0], f"before {EN} after", LONG)
    for name in ("score", "lang_pred", "n_words", "spans", "kept", "component", "lines", "row", "found", "key"):
        table = table.withColumn(name, F.lit(7.5))
    bare = table.select("doc_id", "text", "lang")
    assert corpus_pipeline.line_dedup(spark, bare, str(tmp_path)).columns == bare.columns
    for rows in (table, table.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            before = now
            now = stage(spark, before, str(tmp_path))
            if name != "pack":
                assert now.columns == table.columns and {x for r in now.collect() for x in r[5:]} <= {7.5}
            path = str(tmp_path / f"{name}-{rows is table}")
            now.write.parquet(path)
            now = spark.read.parquet(path)
            if rows is table and name == "language":
                assert sorted(r.doc_id for r in now.collect()) == [3, 4, 5, 6, 7, 8]
            if rows is table and name == "decontaminate":
                assert sorted(r.doc_id for r in now.collect()) == [3, 4, 5, 8]
        assert (now.count() > 0) == (rows is table)
