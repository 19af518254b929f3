"""The ranking and the saving on labelled questions: precision, recall and tokens served against files read."""

import pytest
from pyspark.sql import functions as F
from test_operators import entry, rows

from stratakb.operators import recall, views
from stratakb.schemas import ANCHORS, ARCHIVED, ENTRIES, FILES, IMPORTS, LINKS

MEMORIES = {  # id: (kind, body, file)
    "pool": ("fact", "the connection pool holds 12 sockets because the router drops idle peers", "net/pool.py"),
    "retry": ("decision", "uploads are retried twice and then parked, since the vendor bills each attempt", "net/upload.py"),
    "round": ("fact", "invoice amounts are rounded half even before tax is added", "billing/round.py"),
    "archive": ("episode", "the archive job once deleted live rows, so it now copies first", "jobs/archive.py"),
    "locale": ("decision", "dates in letters follow the reader's locale, never the server's", "mail/letters.py"),
    "thumbs": ("fact", "thumbnails are made at night while the image queue is short", "jobs/thumbs.py"),
    "login": ("insight", "login throttling counts by account and not by address, as offices share one", "auth/login.py"),
    "cache": ("fact", "the price cache lives for 90 seconds, the supplier's refresh interval", "shop/prices.py"),
    "search": ("decision", "search ignores stop words only in titles", "shop/search.py"),
    "export": ("fact", "the ledger export writes tabs, as amounts contain commas and semicolons", "billing/export.py"),
    "webhook": ("insight", "webhooks arrive out of order, so handlers compare sequence numbers", "net/hooks.py"),
    "backup": ("fact", "backups are encrypted with a key that only the vault releases", "ops/backup.py"),
}
QUESTIONS = {  # id: (text, working set, the memory that answers)
    "q1": ("why does the connection pool keep so few sockets", [], "pool"),
    "q2": ("how are invoice amounts rounded", [], "round"),
    "q3": ("can I throttle login by address", ["auth/login.py"], "login"),
    "q4": ("why tabs in the ledger export", [], "export"),
    "q5": ("what happens when webhooks arrive out of order", [], "webhook"),
    "q6": ("how long do prices stay in the cache", ["shop/prices.py"], "cache"),
    "q7": ("are uploads retried", [], "retry"),
    "q8": ("when are thumbnails made", [], "thumbs"),
    "q9": ("which key encrypts backups", [], "backup"),
    "q10": ("did the archive job ever lose rows", [], "archive"),
}


@pytest.fixture(scope="module")
def packed(spark):
    e = rows(spark, ENTRIES, *[entry(k, kind=kind, body=body) for k, (kind, body, _) in MEMORIES.items()])
    a = rows(spark, ANCHORS, *[{"id": i, "entry_id": k, "file": file} for i, (k, (_, _, file)) in enumerate(MEMORIES.items())])
    files = rows(spark, FILES, *[{"path": file, "size": 3600 + 150 * i, "hash": k} for i, (k, (_, _, file)) in enumerate(MEMORIES.items())])
    q = spark.createDataFrame([(k, t, ws, 300, "2024-07-01T00:00:00Z") for k, (t, ws, _) in QUESTIONS.items()], "query_id string, task string, working_set array<string>, budget long, now string")
    scored = recall.floored(recall.scored(q, e, a, rows(spark, LINKS), rows(spark, IMPORTS), rows(spark, ARCHIVED), stem=True))
    out = recall.packed(scored).cache()
    yield out, recall.cost(out, a, files), spark.createDataFrame([(k, m) for k, (_, _, m) in QUESTIONS.items()], "query_id string, id string")
    out.unpersist()


def test_precision(packed):
    ranked, _, expected = packed
    share = lambda k: (lambda r: r.hits / r.queries)(views.precision_at(ranked, expected, k).first())
    assert share(1) >= 0.8 and share(3) == 1.0


def test_token_ratio(packed):
    r = packed[1].agg(F.sum("baseline").alias("b"), F.sum("served").alias("s")).first()
    assert r.b / r.s >= 4.0


def test_packing_equals_the_plain_loop(spark):
    """Items cut to what their cost allows give the same pack as walking through all of them."""
    import random

    r = random.Random(4)
    data = [(f"q{k}", f"i{k}-{i:03}", r.choice([0.9, 0.5, round(r.random(), 3)]), r.choice([31, 31, 40, 77, 500, 2000]), r.choice([100, 400])) for k in range(12) for i in range(r.randrange(1, 60))]
    budget = {q: b for q, *_, b in data}
    df = spark.createDataFrame([(q, i, s, c, budget[q], True) for q, i, s, c, _ in data], "query_id string, id string, score double, cost long, budget long, relevant boolean")
    got = {}
    for x in recall.packed(df).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append(x.id)
    for q in budget:
        used, ids = 0, []
        for _, i, c in sorted((-s, i, c) for k, i, s, c, _ in data if k == q):
            if not ids or used + c <= budget[q]:
                ids.append(i)
                used += c
        assert got[q] == ids
