"""Token predicates, scalars and guards on literal cases."""

import re

import pytest
from pyspark.sql import functions as F

from stratakb.functions import guards, hashing, text, timeutil, trust
from stratakb.functions.stem import fold, porter

_POOL = "every worker keeps 12 open sockets since the router drops idle peers after 45 seconds"
PAIRS = [  # first, second, near duplicate, conflict
    (_POOL, _POOL, True, False),
    (_POOL, _POOL.replace("12", "90"), False, True),
    ("invoices are rounded in row7 of the ledger view before taxes apply", "invoices are rounded in row8 of the ledger view before taxes apply", False, True),
    ("画像は夜間に圧縮される image tool", "通知は朝に一度だけ送られる image tool", False, False),
    ("choose redis rather than kafka behind the event broker", "choose kafka rather than redis behind the event broker", False, False),
    ("the importer does retry failed uploads twice before giving up", "the importer does not retry failed uploads twice before giving up", False, True),
]


def plain_jaccard(a, b, n):
    """Of the sets of n adjacent significant words, by plain loops."""
    sets = []
    for t in (a, b):
        w = [x.lower() for x in re.findall(r"[^\W_]+", t) if len(x) >= 3 and not x.isdigit()]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return round(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), 4)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_pairs(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(PAIRS)], "i int, a string, b string")
    x, y = text.features(F.col("a")), text.features(F.col("b"))
    got = rows.select("i", F.round(text.jaccard(x["tokens"], y["tokens"]), 4), F.round(text.jaccard(x["bigrams"], y["bigrams"]), 4), text.near_duplicate(x, y), text.conflict(x, y)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(plain_jaccard(a, b, 1), plain_jaccard(a, b, 2), near, conflict) for a, b, near, conflict in PAIRS]


def test_scalars(spark):
    iso = lambda s: timeutil.iso_seconds(F.lit(s))
    r = one(
        spark,
        hashing.token_estimate(F.lit("")), hashing.token_estimate(F.lit("abcd")), hashing.token_estimate(F.lit("abcde")), text.fts_query(F.lit("a bc né verify_nonce x1y")), F.array_join(text.numbers(F.lit("col10 and 9, col10")), ","),
        timeutil.decayed(F.lit(0.8), F.lit("2024-01-01T00:00:00Z"), F.lit("2024-06-29T00:00:00Z")), timeutil.decayed(F.lit(0.1), F.lit("?"), F.lit("2024-06-29T00:00:00Z")), timeutil.recency(F.lit("bad"), F.lit("2024-06-29T00:00:00Z")), iso("1970-01-02T00:00:01Z"), iso("2024-02-29T12:00:00+junk"), iso("2024-2-29"),
        timeutil.bumped(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-01T00:00:05Z")), trust.default_confidence(F.lit("explicit"), F.lit(1.0)), trust.imported_confidence(F.lit("verified"), F.lit(1e300)),
    )
    assert list(r) == [0, 1, 2, '"né" OR "verify_nonce" OR "x1y"', "10,9", 0.4, 0.2, 0.5, 86401, 1709208000, None, "2024-01-01T00:00:06Z", 0.85, 0.95]


def test_names(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    r = one(
        spark,
        hashing.fqn(F.lit("src/a.b/x.test.py"), arr("C"), F.lit("f")), hashing.fqn(F.lit(".env"), arr(), F.lit("f")), hashing.last_segment(F.lit("a.b::c")), hashing.is_minified(F.lit("a/b.min.js")),
        *[hashing.normal_remote(F.lit(s)) for s in ("git@Host.org:me/repo.git", "https://user:pw@host.org/me/repo/", "ssh://git@host.org:22/me/repo.git")], hashing.version_tuple(F.lit("1.x.10")), hashing.ulid(F.lit(0), F.lit(0), F.lit(31)), hashing.repo_key(F.lit("host.org/me/Repo")),
    )
    assert list(r)[:4] == ["src.a.b.x.test.C.f", ".env.f", "c", True]
    assert r[4] == r[5] == "host.org/me/repo" and r[6].endswith("me/repo")
    assert r[7] == [1, 0, 10] and r[8] == "0" * 25 + "Z" and len(r[9]) == len("host-org-me-repo") + 9


def test_guards(spark):
    null = F.lit(None).cast("string")
    why = lambda **k: guards.write_reject(*[F.lit(k[n]).cast("string") if n in k else d for n, d in (("kind", F.lit("fact")), ("body", F.lit("fine")), ("source", F.lit("explicit")), ("origin", null))], F.lit(False), F.lit(k["cmd"]) if "cmd" in k else null, null)
    r = one(spark, why(), why(kind="rumour"), why(source="verified"), why(body="  "), why(body="token ghp_" + "a" * 36), why(body="x" * 70000), why(cmd=" "), why(origin="o" * 300), why(body="-----BEGIN RSA PRIVATE KEY-----"))
    assert list(r) == [None, "kind", "verified_without_evidence", "body_empty", "body_secret", "body_size", "evidence_command_empty", "origin_size", "body_secret"]
    paths = [guards.bad_path(F.lit(p)) for p in ("a/b.py", "", "/etc", "a/../b", "..", "C:\\x", "a..b/c")]
    assert list(one(spark, *paths)) == [False, True, True, True, True, True, False]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("electrical", "electr"), ("adoption", "adopt"), ("controlling", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_fold():
    assert fold("Déjà_vu, RUNNING") == ["deja", "vu", "run"]
