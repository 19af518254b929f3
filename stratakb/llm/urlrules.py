"""URL filters: fixed host and path rules, and association rules for the rest.

A URL becomes a set of tokens (host, its last two labels, subdomain, top-level
domain, path segments with digits as ``#``, extension, query keys, fragment).
Spark's FP-growth mines token combinations together with the label of the
labelled URLs, once for each form of the host, as these imply one another; rules
(tokens -> label) are kept by confidence and support. Each
rule is listed in an inverted index under its rarest token; a URL's tokens look
up candidate rules there, which must be wholly contained. The rule with the
highest confidence, then support, then the longest and alphabetically first,
decides; without one the verdict is ``default``.

Defined results: a null URL or one without ``://`` has an empty host and path
and only the token ``none``; repeated rows are judged each on its own; without
labelled rows no rule is mined; extra columns are kept unless they clash with
an output column.

Everything is DataFrame and ``pyspark.ml`` operations in the JVM. Matching
works on distinct token sets, pre-aggregated before the shuffle, so a host with
a third of all pages costs some rows for each task; the verdicts are joined
back by token set, where adaptive execution splits a hot set's partition. The
rules are broadcast only if they are at most ``broadcast_rules`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"
OUT = ("host", "path", "rule", "verdict", "method_confidence")
#: A host implies its site, and a site its top-level domain: itemsets hold one of them at most.
LEVELS = ("host=", "site=", "top=", "sub=")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules [(verdict, host/path)] that fits, nulls if none does; among equally long ones the longer host, then the alphabetically first."""
    split = sorted(((r.partition("/")[0], "/" + r.partition("/")[2], r, v) for v, r in rules), key=lambda x: (-len(x[2]), -len(x[0]), x[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, r, v in reversed(split):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The sorted set of a URL's tokens, never empty."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    tag = lambda name, arr: F.transform(arr, lambda x: F.concat(F.lit(f"{name}="), x))
    segments = F.filter(F.split(F.regexp_replace(F.regexp_replace(p, r"\.[A-Za-z]+$", ""), "[0-9]+", "#"), "/"), lambda x: x != "")
    keys = F.filter(F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    found = F.concat(
        F.when(h == "", F.array()).otherwise(F.array(F.concat(F.lit("host="), h), F.concat(F.lit("site="), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.least(F.lit(2), F.size(labels))), ".")), F.concat(F.lit("top="), F.element_at(labels, -1)), F.concat(F.lit("sub="), labels[0]))),
        tag("seg", segments),
        tag("ext", F.filter(F.array(F.regexp_extract(p, r"\.([A-Za-z]+)$", 1)), lambda x: x != "")),
        tag("key", keys),
        tag("frag", F.filter(F.array(F.regexp_extract(url, r"(?s)#(.*)$", 1)), lambda x: x != "")),
    )
    return F.when(url.isNull() | (F.size(found) == 0), F.array(F.lit("none"))).otherwise(F.array_sort(F.array_distinct(found)))


def _at_level(items: Column, level: str) -> Column:
    """The items with the host in one form only."""
    others = [x for x in LEVELS if x != level]
    return F.filter(items, lambda x: ~reduce(lambda p, q: p | q, [x.startswith(o) for o in others]))


def mine(labelled: DataFrame, *, url: str = "url", bad: str = "bad", min_support: float = 0.002, min_confidence: float = 0.6) -> DataFrame:
    """(antecedent array, label, confidence, support) of the rules tokens -> bad or good of URLs with a boolean label."""
    good_bad = F.when(F.col(bad), "=bad").otherwise("=good")
    baskets = labelled.where(F.col(bad).isNotNull()).select(F.concat(tokens(F.col(url)), F.array(good_bad)).alias("items"))
    rules = None
    for level in LEVELS:
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets.select(_at_level(F.col("items"), level).alias("items")))
        found = model.associationRules.where(F.col("consequent")[0].isin("=bad", "=good") & (F.col("lift") > 1)).select("antecedent", F.col("consequent")[0].alias("label"), "confidence", "support")
        rules = found if rules is None else rules.unionByName(found)
    return rules.dropDuplicates(["antecedent", "label"])


def match(sets: DataFrame, rules: DataFrame, *, broadcast_rules: int = 20_000) -> DataFrame:
    """(tokens, best struct<confidence, support, size, antecedent, label>) of the token sets that a rule fits."""
    items = rules.select(F.explode("antecedent").alias("token"), "support").groupBy("token").agg(F.max("support").alias("often"))
    listed = rules.select("*", F.explode("antecedent").alias("token")).join(items, "token")
    index = listed.groupBy("antecedent", "label", "confidence", "support").agg(F.min(F.struct("often", "token"))["token"].alias("token"))
    n = index.limit(broadcast_rules + 1).count()
    if n <= broadcast_rules:
        index = F.broadcast(index)
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.struct("confidence", "support", F.size("antecedent").alias("size"), F.transform("antecedent", lambda x: x).alias("antecedent"), "label")
    return found.groupBy("tokens").agg(F.max(best).alias("best"))


def judge(pages: DataFrame, labelled: DataFrame | None, rules: list[tuple[str, str]], *, url: str = "url", default: str = ALLOW, min_support: float = 0.002, min_confidence: float = 0.6) -> DataFrame:
    """pages with host, path, rule, verdict and method_confidence (of the mined rule, else null)."""
    kept = [c for c in pages.columns if c not in OUT or c == url]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(url).alias("__url")).withColumn("tokens_", tokens(F.col("__url")))
    if labelled is None:
        judged = rows.withColumn("best", F.lit(None).cast("struct<confidence:double,label:string>"))
    else:
        mined = match(rows.select(F.col("tokens_").alias("tokens")).distinct(), mine(labelled, min_support=min_support, min_confidence=min_confidence))
        judged = rows.join(mined.select(F.col("tokens").alias("tokens_"), "best"), "tokens_", "left")
    h, p = host(F.col("__url")), path(F.col("__url"))
    rule, verdict = fixed_rule(h, p, rules)
    by_method = F.when(F.col("best.label") == "=bad", BLOCK).when(F.col("best.label") == "=good", ALLOW).otherwise(default)
    return judged.select(*[F.col(f"`{c}`") for c in kept if c not in OUT], h.alias("host"), p.alias("path"), rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), F.when(rule.isNull(), F.col("best.confidence")).alias("method_confidence"))
