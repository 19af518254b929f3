"""Full-text search: postings, corpus statistics and BM25 with phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stemmed
from ..functions.text import fts_terms
from ..runtime import materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
BROADCAST_ROWS = 200_000  # rows of a few dozen bytes: some MB
LISTED_TERMS = 10_000  # terms that stand in the plan itself
PART_ROWS = 2_000_000  # (entry, term, query) that one task sums


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in the JVM."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def postings(entries: DataFrame, *, stem: bool = False, key: str = "id", body: str = "body") -> DataFrame:
    """(id, pos, term) of every token."""
    make = stemmed if stem else plain_tokens
    return entries.select(F.col(key).alias("id"), F.posexplode(make(F.col(body))).alias("pos", "term"))


def phrases(queries: DataFrame, *, stem: bool = False, task: str = "task") -> DataFrame:
    """(query_id, q, off, term, len): q numbers a query's terms (equal ones count again), off the tokens of a term."""
    make = stemmed if stem else plain_tokens
    q = queries.select("query_id", F.posexplode(fts_terms(F.col(task))).alias("q", "word")).withColumn("parts", make(F.col("word"))).where(F.size("parts") > 0)
    return q.select("query_id", "q", F.size("parts").alias("len"), F.posexplode("parts").alias("off", "term"))


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS short rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _runs(sorted_words: str) -> list[Column]:
    """Where the runs of equal words begin in a sorted array column, and the column itself."""
    k = F.col(sorted_words)
    begins = F.transform(k, lambda x, i: F.when((i == 0) | (x != F.get(k, i - 1)), i))
    return [k, F.filter(begins, lambda i: i.isNotNull()).alias("begins")]


def _term_counts(entries: DataFrame, terms: DataFrame, make) -> DataFrame:
    """(id, dl, counts): a row for every entry, counts an array of (phrase, tf) of the terms it has.

    Each body is tokenized once, and what no query asks for goes within the
    row. Up to LISTED_TERMS terms are counted there too: sorted, a term's
    occurrences stand side by side. More are joined and grouped.
    """
    words = F.coalesce(make(F.col("body")), F.array().cast("array<string>"))
    tokens = entries.select("id", words.alias("w"))
    listed = [r.phrase for r in terms.select("phrase").limit(LISTED_TERMS + 1).collect()]
    if len(listed) <= LISTED_TERMS:
        kept = tokens.select("id", F.size("w").alias("dl"), F.sort_array(F.filter("w", lambda w: w.isin(listed))).alias("k"))
        runs = kept.select("id", "dl", *_runs("k"))
        of_run = lambda i, n: F.struct(F.get("k", i).alias("phrase"), (F.coalesce(F.get("begins", n + 1), F.size("k")) - i).cast("long").alias("tf"))
        return runs.select("id", "dl", F.transform("begins", of_run).alias("counts"))
    tokens = tokens.select("id", F.size("w").alias("dl"), F.explode(F.array_append("w", F.lit(""))).alias("phrase"))
    wanted = terms.select("phrase").union(entries.sparkSession.range(1).select(F.lit("")))
    counts = tokens.join(bounded(wanted), "phrase").groupBy("id", "dl", "phrase").agg(F.count(F.lit(1)).alias("tf"))
    counted = F.collect_list(F.when(F.col("phrase") != "", F.struct("phrase", "tf")))
    return counts.groupBy("id", "dl").agg(counted.alias("counts"))


def _phrase_counts(entries: DataFrame, parts: DataFrame, make) -> DataFrame:
    """(id, dl, phrase, tf) of phrases of several tokens: they occur where all tokens stand at their offsets."""
    tokens = entries.select("id", make(F.col("body")).alias("w")).select("id", F.size("w").alias("dl"), F.posexplode("w").alias("pos", "term"))
    hits = tokens.join(bounded(parts), "term")
    whole = hits.groupBy("phrase", "id", "dl", "len", (F.col("pos") - F.col("off")).alias("start")).agg(F.count(F.lit(1)).alias("got")).where("got = len")
    return whole.groupBy("id", "dl", "phrase").agg(F.count(F.lit(1)).alias("tf"))


def ranks(entries: DataFrame, queries: DataFrame, *, stem: bool = False, held: DataFrame | None = None, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, total, near) of matches, and (query_id, scale, lo, hi): total / scale is BM25, lo and hi its least and most.

    Statistics span all entries, whatever is filtered later. Distinct phrases of
    all queries are counted in the entries first; queries come in last, so a
    term that many queries share is counted once. Counts and totals are written
    to the shared folder, as several steps read them. Small sides are broadcast
    only after their rows have been counted.

    Totals are sums of whole numbers, scaled for each query to 60 bits, so they
    don't depend on the order of their parts and equal entries tie. Entries
    are dealt out by id to as many tasks as their matches need, PART_ROWS rows
    each, and what belongs to an entry is summed where it is.

    With held (id, file) and near (query_id, file), an entry held by one of a
    query's files has a row too, near is true and total null if it doesn't match.
    """
    make = stemmed if stem else plain_tokens
    asked = materialize(phrases(queries, stem=stem), "phrases")
    by_q = asked.groupBy("query_id", "q").agg(F.max("len").alias("len"), F.array_sort(F.collect_list(F.struct("off", "term"))).alias("parts"))
    by_q = by_q.select("query_id", "len", "parts", F.array_join(F.transform("parts", lambda p: p["term"]), " ").alias("phrase"))
    of_query = materialize(by_q.groupBy("query_id", "phrase", "len", "parts").agg(F.count(F.lit(1)).alias("times")), "query-phrases")
    single = of_query.where("len = 1").select("phrase").distinct()
    several = of_query.where("len > 1").select("phrase", "len", F.explode("parts").alias("p")).select("phrase", "len", "p.off", "p.term").distinct()
    counts = materialize(_term_counts(entries, single, make), "term-counts")
    corpus = counts.agg(F.count(F.lit(1)).alias("n_all"), F.avg("dl").alias("avgdl"))
    if several.limit(1).count():
        whole = _phrase_counts(entries, several, make).select("id", "dl", F.array(F.struct("phrase", "tf")).alias("counts"))
        counts = counts.unionByName(materialize(whole, "phrase-counts"))
    df = counts.select(F.explode("counts.phrase").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    weights = of_query.select("query_id", "phrase", "times").join(df, "phrase").crossJoin(corpus)  # one row of statistics
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = weights.select("query_id", "phrase", "df", "avgdl", (idf * F.col("times")).alias("weight"))
    most = F.sum("weight").over(Window.partitionBy("query_id")) * (K1 + 1)
    weights = materialize(weights.withColumn("scale", F.pow(F.lit(2.0), 60 - F.ceil(F.log2(most)))), "weights")
    expected = weights.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    sides = weights.select("query_id", "phrase", (F.col("weight") * F.col("scale")).alias("weight"), "avgdl")
    if near is not None:
        #: a file is a term of its own that begins with a space, as no phrase does
        mark = F.concat(F.lit(" "), F.col("file")).alias("phrase")
        pairs = near.select("query_id", mark).distinct()
        marked = held.join(bounded(near.select("file").distinct()), "file", "left_semi").select("id", F.lit(0).alias("dl"), F.array(F.struct(mark, F.lit(0).cast("long").alias("tf"))).alias("counts"))
        counts = counts.unionByName(marked)
        sides = sides.unionByName(pairs.select("query_id", "phrase", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("avgdl")))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    dealt = counts.where(F.size("counts") > 0).repartition(1 + expected // PART_ROWS, "id")
    flat = dealt.select("id", "dl", F.explode("counts").alias("c")).select("id", "dl", "c.phrase", "c.tf")
    joined = flat.join(bounded(sides), "phrase").select("query_id", "id", F.rint(part).cast("long").alias("part"), F.col("weight").isNull().alias("near"))
    found = joined.groupBy("query_id", "id").agg(F.sum("part").alias("total"), F.max("near").alias("near"))
    found = materialize(found, "ranks")
    span = found.where("total is not null").groupBy("query_id").agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    scale = weights.groupBy("query_id").agg(F.max("scale").alias("scale"))
    return found, materialize(span.join(scale, "query_id").select("query_id", "scale", (F.col("lo") / F.col("scale")).alias("lo"), (F.col("hi") / F.col("scale")).alias("hi")), "span")


def ranked(found: DataFrame, span: DataFrame) -> DataFrame:
    """found and span of ranks() with rank and text; both null where nothing matches."""
    rank = -F.col("total") / F.col("scale")
    text = F.when(F.col("hi") > F.col("lo"), (-F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return found.join(bounded(span), "query_id", "left").withColumn("rank", rank).withColumn("text", F.when(F.col("rank").isNotNull(), text)).select("query_id", "id", "near", "rank", "text")


def bm25(entries: DataFrame, queries: DataFrame, *, stem: bool = False) -> DataFrame:
    """(query_id, id, rank, text): rank is minus BM25, text min-max normalised over all matches of the query (1 if all are equal)."""
    return ranked(*ranks(entries, queries, stem=stem)).select("query_id", "id", "rank", "text")
