"""Benchmark decontamination with one Aho-Corasick automaton.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
lower-casing A-Z (digits, a-z and everything beyond ASCII). A window is
``n`` consecutive words of a benchmark item; an item with fewer words, but not
none, is one window. All windows go into one automaton over the normalised
form `` w1 w2 ... ``; each document's normalised text is scanned once, and the
hits are mapped back to word numbers and to character offsets of the original.

Defined results: a null or wordless text has no words, no hits and is clean; a
null item or one without words has no window; items with equal windows are all
reported; repeated rows are judged each on its own; extra columns are kept
unless they clash with an output column, which then wins. An empty benchmark
leaves everything clean.

Scale: no shuffle. The windows are broadcast only up to ``max_chars``
characters, some 300 MB of automaton nodes; a larger benchmark is split into
blocks of at most that size, and the rows pass through one scan per block, so no
block outgrows a worker.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, worker_cache

#: A word in the original text: the same with A-Z.
WORD = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans")
#: ASCII table: A-Z lower-cased, letters and digits kept, the rest a space; bytes over 127 belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _split(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def words_of(text: str | None) -> list[str]:
    """The normalised words of a text."""
    return [w.decode() for w in _split(text)]


def windows_of(text: str | None, n: int) -> set[str]:
    w = words_of(text)
    if not w:
        return set()
    return {f" {' '.join(w[i : i + n])} " for i in range(max(1, len(w) - n + 1))}


def build_automaton(patterns: list[tuple[str, list[str]]]):
    """patterns: (window, ids of the items that hold it)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (window, ids) in enumerate(patterns):
        a.add_word(window, (i, window.count(" ") - 1, ids))
    if patterns:
        a.make_automaton()
    return a


def scan(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, merged [first, last] word ranges that are hit, items hit)."""
    words = _split(text)
    if not words or not len(automaton):
        return len(words), [], set()
    norm = f" {b' '.join(words).decode()} "
    hits = [(end, n, ids) for end, (_, n, ids) in automaton.iter(norm)]
    if not hits:
        return len(words), [], set()
    ranges, at, last = [], 0, -1
    for end, n, _ in hits:  # by rising end
        at += norm.count(" ", last + 1, end + 1)
        last = end
        ranges.append((at - 1 - n, at - 2))  # the window's closing space is the at-th; words count from 0
    merged = merge(ranges)
    return len(words), merged, {i for _, _, ids in hits for i in ids}


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word ranges."""
    if not ranges:
        return []
    at = [(m.start(), m.end()) for m in re.finditer(WORD, text)]
    return [(at[a][0], at[b][1]) for a, b in ranges]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, n: int, text: str, item: str, max_chars: int) -> list[list[tuple[str, list[str]]]]:
    """Windows in blocks of at most max_chars characters (an item's windows may fall into several)."""
    blocks: list[dict[str, list[str]]] = [{}]
    used = 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).dropna().toLocalIterator():
        for w in windows_of(row.t, n):
            if used + len(w) > max_chars and blocks[-1]:
                blocks.append({})
                used = 0
            if w not in blocks[-1]:
                used += len(w)
            ids = blocks[-1].setdefault(w, [])
            if row.i not in ids:
                ids.append(row.i)
    return [sorted(b.items()) for b in blocks]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", max_chars: int = 4_000_000) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, item_ids and spans (start, end characters).

    The benchmark is small by nature; the driver reads it row by row and holds
    its windows, in blocks of max_chars characters. A worker holds one block's
    automaton at a time: between blocks the rows are written.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, n, item_text, item, max_chars)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<array<int>>").alias("r"), F.array().cast("array<string>").alias("i"), F.array().cast("array<array<int>>").alias("c"))
    #: the input's columns travel in a struct, so that none can clash with the scan's own
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), none.alias("found"))
    for k, block in enumerate(blocks):
        df = materialize(df, "scanned") if k else df
        df = df.withColumn("found", _scanner(spark.sparkContext.broadcast(block))(F.col("text"), F.col("found.r"), F.col("found.i")))
    return df.select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c not in OUT],
        F.col("found.n").alias("n_words"),
        F.aggregate("found.r", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0] + 1).alias("n_hit"),
        F.size("found.i").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.i", ","), 256).alias("items_sha256"),
        (F.size("found.r") > 0).alias("contaminated"),
        F.col("found.i").alias("item_ids"),
        F.transform("found.c", lambda c: F.struct(c[0].alias("start"), c[1].alias("end"))).alias("spans"),
    )


def _scanner(shared):
    """A UDF (text, word ranges so far, items so far) -> struct, for one block of windows."""

    name = uuid.uuid4().hex

    @F.pandas_udf("n long, r array<array<int>>, i array<string>, c array<array<int>>")
    def over(texts: pd.Series, ranges: pd.Series, items: pd.Series) -> pd.DataFrame:
        automaton = worker_cache(("automaton", name), lambda: build_automaton(shared.value))
        out = []
        for t, old_ranges, old_items in zip(texts, ranges, items, strict=True):
            t = t if isinstance(t, str) else None
            n, now, ids = scan(automaton, t)
            now = merge([(int(a), int(b)) for a, b in old_ranges] + now) if len(old_ranges) else now
            out.append((n, now, sorted({*old_items, *ids}), spans_of(t, now)))
        return pd.DataFrame(out, columns=["n", "r", "i", "c"])

    return over
