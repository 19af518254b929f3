"""Markdown notes as chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import string_lists
from ..functions.guards import bad_path, write_reject
from ..functions.hashing import normal_path
from ..functions.text import paths_in
from ..schemas import KINDS

_ITEM = re.compile(r"(?:[-*+]|[0-9]+\.) (.*)", re.S)


def chunk_markdown(text: str | None) -> list[str]:
    """Bullets and numbered items alone, other lines as paragraphs joined by a space; headings and fenced code are left out (an unclosed fence to the end)."""
    chunks: list[str] = []
    run: list[str] = []
    fence = ""

    def close() -> None:
        if run:
            chunks.append(" ".join(run))
            run.clear()

    for raw in (text or "").splitlines():
        line = raw.strip()
        if fence:
            fence = "" if line.startswith(fence) else fence
            continue
        mark = line[:3]
        item = _ITEM.match(line)
        if mark in ("```", "~~~"):
            close()
            fence = mark
        elif not line or line.startswith("#"):
            close()
        elif item:
            close()
            chunks += [item[1].strip()] if item[1].strip() else []
        else:
            run.append(line)
    close()
    return chunks


def chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, chunk) of every document."""
    return docs.select(F.col(key), F.posexplode(string_lists(lambda: chunk_markdown, F.col(text))).alias("n", "chunk"))


def seeds(docs: DataFrame, *, path: str = "path", text: str = "text", kind: str = "fact", known: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """(origin, body, file, source, kind, unanchored): each distinct chunk of a notes file as a mined entry, keyed so that a second run adds nothing.

    file is the first path the chunk names that is among the known files (path);
    without known files, the notes file itself. mode none anchors nothing, and
    file marks chunks that name no known file as unanchored.
    """
    if mode not in ("auto", "file", "none"):
        raise ValueError(f"an unknown mode of anchors: {mode}")
    if kind not in KINDS:
        raise ValueError(f"an unknown kind: {kind}")
    c = chunks(docs, key=path, text=text).withColumn("origin", F.concat(F.lit("seed:"), F.col(path), F.lit(":"), F.lower(F.hex(F.xxhash64("chunk"))))).dropDuplicates(["origin"])
    none = F.lit(None).cast("string")
    if mode == "none":
        c = c.withColumn("file", none)
    elif known is None:
        c = c.withColumn("file", F.col(path))
    else:
        named = c.select("origin", F.posexplode(paths_in(F.col("chunk"))).alias("place", "file")).withColumn("file", normal_path(F.col("file"))).where(~bad_path(F.col("file")))
        first = named.join(known.select(F.col("path").alias("file")).distinct(), "file").groupBy("origin").agg(F.min_by("file", "place").alias("file"))
        c = c.join(first, "origin", "left")
    unanchored = F.lit(mode == "file") & F.col("file").isNull()
    return c.select("origin", F.col("chunk").alias("body"), "file", F.lit("mined").alias("source"), F.lit(kind).alias("kind"), unanchored.alias("unanchored"))


def seed_outcomes(found: DataFrame, entries: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """found with outcome: skipped without an anchor, unchanged (origin known), rejected by a guard, refused as a near duplicate on the same file, else seeded."""
    known = entries.where("origin is not null").select("origin", F.lit(True).alias("known")).distinct()
    none = F.lit(None).cast("string")
    j = found.join(known, "origin", "left")
    j = j.join(refused.select("origin", F.lit(True).alias("twin")).distinct(), "origin", "left") if refused is not None else j.withColumn("twin", F.lit(None).cast("boolean"))
    bad = write_reject(F.col("kind"), F.col("body"), F.col("source"), F.col("origin"), F.lit(False), none, none)
    outcome = F.when(F.col("unanchored"), "skipped").when(F.col("known"), "unchanged").when(bad.isNotNull(), "rejected").when(F.col("twin"), "refused").otherwise("seeded")
    return j.withColumn("outcome", outcome).drop("known", "twin")
