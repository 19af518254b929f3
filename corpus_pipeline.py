"""A corpus from documents to training sequences, in stages that each write what the next one reads.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Stages work on all rows they are given;
empty input gives empty output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakb.llm import bagminhash, decontam, langid, linededup, packing
from stratakb.runtime import materialize, table

TOKENIZER = "word_bpe_49k.json"


def _whole_rows(docs: DataFrame) -> DataFrame:
    """(row struct of all columns, text): an operator's own columns can't clash with those of docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter (null and empty texts too) or between languages go.

    Whole texts are judged, however long; repeated rows each on its own. A null
    id or lang does not matter here. Columns of any name stay as they are.
    """
    found = langid.identify(_whole_rows(docs), langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UND) & ~F.col("ambiguous")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line is like; those with a line, but none left, go.

    n_chars, where there is one, is counted anew. Null, empty and blank texts
    hold no line; only those with a line that goes can go. Rows without id stay
    whole; rows of one id keep the same lines. Ties go to the smaller id, then
    the earlier line. Columns of any name stay as they are.
    """
    out = linededup.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Null and wordless texts and rows without id stay; repeated rows of one id
    stay or go together; whole texts are compared. Columns stay as they are.
    """
    gone = bagminhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Null and wordless texts hold none; whole texts are scanned; repeated rows
    are judged each on its own. Columns of any name stay as they are.
    """
    found = decontam.decontaminate(_whole_rows(docs), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens: a null or empty text is its end id; long ones are cut; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]
#: SQL can't express the learned model, MinHash components and the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
