"""Texts are worked through in slices of few bytes, with the same results."""

import re

import pyarrow as pa
from pyspark.util import PythonEvalType

from stratakb.functions import batches
from stratakb.functions.stem import fold, stemmed
from stratakb.sources.markdown import chunk_markdown, chunks

TEXTS = ["- one\n- two\n\nThe running\nqueues", None, "", "Cafés ½ ÀÉ été verified\n\n" * 30, "x" * 500, "1. a\n```\nb\n```\nc_d relational"] * 20


def plan_type(df):
    """The kind of the Python function in df's plan: an iterator's may give back more batches than were sent."""
    return int(re.search(r"ArrowEvalPython .*\], (\d+)", df._jdf.queryExecution().executedPlan().toString())[1])


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(batches, "SLICE_BYTES", 300)
    texts = pa.array(TEXTS).slice(1)
    pieces = [p.to_pylist() for p in batches.slices(texts)]
    assert [t for p in pieces for t in p] == TEXTS[1:]
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 300 for p in pieces) and len(pieces) > 30
    assert list(batches.slices(pa.array([], pa.string()))) == []


def test_a_worker_gives_back_slices(spark, monkeypatch):
    """So that no batch holds the lists of all texts it was sent."""
    monkeypatch.setattr(batches, "SLICE_BYTES", 300)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    got = {}
    for r in chunks(docs).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {i: c for i, t in enumerate(TEXTS) if (c := chunk_markdown(t))}
    stems = {r.doc_id: r.w for r in docs.select("doc_id", stemmed(docs.text).alias("w")).collect()}
    assert stems == {i: None if t is None else fold(t) for i, t in enumerate(TEXTS)}
    assert plan_type(docs.select(stemmed(docs.text))) == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF


def test_chunks_come_back_in_slices(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert plan_type(chunks(docs)) == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
