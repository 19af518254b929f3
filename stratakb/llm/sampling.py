"""Bounded, documented training samples and the fold rule of the labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, mod 5; rows of fold 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "label", text: str = "text", per_label: int, max_chars: int) -> list[tuple]:
    """(label, text) of at most per_label rows of each label, texts up to max_chars characters.

    Rows of fold 0 and rows with a null id, label or text are not used. The
    choice is by the smallest hashes of the id, so it does not depend on the
    partitions; the result is sorted and goes to the driver, per_label *
    max_chars characters for each label at most. A label's rows are counted
    first, and only hashes below a bound that leaves a few more than per_label
    of them are ranked, so that no task ranks a label's rows.
    """
    of = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).dropna().where(~held_out("__id"))
    of = of.withColumn("__u", F.shiftrightunsigned(F.xxhash64("__id"), 11) * 2.0**-53)
    enough = per_label + 8 * per_label**0.5 + 20
    bound = of.groupBy("__label").agg((F.lit(enough) / F.count(F.lit(1))).alias("__bound"))  # a row for each label
    few = of.join(F.broadcast(bound), "__label").where(F.col("__u") <= F.col("__bound")).dropDuplicates(["__id"])
    top = few.withColumn("__n", F.row_number().over(Window.partitionBy("__label").orderBy("__u", "__id"))).where(F.col("__n") <= per_label)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).where(F.length("__text") <= max_chars).join(F.broadcast(top.select("__id", "__label", "__n")), "__id")
    return [(r["__label"], r["__text"]) for r in sorted(rows.collect(), key=lambda r: (r["__n"], str(r["__label"]), r["__text"]))]
