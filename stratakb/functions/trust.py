"""Confidence policy and the blended score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeutil import decayed, recency

# Caps by source, and the score's weights and nudges.
CAPS = {"verified": 0.95, "mined": 0.5, "explicit": 0.85}
IN_SET, BY_IMPORT, BESIDE = 1.0, 0.6, 0.3  # in the working set, next to it by import, under the same first path component
W_TEXT, W_NEAR, W_TRUST, W_RECENT = 0.45, 0.25, 0.20, 0.10


def quantized(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)


def default_confidence(source: Column, asked: Column) -> Column:
    """verified and mined have fixed ones; an explicit claim gets what it asks for, 0.8 by default, up to its cap."""
    explicit = F.greatest(F.lit(0.0), F.least(F.coalesce(asked, F.lit(0.8)), F.lit(CAPS["explicit"])))
    return F.when(source == "verified", CAPS["verified"]).when(source == "mined", CAPS["mined"]).otherwise(explicit)


def import_cap(source: Column) -> Column:
    return F.when(source == "verified", CAPS["verified"]).when(source == "mined", CAPS["mined"]).otherwise(CAPS["explicit"])


def imported_confidence(source: Column, claimed: Column) -> Column:
    return quantized(F.least(F.coalesce(claimed, F.lit(0.5)), import_cap(source)))


def score(text: Column, near: Column, confidence: Column, created: Column, now: Column, kind: Column, source: Column, status: Column) -> Column:
    by_kind = F.when(kind.isin("fact", "decision"), 0.05).when(kind == "episode", -0.05).otherwise(0.0)
    by_source = F.when((source == "verified") & (status == "active"), 0.10).when(source == "verified", 0.0).otherwise(-0.05)
    return W_TEXT * text + W_NEAR * near + W_TRUST * decayed(confidence, created, now) + W_RECENT * recency(created, now) + by_kind + by_source


def stale_penalty(source: Column, confidence: Column) -> Column:
    """Confidence after going from active to stale."""
    return F.round(F.when(source == "verified", F.least(confidence, F.lit(0.5))).otherwise(confidence * 0.6), 6)
