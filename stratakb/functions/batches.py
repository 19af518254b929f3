"""Functions of a text that give a list of strings, run in Python workers a few texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20  # of text whose results are held at a time


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in order, in pieces of at most SLICE_BYTES or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        full = np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")
        end = max(at + 1, int(full))
        yield texts.slice(at, end - at)
        at = end


def string_lists(make: Callable[[], Callable[[str | None], list[str] | None]], text: Column) -> Column:
    """array<string> of a text; make() gives the function for a slice, so what it remembers goes with that.

    An Arrow batch holds up to 10,000 texts, and a worker that builds the lists
    of all of them as Python strings takes many times their size.
    """

    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in slices(batch):
                f = make()
                yield pa.array([f(t) for t in piece.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(over, "array<string>")(text)
