"""Groups of bounded size, streamed through Python in key order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """f of every group of rows with equal keys, its rows in order; one shuffle and a sort, no pandas grouping.

    Keys are non-null longs. A group is held in memory, so the caller bounds it.
    """

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            k = batch[keys].to_numpy(np.int64)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            if held and (held[-1][keys].iloc[-1].to_numpy(np.int64) != k[0]).any():
                if (out := f(pd.concat(held, ignore_index=True))) is not None:
                    yield out
                held = []
            start, found = 0, []
            for cut in cuts:
                part = batch.iloc[start:cut]
                if held:
                    part, held = pd.concat([*held, part], ignore_index=True), []
                if (out := f(part)) is not None:
                    found.append(out)
                start = cut
            held.append(batch.iloc[start:])
            if found:
                yield pd.concat(found, ignore_index=True)
        if held and (out := f(pd.concat(held, ignore_index=True))) is not None:
            yield out

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInPandas(over, schema)


def arrow_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """(batch, cuts): whole groups of rows with equal keys, group k being the rows from cuts[k] to cuts[k + 1].

    The rows come in the order of the keys, which are non-null longs. A batch
    and a group are held in memory, so the caller bounds the group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        k = np.column_stack([batch.column(c).to_numpy() for c in keys])
        starts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        first = np.array([held[0].column(c)[0].as_py() for c in keys])
        if not len(starts) and (k[0] == first).all():
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        whole = whole.to_batches()[0]
        before = whole.num_rows - batch.num_rows
        cuts = [0, *([before] if before and (k[0] != first).any() else []), *(before + starts).tolist()]
        yield whole.slice(0, cuts[-1]), cuts
        held = [whole.slice(cuts[-1])]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield whole, [0, whole.num_rows]
