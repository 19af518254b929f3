"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors are one class. The classes are dealt into tiles of bounded size,
and each pair of tiles is one task. A unit vector x is quantised to s*q with q
in -127..127, e = x - s*q; the int8 product s_x*s_y*(q_x.q_y) then differs from
the cosine by at most |s_x*q_x|*|e_y| + |e_x|, so pairs whose product plus bound
stays below the threshold need nothing more; the others, and only those, are
recomputed in double precision. A task folds each block of links into its counts
and its forest before the next, so it never holds the links of two dense tiles,
and returns a row for each vector with a link (how many, and the smallest class
it reaches within the task). Components are the distributed
union of these forests.

Defined results: null vectors, those with a null or non-finite component, of
norm zero or of no dimension, and rows without id link with nothing and stay;
vectors of different dimension do not link; repeated rows are vectors of their
own (each other's links); an empty table gives an empty result; extra columns
are not carried.

All pairs of vectors are compared, so the work is quadratic by contract; memory
and the size of a task are not, and copies of one vector, however many, are
compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .components import components

TILE = 8192
BLOCK = 1024  # rows of a tile product held at once
PAIRS = 1 << 20  # pairs of a block held at once


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantised:
    """Unit vectors as int8 with scales and exact norms of what was lost."""

    def __init__(self, x: np.ndarray):
        self.scale = np.abs(x).max(axis=1) / 127
        q = np.rint(x / self.scale[:, None])
        near = q * self.scale[:, None]
        self.q = q.astype(np.int8)
        self.norm = np.sqrt((near * near).sum(axis=1))
        self.lost = np.sqrt(((x - near) ** 2).sum(axis=1))

    def rows(self) -> np.ndarray:
        return self.q.astype(np.float32)


def product(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: float32 sums of 1,000 products of at most 127 * 127 stay under 2 ** 24."""
    if q.shape[1] <= 1000:
        return q @ r.T
    return sum((q[:, i : i + 1000] @ r[:, i : i + 1000].T).astype(np.float64) for i in range(0, q.shape[1], 1000))


def links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Blocks of row numbers of the pairs with cosine >= threshold, and how many pairs were recomputed for it; y None: pairs within x, once each.

    A block holds at most PAIRS links, so memory doesn't grow with their number.
    """
    a, same = Quantised(x), y is None
    y = x if same else y
    b = a if same else Quantised(y)
    r = b.rows()
    for at in range(0, len(x), BLOCK):
        rows = slice(at, at + BLOCK)
        g = product(a.q[rows].astype(np.float32), r)
        g *= b.scale.astype(g.dtype)
        #: slack for the rounding of the float32 scaling and of the sums behind the bounds
        least = (threshold - a.lost[rows] - a.norm[rows] * b.lost.max() - 1e-5) / a.scale[rows]
        near = g >= least[:, None].astype(g.dtype)
        if same:
            near &= np.arange(near.shape[1])[None] > at + np.arange(len(near))[:, None]
        del g
        step = max(1, PAIRS // near.shape[1])
        for top in range(0, len(near), step):
            i, j = np.nonzero(near[top : top + step])
            i += at + top
            if len(i):
                ok = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65_536]], y[j[k : k + 65_536]]) >= threshold for k in range(0, len(i), 65_536)])
                yield i[ok], j[ok], len(i)


class Forest:
    """The smallest number reachable from each of n nodes over the links so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (flat := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = flat


def _tile_pair(threshold: float):
    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable", ignore_index=True)
        x = unit(np.stack(pdf["embedding"].to_numpy()))
        tile, ids, many = pdf["tile"].to_numpy(), pdf["rep"].to_numpy(np.int64), pdf["many"].to_numpy(np.int64)
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left, right = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        n, forest = np.zeros(len(ids), dtype=np.int64), Forest(len(ids))
        if len(left) and len(right):
            for i, j, _ in links(x[left], None if lo == hi else x[right], threshold):
                i, j = left[i], right[j]
                n += np.bincount(i, many[j], len(ids)).astype(np.int64) + np.bincount(j, many[i], len(ids)).astype(np.int64)
                forest.add(i, j)
        has = np.flatnonzero(n)
        return pd.DataFrame({"rep": ids[has], "n": n[has], "root": ids[forest.root[has]]})

    return over


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    e = F.col("embedding")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    keyed = rows.select("vec_id", F.when(good, F.sha2(e.cast("string"), 256)).alias("key"), F.when(good, e).alias("embedding"))
    classes = materialize(keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "classes")
    tiles = classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = classes.join(F.broadcast(tiles), "dim").withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int"))  # a row for each dimension there is
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("dim", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "rep", "many", "embedding")
    found = materialize(paired.groupBy("dim", "lo", "hi").applyInPandas(_tile_pair(threshold), "rep long, n long, root long"), "links")
    groups = components(found.where("rep != root"), "rep", "root").withColumnRenamed("node", "rep")
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    result = classes.select("key", "rep", "many").join(linked, "rep", "left").join(groups, "rep", "left")
    result = result.select("key", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", "key").join(result, "key", "left")
    component = F.coalesce(F.col("component_id"), F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
