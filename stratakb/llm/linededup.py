"""Fuzzy line deduplication by MinHash over character shingles.

A document's lines are split at \\n, lower-cased, and their white space is
folded; equal lines are one class, told apart by 128 bits of hash. A line's set
is all its shingles of ``WIDTH`` characters, one from every character on; a
shorter line is its own shingle.

Every class gets ``ROWS * BANDS`` minima over its whole set. A band is a 64-bit
hash of ``ROWS`` of them; two lines of similarity 0.8 have none of the bands in
common with a chance of (1 - 0.8 ** ROWS) ** BANDS, 4 in 10,000. Low bits of the
minima are a sketch: pairs whose sketches differ by ``SIGMAS`` standard
deviations more than those of similarity 0.8 do are not compared further.

Classes with a common band are candidates. Every bucket's hub, its smallest
member, is compared with all members by exact Jaccard similarity of the whole
sets; then, between members still in different components, the remaining pairs
of a bucket are compared in blocks, by sketch and then exactly, each pair in its
first common bucket; only links leave a block. The distributed union of all
links gives the components; a component keeps its first line by document id,
then line number.

Lines are moved once, to make the classes. A bucket that many lines of one
Arrow batch share sends one of them to the bucket's task, the others are dealt
over all tasks, so that a bucket with a third of all lines is no single task.
Blocks of one bucket grow with the square of its members in different
components; memory and the size of a task do not.

Splitting, normalising, grouping and joins are DataFrame operations. Signatures
and the exact test are numpy and Python over Arrow batches: see README for the
figures of the form without Python.

Defined results: a null text has no lines; a blank line has no class and is
always kept; a null document id is never grouped; repeated rows of one id are
one document's lines twice (equal lines within a document count once); of tied
lines the one with the smaller document id, then line number, is first; a long
line is one set, whatever its length; an empty table gives an empty result;
extra columns are kept by ``dedup``, whatever their names. A class is named by
its first line, ``doc_id:line_no``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize, worker_clear
from .components import components
from .streams import arrow_groups

WIDTH, ROWS, BANDS = 5, 5, 20
SKETCH = 128  # bits, as two longs
SIGMAS = 5
BLOCK = 256  # members of a bucket compared at once
HUB_GROUP = 64  # members compared with one copy of their hub's text
CHARS = 1 << 15  # characters hashed at once: the arrays stay in the processor's cache
SHARDS = 1 << 24  # bits of a bitmap of ids: 2 MB, whatever the corpus
_WHITE = " \t\r\f\x0b"
_PLACE = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, norm, k1, k2) of every line that isn't blank; line_no from 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).where(F.ltrim("line", F.lit(_WHITE)) != "")
    lower, line = F.lower("line"), F.col("line")
    odd = line.startswith(" ") | line.endswith(" ")
    for white in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | line.contains(white)
    norm = F.when(odd, F.trim(F.regexp_replace(lower, r"\s+", " "))).otherwise(lower)
    #: a second seed for the second half: xxhash64(norm, 1) would be a function of xxhash64(norm)
    return rows.select("doc_id", "line_no", norm.alias("norm")).select("*", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"))


def shingles(norm: str) -> set[str]:
    """The set of a line."""
    return {norm[i : i + WIDTH] for i in range(len(norm) - WIDTH + 1)} or {norm}


def similar(a: set[str], b: set[str], threshold: float) -> bool:
    """Exact Jaccard similarity of at least threshold."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= threshold * (len(a) + len(b) - both)


def _multipliers() -> np.ndarray:
    return (np.random.default_rng(17).integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def minima(norms: list[str]) -> np.ndarray:
    """ROWS * BANDS minima of hashes of each line's shingles, as rows of uint32."""
    out, times = np.empty((len(norms), ROWS * BANDS), dtype=np.uint32), _multipliers()
    at = 0
    while at < len(norms):
        end, chars = at, 0
        while end < len(norms) and (end == at or chars < CHARS):
            chars += max(WIDTH, len(norms[end]))
            end += 1
        padded = [x if len(x) >= WIDTH else x.ljust(WIDTH, "\0") for x in norms[at:end]]
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        last = len(points) - WIDTH + 1
        h = points[:last] * _PLACE[0]
        for i in range(1, WIDTH):
            h += points[i : last + i] * _PLACE[i]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = np.append((h >> np.uint64(32)).astype(np.uint32), np.uint32(0))
        n = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
        stops = np.cumsum(n)
        cuts = np.column_stack([stops - n, stops - WIDTH + 1]).ravel()  # shingles over two lines are between the odd cuts and the even
        turned = np.empty_like(h)
        for k in range(ROWS * BANDS):
            np.multiply(h, times[k], out=turned)
            out[at:end, k] = np.minimum.reduceat(turned, cuts)[::2]
        at = end
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(least: np.ndarray) -> np.ndarray:
    """The lowest bits of all minima, then the second lowest of the first ones, as rows of two int64."""
    bits = np.concatenate([least & 1, least[:, : SKETCH - ROWS * BANDS] >> np.uint32(1) & 1], axis=1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<i8")


def bands(least: np.ndarray) -> np.ndarray:
    """The buckets of each line, as rows of int64."""
    parts = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS)).copy()
    for i in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h.view(np.int64)


def most_differing(threshold: float) -> int:
    """How many bits the sketches of two lines of this similarity may differ in."""
    p = (1 - threshold) / 2
    return int(SKETCH * p + SIGMAS * (SKETCH * p * (1 - p)) ** 0.5) + 1


def classes(of: DataFrame) -> DataFrame:
    """(cid, k1, k2, first, norm, s0, s1, bands) of each class of lines, s0 and s1 its sketch; cid is a number of its own once written."""

    @F.arrow_udf("s0 long, s1 long, bands array<long>")
    def sign(norms: pa.Array) -> pa.Array:
        worker_clear()
        least = minima(norms.to_pylist())
        found = pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1, dtype=np.int32) * BANDS), pa.array(bands(least).ravel()))
        sketch = sketches(least)
        return pa.StructArray.from_arrays([pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), found], ["s0", "s1", "bands"])

    one = of.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("norm").alias("norm"))
    return one.withColumn("s", sign("norm")).select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "first", "norm", "s.s0", "s.s1", "s.bands")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, cid, peer): peer is 0 for the only line of a bucket in its batch, 1 for the first of several, 2 for the others."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bands").flatten().to_numpy()
        cid = np.repeat(batch.column("cid").to_numpy(), BANDS)
        order = np.argsort(bucket, kind="stable")
        bucket, cid = bucket[order], cid[order]
        again = np.concatenate([[False], bucket[1:] == bucket[:-1]])
        peer = np.where(again, 2, np.concatenate([again[1:], [False]])).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(cid), pa.array(peer)], ["bucket", "cid", "peer"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of buckets, those that aren't alone in theirs."""
    held, was_same = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("bucket", "cid", "peer")]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        bucket, cid, peer = cols
        same = np.concatenate([[was_same], bucket[1:] == bucket[:-1]])
        keep = (same | (peer > 0))[:-1] | same[1:]
        held, was_same = [c[-1:] for c in cols], bool(same[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(bucket[:-1][keep]), pa.array(cid[:-1][keep])], ["bucket", "cid"])
    if held is not None and (was_same or held[2][0]):
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["bucket", "cid"])


def _texts(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, norm) of the wanted ids: a bitmap of bounded size drops most other lines before the shuffle."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARDS)) + 1
    maps = wanted.select(place("cid").alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("shard")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    near = known.select("cid", "norm", place("cid").alias("p")).withColumn("shard", F.expr("bitmap_bucket_number(p)")).join(F.broadcast(maps), "shard")  # SHARDS bits at most
    bit = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bitmap_bit_position(p) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(p) % 8 as int)) & 1")
    return near.where(bit == 1).select("cid", "norm").join(wanted, "cid")


def verify(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar, written; b's text is sent once for every HUB_GROUP of its partners."""
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    texts = materialize(_texts(known, wanted), "line-texts")
    per = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("per"))
    dealt = pairs.join(per, "b").select("a", F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.ceil(F.col("per") / HUB_GROUP)).cast("long").alias("salt"))
    members = dealt.join(texts, dealt["a"] == texts["cid"]).select("hub", "salt", F.lit(True).alias("member"), "cid", "norm")
    hubs = dealt.select("hub", "salt").distinct().join(texts, F.col("hub") == texts["cid"]).select("hub", "salt", F.lit(False).alias("member"), "cid", "norm")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: set[str] = set()
        for batch in batches:
            a, b = [], []
            for hub, member, cid, norm in zip(*(batch.column(c).to_pylist() for c in ("hub", "member", "cid", "norm")), strict=True):
                if not member:
                    of = shingles(norm)
                elif similar(of, shingles(norm), threshold):
                    a.append(cid)
                    b.append(hub)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = materialize(hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(compare, "a long, b long"), "line-links")
    discard(texts)
    return links


def _to_compare(cols: dict, s: int, e: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs of the block in rows s to e whose turn is here: in different components, sketches alike, this bucket their first in common."""
    left, right = (s + np.flatnonzero(cols["chunk"][s:e] == cols[side][s]) for side in ("x", "y"))
    lows = cols["lows"]
    differ = sum(np.bitwise_count((cols[k][left][:, None] ^ cols[k][right][None]).view(np.uint64)) for k in ("s0", "s1"))
    ok = (cols["component"][left][:, None] != cols["component"][right][None]) & (differ <= most)
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    here = int(np.argmax(lows[s] == cols["bucket"][s].astype(np.int32)))
    turn = ((lows[i] == lows[j]).argmax(axis=1) == here) & (cols["cid"][i] > cols["cid"][j]) if cols["x"][s] == cols["y"][s] else (lows[i] == lows[j]).argmax(axis=1) == here
    return i[turn], j[turn]


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    cols = {c: batch.column(c).to_numpy() for c in ("bucket", "x", "y", "chunk", "cid", "component", "s0", "s1")}
    return cols | {"lows": batch.column("lows").flatten().to_numpy().reshape(-1, BANDS)}


def _screen(most: int):
    """The rows of each block that have a pair to compare there."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in arrow_groups(batches, ["bucket", "x", "y"]):
            cols, keep = _columns(batch), np.zeros(batch.num_rows, dtype=bool)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for rows in _to_compare(cols, s, e, most):
                    keep[rows] = True
            if keep.any():
                yield batch.filter(pa.array(keep))

    return over


def _compare(most: int, threshold: float):
    """Links of each block, a spanning forest of them."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in arrow_groups(batches, ["bucket", "x", "y"]):
            cols, norms, of_a, of_b = _columns(batch), batch.column("norm"), [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                sets: dict[int, set[str]] = {}
                root = {c: c for c in cols["component"][s:e].tolist()}

                def top(c: int, root: dict[int, int] = root) -> int:
                    while root[c] != c:
                        root[c] = c = root[root[c]]
                    return c

                for i, j in zip(*(x.tolist() for x in _to_compare(cols, s, e, most)), strict=True):
                    a, b = top(int(cols["component"][i])), top(int(cols["component"][j]))
                    if a == b:
                        continue
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = shingles(norms[k].as_py())
                    if similar(sets[i], sets[j], threshold):
                        root[max(a, b)] = min(a, b)
                        of_a.append(int(cols["cid"][i]))
                        of_b.append(int(cols["cid"][j]))
            if of_a:
                yield pa.RecordBatch.from_arrays([pa.array(of_a, pa.int64()), pa.array(of_b, pa.int64())], ["a", "b"])

    return over


def line_components(known: DataFrame, threshold: float) -> DataFrame:
    """(cid, component) of the classes that have a link; known: what ``classes`` gives, written."""
    listed = known.select("cid", "bands").mapInArrow(_list, "bucket long, cid long, peer tinyint")
    spread = F.when(F.col("peer") == 2, F.xxhash64("cid")).otherwise(F.col("bucket"))
    shared = listed.repartition(spread).sortWithinPartitions("bucket").mapInArrow(_shared, "bucket long, cid long")
    shared = materialize(shared, "line-shared")
    members = materialize(shared.join(known.select("cid", "s0", "s1"), "cid"), "line-members")
    discard(shared)
    most = most_differing(threshold)
    hubs = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.min("cid").alias("hub"), F.min_by("s0", "cid").alias("h0"), F.min_by("s1", "cid").alias("h1")).where("many > 1")
    alike = F.bit_count(F.col("s0").bitwiseXOR(F.col("h0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("h1"))) <= most
    stars = materialize(members.join(hubs, "bucket").where((F.col("cid") != F.col("hub")) & alike).select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct(), "line-stars")
    first = verify(stars, known, threshold)
    groups = components(first).withColumnRenamed("node", "cid")
    discard(stars, first)
    placed = members.join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    #: of two members one is the hub: they have been compared
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("many")).where("c0 != c1 and many > 2").select("bucket", F.ceil(F.col("many") / BLOCK).cast("long").alias("chunks"))
    blocks = placed.join(open_, "bucket").withColumn("chunk", F.pmod(F.xxhash64("cid"), "chunks"))
    lows = F.transform("bands", lambda v: F.shiftright(F.shiftleft(v, 32), 32).cast("int"))
    blocks = blocks.join(known.select("cid", lows.alias("lows")), "cid").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    blocks = blocks.select("bucket", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "cid", "component", "s0", "s1", "lows")
    ordered = lambda df: df.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    near = materialize(ordered(blocks).mapInArrow(_screen(most), blocks.schema), "line-near")
    second = ordered(near.join(_texts(known, near.select("cid").distinct()), "cid")).mapInArrow(_compare(most, threshold), "a long, b long")
    #: the first round's stars stand for its links
    stands = groups.where("cid != component").select(F.col("cid").alias("a"), F.col("component").alias("b"))
    final = components(stands.unionByName(second)).withColumnRenamed("node", "cid")
    discard(members, near)
    return final


def line_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, line_no, class_id, component_id, kept) of every line that isn't blank."""
    all_lines = lines(docs, doc_id=doc_id, text=text)
    known = materialize(classes(all_lines.where("doc_id is not null")), "line-classes")
    listed = materialize(all_lines.select("doc_id", "line_no", "k1", "k2"), "lines")
    groups = materialize(line_components(known, threshold), "line-components")
    #: only classes with a link need the first line of their component looked up
    linked = groups.join(known.select("cid", "first"), "cid")
    owners = linked.groupBy("component").agg(F.min("first").alias("owner"))
    moved = linked.join(owners, "component").select("cid", "owner")
    placed = known.select("cid", "k1", "k2", "first").join(moved, "cid", "left").select("k1", "k2", "first", F.coalesce("owner", "first").alias("owner"))
    out = listed.join(placed, ["k1", "k2"], "left")
    name = lambda c: F.concat(F.col(f"{c}.doc_id").cast("string"), F.lit(":"), F.col(f"{c}.line_no").cast("string"))
    none = F.col("doc_id").isNull()
    kept = none | ((F.col("doc_id") == F.col("owner.doc_id")) & (F.col("line_no") == F.col("owner.line_no")))
    return out.select("doc_id", "line_no", F.when(~none, name("first")).alias("class_id"), F.when(~none, name("owner")).alias("component_id"), kept.alias("kept"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs without the lines that are not kept; a document all of whose lines go, goes."""
    gone = line_classes(docs, doc_id=doc_id, text=text, threshold=threshold).where(~F.col("kept")).groupBy("doc_id").agg(F.collect_set("line_no").alias("lines"))
    rows = docs.alias("d").join(gone.alias("g"), F.col(f"d.{doc_id}") == F.col("g.doc_id"), "left")
    whole, changed = F.col(f"d.{text}"), F.col("g.lines").isNotNull()
    left = F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains("g.lines", i)), "\n")
    cut = F.when(changed, left).otherwise(whole)
    return rows.where(~changed | cut.rlike(r"\S")).select(*[(cut if c == text else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
