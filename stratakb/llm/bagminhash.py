"""MinHash near-duplicates of weighted sets by BagMinHash.

A document is the multiset of its 5-word shingles (words as in decontam; fewer
words are one shingle). The weight axis of every shingle is discretised: each
unit of its count is a cell, and the cells are taken in dyadic intervals
[0,1), [1,2), [2,4), ... with one Poisson process each, whose rate is the
interval's length. A process yields points by rising value; each point has a
register and a place on the weight axis and counts only if its cell is within
the shingle's count. The identity of the least point of each register is the
signature; two registers agree with probability equal to the weighted Jaccard
similarity. Points beyond a bound that leaves a register empty with a chance of
e^-6 are not generated; if one stays empty the bound is doubled.

Grouping: documents with equal words are one class. Classes that share a band
are candidates. Every bucket's hub, the member whose buckets hold most
documents, is compared exactly with all members; then, only between members
that are still in different components, the remaining pairs of a bucket are
screened in blocks by their signatures, then by their whole multisets, and
compared exactly; only links leave a block. So a large
group costs a comparison for each member and no link between different texts
is left to chance but for the bands' own recall. A bucket of m members in
different components costs m * m / BLOCK rows of features: bounded for each
task, but quadratic in all.

Defined results: a null or wordless text is a class of its own and stays;
repeated rows with one id count once; a null id is never grouped; an empty
table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize
from .components import components
from .decontam import _FOLD
from .streams import stream_groups

SHINGLE, REGISTERS, ROWS = 5, 96, 4
BANDS = REGISTERS // ROWS
BLOCK = 256  # members of a bucket compared at once
SIGMAS = 4.5
_POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, np.uint64(0x9E3779B97F4A7C15))]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str | None) -> bytes:
    """The words, joined by one space."""
    return b" ".join(text.encode().translate(_FOLD).split()) if text else b""


def shingles(norm: bytes, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes, how often each occurs) of normalised words."""
    if not norm:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = np.frombuffer(norm, dtype=np.uint8)
    spaces = np.flatnonzero(b == 32)
    starts = np.concatenate([[0], spaces + 1])
    lengths = np.concatenate([spaces, [len(b)]]) - starts
    place = np.arange(len(b)) - np.repeat(starts, np.concatenate([lengths[:-1] + 1, lengths[-1:]]))
    power = _POW
    if place.max() >= len(power):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()) + 1, np.uint64(0x9E3779B97F4A7C15))]), dtype=np.uint64)
    value = (b.astype(np.uint64) + np.uint64(1)) * power[place]
    value[spaces] = 0
    words = mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64))
    n = max(1, len(words) - k + 1)
    h = np.full(n, np.uint64(min(len(words), k)))
    for i in range(min(k, len(words))):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return np.unique(h, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two multisets."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signature(h: np.ndarray, w: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The m register identities of a weighted set that isn't empty."""
    bound = m * (np.log(m) + 6) / float(w.sum())
    levels = [(0, 0.0, 1.0)] + [(i, 2.0 ** (i - 1), 2.0 ** (i - 1)) for i in range(1, int(w.max() - 1).bit_length() + 1)]
    while True:
        at, who, register = [], [], []
        for level, low, rate in levels:
            use = w > low
            key = mix(h[use] ^ mix(np.full(1, np.uint64(level + 1)))[0])
            limit = w[use]
            first = -np.log(_uniform(mix(key + np.uint64(1)))) / rate
            live = np.flatnonzero(first <= bound)
            if not len(live):
                continue
            key, limit = key[live], limit[live]
            step, j, clock = int(bound * rate) + 2, 1, np.zeros(len(live))
            while len(key):  # some points of each process, then more of those not yet past the bound
                seeds = mix(key[:, None] + np.arange(j, j + step, dtype=np.uint64)[None])
                times = clock[:, None] + np.cumsum(-np.log(_uniform(seeds)), axis=1) / rate
                ok = times <= bound
                s, of = seeds[ok], np.nonzero(ok)[0]
                more = mix(s ^ np.uint64(0xA0761D6478BD642F))
                t = times[ok]
                if level:
                    within = low + rate * _uniform(mix(more)) < limit[of]
                    t, s, more = t[within], s[within], more[within]
                at.append(t)
                who.append(s)
                register.append(more % np.uint64(m))
                go = ok[:, -1]
                key, limit, clock, j = key[go], limit[go], times[go, -1], j + step
        if at:
            t, s, r = np.concatenate(at), np.concatenate(who), np.concatenate(register).astype(np.int64)
            order = np.lexsort((s, t))
            found, first = np.unique(r[order], return_index=True)
            if len(found) == m:
                return s[order][first].astype(np.uint32)
        bound *= 2


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band."""
    parts = sig.reshape(-1, rows).astype(np.uint64)
    h = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for i in range(rows):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + parts[:, i])
    return h.view(np.int64)


def _sketch(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        norm = normal(t if isinstance(t, str) else None)
        if not norm:
            out.append((None, 0, None, None))
            continue
        h, w = shingles(norm)
        sig = signature(h, w)
        out.append((hashlib.blake2b(norm, digest_size=16).digest(), int(w.sum()), sig.tobytes(), bands(sig)))
    return pd.DataFrame(out, columns=["key", "n", "sig", "bands"])


def _exact(threshold: float):
    """Of a hub (first row) and members: which members are similar enough."""

    def over(pdf: pd.DataFrame) -> pd.DataFrame | None:
        if pdf["member"].iloc[0]:
            return None
        texts = pdf["text"].to_numpy()
        hub = shingles(normal(texts[0]))
        ok = [i for i in range(1, len(pdf)) if pdf["member"].iloc[i] and similarity(hub, shingles(normal(texts[i]))) >= threshold]
        return pd.DataFrame({"a": pdf["id"].to_numpy()[ok], "b": np.full(len(ok), pdf["hub"].iloc[0])}) if ok else None

    return over


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, group: int = 64) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) have a weighted Jaccard similarity of at least threshold.

    Pairs are grouped by b in salted groups of about ``group`` members, so b's
    text is sent once for each group and no group grows with the data.
    """
    per = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("per"))
    dealt = pairs.join(per, "b").select("a", F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.ceil(F.col("per") / group)).cast("long").alias("salt"))
    members = dealt.join(texts, dealt["a"] == texts["id"]).select("hub", "salt", F.lit(True).alias("member"), "id", "text")
    hubs = dealt.select("hub", "salt").distinct().join(texts, F.col("hub") == texts["id"]).select("hub", "salt", F.lit(False).alias("member"), "id", "text")
    return stream_groups(hubs.unionByName(members), ["hub", "salt"], ["member", "id"], _exact(threshold), "a long, b long")


def features(text: str | None) -> bytes:
    """A multiset as sorted 32-bit hashes: the k-th occurrence of a shingle is an element of its own, so common elements are common weight."""
    h, w = shingles(normal(text))
    h, w = np.repeat(h, w), np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    return np.sort(mix(h ^ mix(w.astype(np.uint64) + np.uint64(1))).astype(np.uint32)).tobytes()


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs (i, j) of sorted sets; for many pairs as products of incidence matrices."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    at_i, at_j = at[: len(i)], at[len(i) :]
    own = [sets[k] for k in used]
    values, column = np.unique(np.concatenate(own), return_inverse=True)
    if len(i) < 64 or len(values) * len(used) > 30_000_000:
        return np.array([np.isin(own[a], own[b], assume_unique=True).sum() for a, b in zip(at_i, at_j, strict=True)])
    m = np.zeros((len(used), len(values)), dtype=np.float32)
    m[np.repeat(np.arange(len(used)), [len(x) for x in own]), column] = 1
    left, right = np.unique(at_i), np.unique(at_j)
    return (m[left] @ m[right].T)[np.searchsorted(left, at_i), np.searchsorted(right, at_j)].astype(np.int64)


def _screen(threshold: float):
    """Pairs of a block of a bucket in different components that are similar by their features, each from its first common band."""
    least = int(np.floor(REGISTERS * threshold - SIGMAS * np.sqrt(REGISTERS * threshold * (1 - threshold))))

    def over(pdf: pd.DataFrame) -> pd.DataFrame | None:
        if len(pdf) < 2:
            return None
        x, y, band = pdf["x"].iloc[0], pdf["y"].iloc[0], int(pdf["band"].iloc[0])
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), -1)
        sets = [np.frombuffer(b, dtype=np.uint32) for b in pdf["features"]]
        chunk, ids, comp = (pdf[c].to_numpy(np.int64) for c in ("chunk", "id", "component"))
        n = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(chunk == x), np.flatnonzero(chunk == y)
        first_of, second_of = [], []
        for i in left:
            j = right[(comp[right] != comp[i]) & (np.minimum(n[right], n[i]) >= threshold * np.maximum(n[right], n[i])) & ((ids[right] > ids[i]) if x == y else True)]
            if not len(j):
                continue
            same = sig[j] == sig[i]
            first = same.reshape(len(j), BANDS, ROWS).all(axis=2).argmax(axis=1)
            j = j[(same.sum(axis=1) >= least) & (first == band)]
            first_of.append(np.full(len(j), i))
            second_of.append(j)
        if not first_of or not sum(map(len, first_of)):
            return None
        i, j = np.concatenate(first_of), np.concatenate(second_of)
        both = _common(sets, i, j)
        #: elements that collide in 32 bits change a count, by ever more in long texts; the exact comparison follows
        slack = 2 + (n[i] + n[j]).astype(np.float64) ** 2 / 2**30
        ok = both + slack >= threshold * (n[i] + n[j] - both - slack)
        return pd.DataFrame({"a": np.maximum(ids[i[ok]], ids[j[ok]]), "b": np.minimum(ids[i[ok]], ids[j[ok]])}) if ok.any() else None

    return over


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, group_id, kept): class_id the smallest id with equal words, group_id the smallest id of the component."""
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = materialize(base.withColumn("s", F.pandas_udf(_sketch, "key binary, n long, sig binary, bands array<long>")("text")).select("id", "s.*"), "sketches")
    real = sketched.where("id is not null and key is not null")
    classes = materialize(real.groupBy("key").agg(F.min_by(F.struct("id", "n", "sig", "bands"), "id").alias("s")).select("key", "s.*"), "classes")
    texts = base.where("id is not null").dropDuplicates(["id"])

    listed = classes.select("id", F.posexplode("bands").alias("band", "value"))
    counts = listed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("least")).where("many > 1")
    members = materialize(listed.join(counts.drop("least"), ["band", "value"]), "members")
    degree = members.groupBy("id").agg(F.sum("many").alias("degree"))
    ranked = members.join(degree, "id")
    hubs = ranked.groupBy("band", "value").agg(F.max(F.struct("degree", -F.col("id")))["col2"].alias("hub")).withColumn("hub", -F.col("hub"))
    stars = materialize(members.join(hubs, ["band", "value"]).where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    wanted = texts.join(members.select("id").distinct(), "id", "left_semi")
    texts = materialize(wanted, "texts")
    first = materialize(verify(stars, texts, threshold), "links")

    groups = components(first)
    placed = members.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("band", "value").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("many")).where("c0 != c1").select("band", "value", F.ceil(F.col("many") / BLOCK).cast("long").alias("chunks"))
    blocks = placed.drop("many").join(open_, ["band", "value"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
    feature = F.pandas_udf(lambda texts: texts.map(features), "binary")
    known = materialize(texts.join(blocks.select("id").distinct(), "id").select("id", feature("text").alias("features")), "features")
    blocks = blocks.join(classes.select("id", "sig"), "id").join(known, "id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    blocks = blocks.select("*", other).select(F.col("band").cast("long").alias("band"), "value", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "id", "component", "sig", "features")
    rest = stream_groups(blocks, ["band", "value", "x", "y"], ["id"], _screen(threshold), "a long, b long").distinct()
    done = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = materialize(rest.join(done, ["a", "b"], "left_anti"), "rest")
    second = verify(rest, texts, threshold)
    #: the first round's stars stand for its links
    stands = groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(stands.unionByName(second))
    discard(members, stars, texts, first, known, rest)

    per_class = classes.select("key", F.col("id").alias("class_id")).join(final.withColumnRenamed("node", "class_id"), "class_id", "left").select("key", "class_id", F.coalesce("component", "class_id").alias("group_id"))
    out = sketched.select("id", "key").join(per_class, "key", "left")
    has = F.col("id").isNotNull()
    out = out.select(F.col("id").alias("doc_id"), F.when(has, F.coalesce("class_id", "id")).alias("class_id"), F.when(has, F.coalesce("group_id", "id")).alias("group_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))
