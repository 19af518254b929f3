"""Best-fit packing of token sequences by exact-complement hashing.

Each document becomes token ids plus one end id; a longer one is cut into
pieces of ``capacity`` ids. How many pieces of each length there are (at most
``capacity`` numbers) decides the whole plan: lengths descending, the gap a
piece leaves is looked up among single lengths, sums of two and sums of three
lengths that are still available, and such exact combinations are consumed as
often as their counts allow; what has no exact complement is placed best-fit,
longest first. The plan says which ranks of each length go to which sequences
and offsets, so the pieces themselves never meet on the driver: they are ranked
within (length, salt) groups of bounded size and looked up in the plan; the salt
is of the row, so that not even one document's repeated rows make a large group.

Defined results: a null or empty text is the end id alone; repeated rows are
packed like any other; a length's rank order is by document id, piece, start,
ids_crc32 (rows equal in all of these are interchangeable); an empty table
gives no sequences; only doc_id and text are read, so other columns can't
clash. Every piece gets exactly one place; sequences are gapless from 0.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, worker_cache

CAPACITY, END = 4096, 1
#: Words whose ids a worker keeps; others are tokenized each time, with the same result.
CACHE_WORDS = 400_000
TEXTS = 1024  # texts whose words are looked up together
#: White space for Python but not for the tokenizer, and characters whose lower case could differ between the two.
_ODD = re.compile("[\x1c-\x1f]|[^\x00-ɏ]")
_SPECIAL = "<|"  # what the tokenizer's own tokens begin with: texts that hold it are encoded whole


def _odd(t: str) -> bool:
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return _ODD.search(t) is not None
    return "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t


class Encoder:
    """Ids of whole texts as bytes of little-endian uint32, by a tokenizer whose pieces never cross white space."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word, encoded many at a time."""
        out: dict[str, bytes] = {}
        chunks = [words[i : i + 200] for i in range(0, len(words), 200)]
        for part, e in zip(chunks, self.t.encode_batch([" ".join(p) for p in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            begins = np.cumsum([0] + [len(w) + 1 for w in part])
            cut = np.searchsorted(np.fromiter((o[0] for o in e.offsets), dtype=np.int64, count=len(ids)), begins)
            raw = ids.tobytes()
            for w, a, b in zip(part, cut[:-1] * 4, cut[1:] * 4, strict=True):
                out[w] = raw[a:b]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [None if t and (_odd(t) or _SPECIAL in t) else t.lower().split() if t else [] for t in texts]
        new = list(set().union(*(w for w in split if w)).difference(self.known)) if any(split) else []
        extra = self._learn(new) if new else {}
        keep = len(self.known) + len(extra) <= CACHE_WORDS
        self.known.update(extra)
        get = self.known.__getitem__
        out = [self._whole(t) if words is None else b"".join(map(get, words)) for t, words in zip(texts, split, strict=True)]
        if not keep:
            for w in extra:
                del self.known[w]
        return out


def pieces_of(ids: bytes, capacity: int = CAPACITY, end: int = END) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its ids) of a document's ids and the end id."""
    raw = ids + np.array([end], dtype="<u4").tobytes()
    return [(k, k * capacity, (min(len(raw), (k + 1) * capacity * 4) - k * capacity * 4) // 4, zlib.crc32(raw[k * capacity * 4 : (k + 1) * capacity * 4])) for k in range(-(-len(raw) // (capacity * 4)))]


def tokenize(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(texts: pd.Series) -> pd.Series:
        encoder = worker_cache(("encoder", tokenizer), lambda: Encoder(tokenizer))
        out = []
        for i in range(0, len(texts), TEXTS):
            part = [t if isinstance(t, str) else None for t in texts.iloc[i : i + TEXTS]]
            out += [[{"piece": k, "start": s, "length": n, "ids_crc32": c} for k, s, n, c in pieces_of(ids, capacity, end)] for ids in encoder.encode(part)]
        return pd.Series(out)

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(cut(F.col(text))).alias("p")).select("doc_id", "p.*")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """[(how many sequences, the lengths each holds)], which use up counts exactly."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    for length, c in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length}")
        n[length] = c
    out: list[tuple[int, tuple[int, ...]]] = []

    def pair(gap: int) -> tuple[int, int] | None:
        """Available lengths a >= b with a + b = gap."""
        if gap < 2:
            return None
        a = np.arange((gap + 1) // 2, gap)
        ok = np.flatnonzero((n[a] > 0) & (n[gap - a] > 0) & ((2 * a != gap) | (n[a] > 1)))
        return (int(a[ok[-1]]), int(gap - a[ok[-1]])) if len(ok) else None

    def triple(gap: int) -> tuple[int, int, int] | None:
        have = np.flatnonzero(n[: gap - 1] > 0) if gap > 2 else []
        for a in have[::-1]:
            if 3 * a < gap:
                break
            n[a] -= 1
            rest = pair(int(gap - a))
            n[a] += 1
            if rest:
                return (int(a), *rest)
        return None

    if n[capacity]:
        out.append((int(n[capacity]), (capacity,)))
        n[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while n[length]:
            gap = capacity - length
            n[length] -= 1
            found = (gap,) if n[gap] else pair(gap) or triple(gap)
            n[length] += 1
            if not found:
                break
            group = (length, *found)
            need = {x: group.count(x) for x in group}
            times = int(min(n[x] // k for x, k in need.items()))
            out.append((times, group))
            for x, k in need.items():
                n[x] -= times * k
    #: residuals: open sequences by what is left in them
    left: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    room = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        while (c := int(n[length])) > 0:
            fit = np.flatnonzero(room[length:])
            if len(fit):
                at = length + int(fit[0])
                times, held = left[at].pop()
                k = min(at // length, max(1, c // times)) if times <= c else 1
                use = times if times <= c else c
                if use < times:
                    left[at].append((times - use, held))
                room[at] = bool(left[at])
                new = at - k * length
                left[new].append((use, held + (length,) * k))
                room[new] = new > 0
                n[length] -= use * k
            else:
                k = min(capacity // length, c)
                use = c // k
                new = capacity - k * length
                left[new].append((use, (length,) * k))
                room[new] = new > 0
                n[length] -= use * k
    return out + [x for group in left.values() for x in group]


def places(packed: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), by length and rank: rank r of an interval goes to the sequence r - first rank further on."""
    rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for times, group in packed:
        offset = 0
        for length in group:
            rows.append((length, rank[length], base, offset))
            rank[length] += times
            offset += length
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, group: int = 50_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    The pieces are written once to the shared folder, so ranks are taken over
    fixed rows. ``group`` bounds the rows of a length that one task ranks.
    """
    spark = docs.sparkSession
    pieces = tokenize(docs, tokenizer, doc_id=doc_id, text=text, capacity=capacity, end=end).withColumn("__row", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")  # a row's number is fixed once written
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    salts = [1] * (capacity + 1)
    for length, c in counts.items():
        salts[length] = -(-c // group)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.element_at(F.array(*[F.lit(s) for s in salts]), F.col("length").cast("int") + 1)) if max(salts) > 1 else F.lit(0).cast("long"))
    w = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start", "ids_crc32", "__row")
    ranked = salted.withColumn("__rank", F.row_number().over(w) - 1)
    if max(salts) > 1:
        per = salted.groupBy("length", "__salt").count()
        base = per.select("length", "__salt", (F.sum("count").over(Window.partitionBy("length").orderBy("__salt")) - F.col("count")).alias("__base"))
        ranked = ranked.join(base, ["length", "__salt"])
    else:
        ranked = ranked.withColumn("__base", F.lit(0).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        keys = (p[:, 0] << 44) | p[:, 1]
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 44) | rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": p[at, 2] + rank.to_numpy(np.int64) - p[at, 1], "offset": p[at, 3]})

    return ranked.withColumn("__at", place(F.col("length"), F.col("__rank") + F.col("__base"))).select("doc_id", "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset")
