"""Fuzzy lines against brute force over every character shingle."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from stratakb.llm import linededup, streams
from test_brute_force import groups, invent


def shingle(t):
    t = " ".join(t.lower().split())
    return {t[i : i + linededup.WIDTH] for i in range(max(1, len(t) - linededup.WIDTH + 1))}


def kept_and_expected(spark, lines):
    table = [(d, line) for d, line in enumerate(lines)]
    sets = [shingle(x) for x in lines]
    links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = groups(range(len(lines)), links)
    got = linededup.line_classes(spark.createDataFrame(table, "doc_id long, text string"))
    return {x.doc_id for x in got.collect() if x.kept}, {i for i in root if root[i] == i}


def test_one_changed_character(spark):
    r, lines = random.Random(11), []
    for n in [90] * 60 + [250, 255, 256, 257, 260, 261, 262, 600] * 3:
        line = " ".join(invent(r, 200))[:n].rstrip()
        at = r.randrange(len(line))
        lines += [line, line[:at] + "x" + line[at + 1 :]]
    lines += ["ab", "AB ", "abcd", "abce", "abcde", "日本語の文章はここにあります一", "日本語の文章はここにあります二", "e\U0001f600" * 300, "e\U0001f600" * 299 + "ee"]
    kept, expected = kept_and_expected(spark, lines)
    assert expected == kept


def brute_links(lines, threshold=0.8):
    """Pairs of lines by their whole sets, counted as products of incidence matrices over blocks of shingles."""
    sets = [shingle(x) for x in lines]
    n = np.array([len(s) for s in sets], dtype=np.float32)
    place = {}
    of = [np.fromiter((place.setdefault(g, len(place)) for g in s), dtype=np.int64) for s in sets]
    row, col = np.repeat(np.arange(len(of)), [len(x) for x in of]), np.concatenate(of)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(of), len(of)), dtype=np.float32)
    for at in range(0, len(place), 4000):
        a, b = np.searchsorted(col, [at, at + 4000])
        m = np.zeros((len(of), 4000), dtype=np.float32)
        m[row[a:b], col[a:b] - at] = 1
        both += m @ m.T
    i, j = np.nonzero(np.triu(both >= threshold * (n[:, None] + n[None] - both), 1))
    return list(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_equals_brute_force(spark, sf):
    """Recall and precision of the components' links on the driver's documents, whole sets, every line."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    order = sorted({(r.doc_id, k, " ".join(x.lower().split())) for r in docs.collect() if r.text for k, x in enumerate(r.text.split("\n")) if x.strip(" \t\r\f\v")})
    first = {}
    for d, k, x in order:
        first.setdefault(x, f"{d}:{k}")
    lines = list(first)
    links = brute_links(lines)
    root = groups(range(len(lines)), links)
    name, at = list(first.values()), {x: i for i, x in enumerate(lines)}
    expected = {f"{d}:{k}": name[root[at[x]]] for d, k, x in order} if sf == "sf0.001" else None
    got = {f"{r.doc_id}:{r.line_no}": (r.class_id, r.component_id) for r in linededup.line_classes(docs).collect()}
    assert len(got) == len(order) and all(got[f"{d}:{k}"][0] == first[x] for d, k, x in order)
    of = [got[n][1] for n in name]
    assert sum(of[i] == of[j] for i, j in links) >= 0.999 * len(links) and links
    inside = {}
    for i, o in enumerate(of):
        inside.setdefault(o, set()).add(root[i])
    assert all(len(x) == 1 for x in inside.values())  # no false link
    if expected:
        assert {k: v[1] for k, v in got.items()} == expected


def test_minima_are_fair():
    """The share of common minima and of common sketch bits follows the similarity, and all threads of a batch cut at any place agree."""
    r, off = random.Random(3), []
    for _ in range(200):
        a = "".join(r.choice("abcdefgh ") for _ in range(r.choice([30, 80, 300, 3000])))
        at = r.randrange(len(a))
        b = a[:at] + "".join(r.choice("abcdefgh ") for _ in range(len(a) // 12)) + a[at + len(a) // 12 :]
        x, y = shingle(a), shingle(b)
        least = linededup.minima([a, b])
        off.append((least[0] == least[1]).mean() - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.09
    texts = ["", "a", "é" * 7, "日本語の文章", "x" * 70_000, "abcde"] * 3
    assert (linededup.minima(texts) == np.concatenate([linededup.minima([t]) for t in texts])).all()


def test_arrow_groups():
    r = random.Random(4)
    for _ in range(50):
        keys = sorted(r.randrange(6) for _ in range(r.randrange(0, 30)))
        table = pa.table({"k": pa.array(keys, pa.int64()), "v": pa.array(range(len(keys)), pa.int64())})
        size, got = r.randrange(1, 8), []
        for batch, cuts in streams.arrow_groups(iter(table.to_batches(max_chunksize=size)), ["k"]):
            got += [batch.column("v").to_pylist()[a:b] for a, b in itertools.pairwise(cuts)]
        assert got == [list(g) for _, g in itertools.groupby(range(len(keys)), key=keys.__getitem__)]
