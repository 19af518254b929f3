"""Operators against plain reimplementations, round trips and held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratakb.llm import bagminhash, components, decontam, embdedup, langid, linededup, packing, quality

SF = "/root/testdata/sf0.001"


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def groups(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def invent(r, n):
    return ["".join(r.choice(["ta", "ro", "mi", "ken", "sul", "ba", "é"]) for _ in range(r.randrange(1, 5))) for _ in range(n)]


def edited(r, words, share):
    return [x if r.random() > share else "zz" + str(r.randrange(99)) for x in words]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    expected = groups({x for e in real for x in e}, real)
    assert {x.node: x.component for x in components.components(df).collect()} == expected


def test_decontamination(spark):
    r = random.Random(3)
    items = [invent(r, n) for n in (3, 10, 14, 25, 40)]
    texts = []
    for i in range(60):
        body = invent(r, 80)
        for _ in range(r.randrange(3)):
            item = r.choice(items)
            at, start = r.randrange(80), r.randrange(max(1, len(item) - 10))
            body[at:at] = item[start : start + r.randrange(5, 20)]
        texts.append(re.sub("ta", "TA", "; ".join(body), count=5))
    word = re.compile(decontam.WORD)
    norm = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in word.findall(t)]
    wins = {(tuple(w[i : i + 10]), k) for k, it in enumerate(items) for w in [norm(" ".join(it))] for i in range(max(1, len(w) - 9))}
    got = decontam.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    for row in got:
        w = norm(texts[row.doc_id])
        hit, ids = set(), set()
        for win, k in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids.add(str(k))
        assert (row.n_words, row.n_hit, list(row.item_ids)) == (len(w), len(hit), sorted(ids))
        spans = {x for s in row.spans for x in norm(texts[row.doc_id][s.start : s.end])}
        assert spans == {w[i] for i in hit}


def test_embedding_links(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.15, 0.25, 0.3)] + [base[:5] * 3]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    u = embdedup.unit(x)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    for i, j in itertools.combinations(range(len(x)), 2):
        if (x[i] == x[j]).all():
            near[i, j] = near[j, i] = True
    root = groups(range(len(x)), zip(*np.nonzero(near), strict=True))
    for tile in (16, 8192):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df, tile=tile).collect()}
        assert got == {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(len(x))}


def test_quantisation_bounds():
    rng = np.random.default_rng(1)
    x = embdedup.unit(rng.normal(size=(300, 64)))
    q = embdedup.Quantised(x)
    approx = embdedup.product(q.rows(), q.rows()).astype(np.float64) * q.scale[:, None] * q.scale[None]
    bound = q.norm[:, None] * q.lost[None] + q.lost[:, None]
    assert (np.abs(approx - x @ x.T) <= bound + 1e-9).all() and bound.max() < 0.05
    blocks = list(embdedup.links(x, None, 0.5))
    expected = {(a, b) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.5, 1)), strict=True)}
    assert {(a, b) for i, j, _ in blocks for a, b in zip(i.tolist(), j.tolist(), strict=True)} == expected and sum(n for _, _, n in blocks) < 300 * 299 / 2


def test_links_of_dense_tiles_come_in_bounded_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(embdedup, "PAIRS", 4096)
    x = embdedup.unit(rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(1500, 16)))
    forest, count = embdedup.Forest(len(x)), 0
    for i, j, again in embdedup.links(x, None, 0.95):
        assert again <= 4096
        count += len(i)
        forest.add(i, j)
    assert count == 1500 * 1499 // 2 and (forest.root == 0).all()


def test_forest_equals_union_find():
    r = random.Random(3)
    for _ in range(100):
        n = r.randrange(1, 40)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(40))]
        forest, root = embdedup.Forest(n), groups(range(n), edges)
        for at in range(0, len(edges), 7):
            forest.add(*(np.array(z) for z in zip(*edges[at : at + 7], strict=True)))
        assert forest.root.tolist() == [root[i] for i in range(n)]


def weighted(words, k=5):
    n = max(1, len(words) - k + 1)
    return Counter(tuple(words[i : i + k]) for i in range(n)) if words else Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def test_near_duplicates(spark):
    r = random.Random(5)
    texts = [invent(r, r.randrange(1, 200)) for _ in range(60)]
    texts += [edited(r, r.choice(texts[:20]), r.choice([0.01, 0.03, 0.08])) for _ in range(100)] + [list(t) for t in texts[:10]] + [t + t for t in texts[:5]]
    big = invent(r, 300)
    texts += [edited(r, big, r.choice([0.005, 0.02, 0.05])) for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bags = [weighted(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(bags[i], bags[j]) >= 0.8]
    got = {x.doc_id: x.group_id for x in bagminhash.near_duplicates(df).collect()}
    assert got == groups(range(len(texts)), links)


def test_near_duplicates_of_a_whole_table(spark):
    """The driver's documents, all pairs that share a shingle by exact multisets."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    bags = {r.doc_id: weighted(bagminhash.normal(r.text).split()) for r in docs.collect()}
    having, both = {}, Counter()
    for i, bag in bags.items():
        for g, n in bag.items():
            for j, m in having.setdefault(g, []):
                both[j, i] += min(n, m)
            having[g].append((i, n))
    total = {i: sum(b.values()) for i, b in bags.items()}
    links = [(i, j) for (i, j), n in both.items() if n >= 0.8 * (total[i] + total[j] - n)]
    got = {x.doc_id: x.group_id for x in bagminhash.near_duplicates(docs).collect()}
    assert len(links) > 50 and got == groups(bags, links)


def test_signature_is_unbiased():
    r, errors = random.Random(6), []
    for _ in range(60):
        a = invent(r, 12) * r.randrange(1, 6) + invent(r, 40)
        b = edited(r, a, 0.05)
        x, y = (bagminhash.shingles(bagminhash.normal(" ".join(t))) for t in (a, b))
        assert bagminhash.similarity(x, y) == pytest.approx(jaccard(weighted(a), weighted(b)))
        errors.append((bagminhash.signature(*x) == bagminhash.signature(*y)).mean() - bagminhash.similarity(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_fuzzy_lines(spark):
    r = random.Random(7)
    lines = [" ".join(invent(r, r.randrange(3, 60))) for _ in range(80)]
    lines += [" ".join(edited(r, r.choice(lines[:30]).split(), r.choice([0.01, 0.03]))) for _ in range(80)] + lines[:10] + ["https://a.example/page/1", "https://a.example/page/2", "日本語の文章はここにあります一", "日本語の文章はここにあります二"]
    rows = [(i // 7, line) for i, line in enumerate(lines)]
    table = [(d, "\n".join(x for k, x in rows if k == d)) for d in sorted({d for d, _ in rows})]

    def shingle(t):
        t = " ".join(t.lower().split())
        return {t[i : i + linededup.WIDTH] for i in range(max(1, len(t) - linededup.WIDTH + 1))}

    order = [(d, n, x) for d, t in table for n, x in enumerate(t.split("\n"))]
    sets = [shingle(x) for _, _, x in order]
    links = [(i, j) for i, j in itertools.combinations(range(len(order)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = groups(range(len(order)), links)
    expected = {(d, n) for i, (d, n, _) in enumerate(order) if root[i] == i}
    got = linededup.line_classes(spark.createDataFrame(table, "doc_id long, text string"))
    kept = {(x.doc_id, x.line_no) for x in got.collect() if x.kept}
    assert expected == kept
    clean = {x.doc_id: x.text for x in linededup.dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert clean == {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) in kept) for d, t in table if any(k == d for k, _ in kept)}


def test_plan_uses_counts_exactly():
    r = random.Random(8)
    for _ in range(30):
        counts = Counter(r.choice([r.randrange(1, 101), r.randrange(1, 12), 100, 50]) for _ in range(r.randrange(1, 400)))
        packed = packing.plan(dict(counts), 100)
        used = Counter()
        for times, group in packed:
            assert times > 0 and sum(group) <= 100
            used.update({k: v * times for k, v in Counter(group).items()})
        assert used == counts
        total, n = sum(k * v for k, v in counts.items()), sum(t for t, _ in packed)
        fits = []  # best-fit decreasing, one by one
        for x in sorted(counts.elements(), reverse=True):
            at = min((k for k in range(len(fits)) if fits[k] >= x), key=lambda k: fits[k], default=None)
            if at is None:
                fits.append(100 - x)
            else:
                fits[at] -= x
        assert -(-total // 100) <= n <= len(fits) + 1
        place = packing.places(packed)
        seen = sorted((s + k, o, length) for (length, first, s, o), times in zip(place.tolist(), [1] * len(place), strict=True) for k in range(times))
        assert len(seen) == len(place)


def test_encoder_equals_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    e, plain = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(plain.encode("a <|endoftext|> b", add_special_tokens=False).ids) == 3
    texts = ["Hello, world! don't  stop\n\tNOW", "", None, "a <|endoftext|> b", "<|STARTOFTEXT|>x", "<|endoftext|>", "a < | b <| c", "ÀÉÎ straße ŒUVRE İstanbul", "ΟΔΟΣ odd \x1c sep", "日本語 text <|endoftext|> x", "a" * 5000, "é" * 50 + " e\u0301 x", "\u00a0nbsp\u00a0here 12,345.67"]
    for got, t in zip(e.encode(texts) + e.encode(texts[::-1]), texts + texts[::-1], strict=True):
        assert got == np.array(plain.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
    pieces = packing.pieces_of(np.arange(10_000, dtype="<u4").tobytes())
    assert [p[:3] for p in pieces] == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1809)] and pieces[0][3] == zlib.crc32(np.arange(4096, dtype="<u4").tobytes())


def test_held_out_accuracy(spark):
    from stratakb.llm.sampling import held_out

    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    model = langid.train(docs)
    test = docs.where(held_out())
    got = langid.identify(test, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert not any(r.ambiguous for r in got)
    from pyspark.sql import functions as F

    short = langid.identify(test.withColumn("text", F.substring_index("text", " ", 5)), model)
    assert short.where("ambiguous").count() <= 0.02 * short.count()
    foreign = spark.createDataFrame([("Привет мир как дела",), ("日本語の文章です",), ("zażółć gęślą jaźń",)], "text string")
    assert langid.identify(foreign, model).where("ambiguous").count() >= 2
    net = quality.train(docs, labels)
    scored = quality.classify(test.join(labels, "doc_id"), net).collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.85


def test_decoding_equals_its_definition():
    """Loss-weighted decoding, restated for one text at a time, and n-gram counts by plain loops."""
    rows = [("en", f"the quick brown fox {k} jumps over it") for k in range(8)] + [("de", f"der schnelle braune fuchs {k} springt") for k in range(8)] + [("fr", f"le renard brun {k} saute par dessus") for k in range(8)]
    model = langid.fit(rows)
    assert sorted({tuple(c) for c in model.code.T.tolist()}) and len({tuple(c) for c in model.code.tolist()}) == 3
    texts = ["the fox jumps", "der fuchs springt über", "le renard", "x", "日本"]
    x = np.stack([langid.features(t) for t in texts])
    which, score, gap = model.decode(x)
    for k, t in enumerate(texts):
        f = [float(sum(x[k, i] * model.w[i, bit] for i in np.flatnonzero(x[k])) + model.b[bit]) for bit in range(model.code.shape[1])]
        loss = [sum(model.bit_weight[bit] * np.log1p(np.exp(-f[bit] * word[bit])) for bit in range(len(f))) for word in model.code]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert which[k] == int(np.argmin(loss)) and score[k] == pytest.approx(p.max(), abs=1e-4) and gap[k] == pytest.approx(sorted(loss)[1] - min(loss), abs=1e-4), t
    text = "abracadabra é " * 3
    raw = f" {text.lower()} ".encode()
    distinct = [len({raw[i : i + n] for i in range(len(raw) - n + 1)}) for n in langid.ORDERS]
    size = 1 << langid.BITS
    got = [int(np.count_nonzero(langid.features(text)[k * size : (k + 1) * size])) for k in range(4)]
    assert all(d - 2 <= g <= d for g, d in zip(got, distinct, strict=True)) and np.linalg.norm(langid.features(text)) == pytest.approx(1, abs=1e-5)


def test_forward_pass_equals_plain_loops():
    """Embedding, convolution, rectifier, maxima, hidden layer and the two poolings over a whole document, one number at a time."""
    net = quality.Net(seed=2)
    p = {k: v.astype(float) for k, v in net.p.items()}
    for text in ("", "short", "héllo wörld " * 40, "long text " * 90):
        raw, hidden, at = text.encode(), [], 0
        while True:
            chunk = [raw[at + i] if at + i < len(raw) else quality.PAD for i in range(quality.CHUNK)]
            best = np.full(quality.FILTERS, -np.inf)
            for start in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                seen = np.concatenate([p["e"][b] for b in chunk[start : start + quality.WIDTH]])
                best = np.maximum(best, seen @ p["k"])
            hidden.append(np.tanh(np.maximum(best + p["kb"], 0) @ p["h"] + p["hb"]))
            at += quality.HOP
            if at + quality.CHUNK - quality.HOP >= len(raw):
                break
        z = np.concatenate([np.mean(hidden, axis=0), np.max(hidden, axis=0)]) @ p["o"] + p["ob"][0]
        assert net.score([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5), text[:9]


def test_mined_rules_equal_counts(spark):
    """Confidence and support of every mined rule, counted over the labelled URLs."""
    from pyspark.sql import functions as F

    from stratakb.llm import urlrules

    r = random.Random(9)
    urls = [f"http://{r.choice(['a', 'b', 'www.b', 'c.d'])}.{r.choice(['net', 'org'])}/{r.choice(['x', 'y', 'a-very-long-segment-of-more-than-forty-characters-in-all'])}/{r.randrange(50)}?k={r.randrange(3)}" for _ in range(300)]
    df = spark.createDataFrame([(u, "b." in u and "/x" in u or r.random() < 0.1) for u in urls], "url string, bad boolean")
    sets = [(set(x.t), x.bad) for x in df.select(urlrules.tokens(F.col("url")).alias("t"), "bad").collect()]
    assert any("more-than-forty" in t for s, _ in sets for t in s)
    rules = urlrules.mine(df, min_support=0.02, min_confidence=0.6).collect()
    assert rules
    for x in rules:
        has = [bad for s, bad in sets if set(x.antecedent) <= s]
        right = sum(bad == (x.label == "=bad") for bad in has)
        assert x.confidence == pytest.approx(right / len(has)) and x.support == pytest.approx(right / len(sets)) and x.confidence >= 0.6 and x.support >= 0.02
        assert sum(a.startswith(urlrules.LEVELS) for a in x.antecedent) <= 1
    kept = {(frozenset(x.antecedent), x.label) for x in rules}
    tokens = sorted(set().union(*(s for s, _ in sets)))
    for size in (1, 2):
        for some in itertools.combinations(tokens, size):
            if sum(a.startswith(urlrules.LEVELS) for a in some) > 1:
                continue
            has = [bad for s, bad in sets if set(some) <= s]
            for label in (True, False):
                right, base = sum(bad == label for bad in has), sum(bad == label for _, bad in sets) / len(sets)
                if has and right >= 0.021 * len(sets) and right / len(has) >= 0.6 and right / len(has) > base + 1e-9:
                    assert (frozenset(some), "=bad" if label else "=good") in kept


def test_samples_are_bounded_and_the_same_for_any_partitions(spark):
    from pyspark.sql import functions as F

    from stratakb.llm.sampling import training_sample

    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 50, "b").otherwise("c").alias("label"))
    got = [training_sample(df.repartition(n), df.repartition(n), per_label=40, max_chars=10) for n in (1, 7)]
    per = Counter(label for label, _ in got[0])
    assert got[0] == got[1] and per["a"] == per["c"] == 40 and 0 < per["b"] <= 40


def test_gradient():
    net = quality.Net(seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    groups_, y, w = [quality.chunks("some text " * 40), quality.chunks("### $$ other")], np.array([1.0, 0.0]), np.ones(2)

    def loss():
        z = []
        for g in groups_:
            h = net.hidden(net.pooled(g)[0])
            z.append(np.hstack([h.mean(axis=0), h.max(axis=0)]) @ net.p["o"] + net.p["ob"][0])
        return np.mean(np.log1p(np.exp(-np.where(y == 1, 1, -1) * np.array(z))))

    g = net.gradient(groups_, y, w)
    for k, at in (("o", 3), ("h", (2, 1)), ("k", (5, 2)), ("e", (ord("t"), 1)), ("hb", 0)):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)
