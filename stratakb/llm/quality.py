"""Quality classifier: a byte-level convolutional network in numpy.

The text's UTF-8 bytes are cut into overlapping chunks that cover the whole
document. Every byte is embedded; learned filters of ``WIDTH`` bytes run over
each chunk with stride ``STRIDE``, a rectifier follows, and the maximum over a
chunk is taken for each filter. A small layer turns the chunk's maxima into
hidden values; their mean and maximum over all chunks give one probability.

Defined results: a null or empty text is scored as a text of no bytes (one
chunk of padding); repeated rows and ties are judged each on its own; without
both labels in the training rows the score is their mean (0.5 without rows);
extra columns are kept unless they clash with an output column.

Only the training sample is bounded (``per_label`` rows of each label, texts up
to ``max_chars``). Prediction has no shuffle and handles long texts in groups
of chunks, so memory does not grow with a document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import training_sample

CHUNK, HOP, WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 256, 192, 8, 2, 6, 24, 12
GROUP = 256  # chunks worked on at once
PAD = 256  # the embedding of no byte


def chunks(text: str | None) -> np.ndarray:
    """Overlapping chunks of the whole text, as rows of byte numbers; the last is padded."""
    b = np.frombuffer((text or "").encode(), dtype=np.uint8)
    n = max(1, -(-(len(b) - CHUNK) // HOP) + 1)
    full = np.full((n - 1) * HOP + CHUNK, PAD, dtype=np.int16)
    full[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK)[::HOP]


class Net:
    """The weights and both directions of the network."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (257, DIM)), "k": r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)), "kb": np.zeros(FILTERS),
            "h": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)), "hb": np.zeros(HIDDEN), "o": r.normal(0, 0.3, 2 * HIDDEN), "ob": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def pooled(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For chunks: the maximum of every filter, and where it is."""
        e = self.p["e"][c]
        n, length, _ = e.shape
        steps = (length - WIDTH) // STRIDE + 1
        s = e.strides
        w = np.lib.stride_tricks.as_strided(e, (n, steps, WIDTH * DIM), (s[0], STRIDE * s[1], s[2]), writeable=False)
        a = w.reshape(n * steps, -1) @ self.p["k"]
        a = a.reshape(n, steps, FILTERS)
        return np.maximum(a.max(axis=1) + self.p["kb"], 0), a.argmax(axis=1)

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled @ self.p["h"] + self.p["hb"])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        total, most, count = np.zeros((len(texts), HIDDEN)), np.full((len(texts), HIDDEN), -2.0), np.zeros(len(texts))
        held, owner = [], []

        def flush():
            if held:
                h, at = self.hidden(self.pooled(np.concatenate(held))[0]), np.concatenate(owner)
                np.add.at(total, at, h)
                np.maximum.at(most, at, h)
                np.add.at(count, at, 1)
                held.clear()
                owner.clear()

        n = 0
        for i, t in enumerate(texts):
            c = chunks(t)
            for k in range(0, len(c), GROUP):
                part = c[k : k + GROUP]
                held.append(part)
                owner.append(np.full(len(part), i))
                n += len(part)
                if n >= GROUP:
                    flush()
                    n = 0
        flush()
        z = np.hstack([total / count[:, None], most]) @ self.p["o"] + self.p["ob"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows: list[tuple[int, str]], *, epochs: int = 8, batch: int = 32, rate: float = 4e-3, per_text: int = 12, seed: int = 9) -> Net:
        """Adam on the logistic loss, classes in balance; of a long text per_text random chunks in each epoch."""
        y = np.array([int(v) for v, _ in rows], dtype=np.float32)
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        data, rng, step = [chunks(t) for _, t in rows], np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), batch):
                pick = order[i : i + batch]
                got = [d if len(d := data[j]) <= per_text else d[rng.choice(len(d), per_text, replace=False)] for j in pick]
                g = self.gradient(got, y[pick], weight[pick])
                step += 1
                now = rate * (0.3 if epoch >= epochs - 2 else 1)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (now * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def gradient(self, groups: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over documents, each a group of chunks."""
        p, n = self.p, np.array([len(g) for g in groups])
        ends, c = np.cumsum(n), np.concatenate(groups)
        starts = ends - n
        pooled, where = self.pooled(c)
        h = self.hidden(pooled)
        mean = np.add.reduceat(h, starts) / n[:, None]
        top = np.stack([s + h[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
        doc = np.hstack([mean, np.take_along_axis(h, top, axis=0)])
        z = doc @ p["o"] + p["ob"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)).astype(np.float32)
        g = {"o": doc.T @ dz, "ob": dz.sum(keepdims=True)}
        ddoc = dz[:, None] * p["o"]
        dh = np.repeat(ddoc[:, :HIDDEN] / n[:, None], n, axis=0)
        np.add.at(dh, (top, np.arange(HIDDEN)), ddoc[:, HIDDEN:])
        dh *= 1 - h * h
        g |= {"h": pooled.T @ dh, "hb": dh.sum(axis=0)}
        da = (dh @ p["h"].T) * (pooled > 0)
        g["kb"] = da.sum(axis=0)
        at = where[:, :, None] * STRIDE + np.arange(WIDTH)  # chunk, filter, place: only the maxima pass the gradient on
        seen = c[np.arange(len(c))[:, None, None], at]
        patch = p["e"][seen].reshape(len(c), FILTERS, WIDTH * DIM)
        g["k"] = np.einsum("cfw,cf->wf", patch, da)
        de = da[:, :, None] * p["k"].T[None]
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], seen.ravel(), de.reshape(-1, DIM))
        return g


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_label: int = 1200, max_chars: int = 20_000) -> Net:
    """Learn from at most per_label labelled documents of each label that are not held out."""
    return Net().fit([(v, t) for v, t in training_sample(docs, labels, label=label, per_label=per_label, max_chars=max_chars) if v in (0, 1)])


def classify(docs: DataFrame, net: Net, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([net.score([t if isinstance(t, str) else None for t in texts.iloc[i : i + 64]]) for i in range(0, len(texts), 64)] or [np.zeros(0)]))

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")], score(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
