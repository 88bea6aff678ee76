"""Language identification with averaged hashed subword embeddings and a linear softmax.

A document is the mean of the embeddings of its words and of the words' 2- to 4-grams of bytes
(with marks for a word's ends), hashed into ``BUCKETS``.  Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample.  A temperature, fitted on a held-out
fifth of the sample, calibrates the probabilities; a document is accepted if its probability
reaches what all but ``reject`` of the rightly told held-out documents reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_texts
from .textkit import Words, alphanumeric, byte_values, mix, runs

BUCKETS = 1 << 14
DIM = 16
U = np.uint64


def features(w: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place in ``rows``) of every feature of the words at ``rows``."""
    start, size = w.start[rows], w.end[rows] - w.start[rows]
    total = size + 2
    begin = np.cumsum(total) - total
    owner = np.repeat(np.arange(len(rows)), total)
    inner = np.arange(int(total.sum())) - begin[owner]
    values = byte_values(lower=True)
    v = np.empty(len(owner), np.uint64)
    middle = (inner > 0) & (inner <= size[owner])
    v[middle] = values[w.data[start[owner[middle]] + inner[middle] - 1]]
    v[inner == 0], v[inner == size[owner] + 1] = U(0x51), U(0x52)
    buckets, places = [(w.hash[rows] % U(BUCKETS)).astype(np.int64)], [np.arange(len(rows))]
    with np.errstate(over="ignore"):
        h = v.copy()
        for n in range(2, 5):
            h = h[:-1] * U(0x9E3779B97F4A7C15) + v[n - 1 :]
            ok = inner[: len(h)] + n <= total[owner[: len(h)]]
            buckets.append((mix(h[ok] + U(n)) % U(BUCKETS)).astype(np.int64))
            places.append(owner[: len(h)][ok])
    return np.concatenate(buckets), np.concatenate(places)


def sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and their shares."""
    out = []
    for _, _, data, offsets in runs(pa.array(texts, pa.string())):
        w = Words(data, offsets, alphanumeric(), byte_values(True))
        for d in range(len(offsets) - 1):
            bucket, _ = features(w, np.arange(w.first[d], w.first[d + 1]))
            ids, n = np.unique(bucket, return_counts=True)
            out.append((ids, n / max(1, n.sum())))
    return out


class Model:
    def __init__(self, langs: list[str]):
        r = np.random.default_rng(5)
        self.langs = langs
        self.e = r.normal(0, 0.1, (BUCKETS, DIM))
        self.w = r.normal(0, 0.3, (DIM, len(langs)))
        self.b = np.zeros(len(langs))
        self.temperature, self.accept = 1.0, 0.0

    def fit(self, rows: list, y: np.ndarray, epochs: int = 5, rate: float = 0.5) -> None:
        r, eye = np.random.default_rng(6), np.eye(len(self.langs))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in r.permutation(len(rows)):
                ids, share = rows[i]
                h = share @ self.e[ids]
                z = h @ self.w + self.b
                p = np.exp(z - z.max())
                g = p / p.sum() - eye[y[i]]
                ge = self.w @ g
                self.w -= step * np.outer(h, g)
                self.b -= step * g
                self.e[ids] -= step * 20 * share[:, None] * ge

    def logits(self, rows: list) -> np.ndarray:
        return np.array([(share @ self.e[ids]) @ self.w + self.b for ids, share in rows]).reshape(len(rows), len(self.langs))

    def calibrate(self, rows: list, y: np.ndarray, reject: float) -> None:
        z = self.logits(rows)
        best = None
        for t in np.exp(np.linspace(-2.5, 1.5, 41)):
            p = softmax(z / t)
            loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()
            if best is None or loss < best[0]:
                best = (loss, t)
        self.temperature = float(best[1])
        p = softmax(z / self.temperature)
        right = np.sort(p.max(1)[p.argmax(1) == y])
        self.accept = float(right[int(reject * len(right))]) if len(right) else 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, sample: int = 3000, reject: float = 0.01) -> Model | None:
    """Fits a model on at most ``sample`` rows of (doc_id, text, lang), as ``sample_texts`` bounds them;
    None where nothing has a language and a letter.  Other columns are ignored."""
    rows = sample_texts(docs.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("doc_id", "text", "lang"), sample)
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    model, y = Model(langs), np.array([langs.index(r["lang"]) for r in rows])
    x = sparse([r["text"] for r in rows])
    held = np.arange(len(rows)) % 5 == 4
    model.fit([x[i] for i in np.flatnonzero(~held)], y[~held])
    if held.any():
        model.calibrate([x[i] for i in np.flatnonzero(held)], y[held], reject)
    return model


def _predict(model: Model | None):
    is_letter = np.zeros(256, bool)
    is_letter[[*range(65, 91), *range(97, 123)]] = True
    if model is not None:
        scores = model.e @ model.w / model.temperature  # an embedding matters only through this product
        bias = model.b / model.temperature

    def run(batches):
        for batch in batches:
            langs, probability, accepted = [], [], []
            texts = batch.column("text")
            for i, j, data, offsets in runs(texts):
                letters = np.add.reduceat(np.r_[is_letter[data], False], offsets[:-1]) if len(data) else np.zeros(j - i)
                some = (letters > 0) & (offsets[1:] > offsets[:-1])
                for d in np.flatnonzero(~some):
                    some[d] = any(c.isalpha() for c in str(memoryview(data)[offsets[d] : offsets[d + 1]], "utf-8"))
                if model is None:
                    langs += ["und"] * (j - i)
                    probability += [0.0] * (j - i)
                    accepted += [False] * (j - i)
                    continue
                w = Words(data, offsets, alphanumeric(), byte_values(True))
                _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
                bucket, place = features(w, one)
                n = np.bincount(place, minlength=len(one))
                each = np.stack([np.bincount(place, scores[bucket, c], minlength=len(one)) for c in range(len(bias))], 1)
                doc = np.repeat(np.arange(j - i), np.diff(w.first))
                total = np.stack([np.bincount(doc, each[which, c], minlength=j - i) for c in range(len(bias))], 1)
                p = softmax(total / np.maximum(1, np.bincount(doc, n[which], minlength=j - i))[:, None] + bias)
                best = p.argmax(1)
                for d in range(j - i):
                    langs.append(model.langs[best[d]] if some[d] else "und")
                    probability.append(float(p[d, best[d]]) if some[d] else 0.0)
                    accepted.append(bool(some[d] and p[d, best[d]] >= model.accept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(probability, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return run


def language_id(docs: DataFrame, model: Model | None) -> DataFrame:
    """A row per row of ``docs``: doc_id, lang_pred, score, accepted.

    Only text is read.  Null texts and texts without a letter are ``und`` with score 0; without a
    model (nothing to learn from) all are.  A null doc_id stays null; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, accepted boolean")
