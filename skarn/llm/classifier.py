"""A linear softmax over a text's shape and its telling words, shared by two operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textkit import Words, alphanumeric, byte_values, runs

SHAPE = 9
LOW = np.uint64((1 << 44) - 1)


def _classes() -> np.ndarray:
    """Per byte: upper case, digit, symbol, bar, space as bits."""
    t = np.zeros(256, np.uint8)
    t[65:91] = 1
    t[48:58] = 2
    t[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-"]] = 4
    t[124] |= 8
    t[[32, 9, 10, 11, 12, 13]] = 16
    return t


def describe(texts: pa.Array, chosen: np.ndarray | None = None):
    """Per run of documents (first row, shape matrix, counts of the chosen words, distinct (document, word) pairs).

    Words that are not chosen count by the low 44 bits of their hashes."""
    classes, ok, values = _classes(), alphanumeric(), byte_values(True)
    for i, j, data, offsets in runs(texts):
        w, n = Words(data, offsets, ok, values), j - i
        size = np.maximum(1, np.diff(offsets))
        kind = classes[data]
        share = []
        for bit in (1, 2, 4, 8, 16):
            sums = np.r_[0, np.cumsum((kind & bit) != 0)]
            share.append((sums[offsets[1:]] - sums[offsets[:-1]]) / size)
        words = np.diff(w.first)
        doc = np.repeat(np.arange(n), words)
        total = np.maximum(1, words)
        again = np.zeros(len(w.hash), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        pairs = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (w.hash & LOW))
        d = (pairs >> np.uint64(44)).astype(np.int64)
        distinct = np.bincount(d, minlength=n)
        # Long texts repeat words by nature: what counts is the share beyond a power law of their length.
        variety = np.where(words > 0, np.log(np.maximum(1, distinct)) - 0.8 * np.log(total), 0)
        shape = np.stack([*share, np.bincount(doc, again, minlength=n) / total, variety, np.log1p(words), (size / total)], 1)
        counts = None
        if chosen is not None and len(chosen):
            low = w.hash & LOW
            at = np.minimum(np.searchsorted(chosen, low), len(chosen) - 1)
            hit = chosen[at] == low
            counts = np.bincount(doc[hit] * len(chosen) + at[hit], minlength=n * len(chosen)).reshape(n, len(chosen))
        yield i, shape, counts, (d, pairs & LOW)


class Classifier:
    """Softmax regression; ``words`` telling words are picked per label by how their presence differs."""

    def __init__(self, labels: list, words: int = 48, penalty: float = 1e-3, steps: int = 400):
        self.labels, self.words, self.penalty, self.steps = labels, words, penalty, steps

    def fit(self, texts: list[str], y: np.ndarray) -> "Classifier":
        array = pa.array(texts, pa.string())
        docs, hashes = [], []
        for i, _, _, (d, h) in describe(array):
            docs.append(d + i)
            hashes.append(h)
        doc, word = np.concatenate(docs), np.concatenate(hashes)
        known, index = np.unique(word, return_inverse=True)
        often = np.bincount(index, minlength=len(known)).astype(float)
        picked = []
        for c in range(len(self.labels)):
            inside, n1 = np.bincount(index, (y == c)[doc], minlength=len(known)), max(1, (y == c).sum())
            p, q = inside / n1, (often - inside) / max(1, len(y) - n1)
            mean = often / len(y)
            z = (p - q) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / max(1, len(y) - n1)) + 1e-9)
            z[often < 5] = 0
            best = np.argsort(-np.abs(z), kind="stable")[: self.words]
            picked += known[best[np.abs(z[best]) > 4]].tolist()
        self.chosen = np.unique(np.array(picked, np.uint64))
        x = self.matrix(array)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        k = len(self.labels)
        w, b, eye = np.zeros((x.shape[1], k)), np.zeros(k), np.eye(k)[y]
        m, v = np.zeros((x.shape[1] + 1, k)), np.zeros((x.shape[1] + 1, k))
        for t in range(1, self.steps + 1):
            g = (soft(x @ w + b) - eye) / len(y)
            grad = np.vstack([x.T @ g + self.penalty * w, g.sum(0)])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w, b
        return self

    def matrix(self, texts: pa.Array) -> np.ndarray:
        rows = [np.hstack([s, np.log1p(c)]) if c is not None else s for _, s, c, _ in describe(texts, self.chosen)]
        return np.vstack(rows) if rows else np.zeros((0, SHAPE + len(self.chosen)))

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Posteriors of the labels, a row per text."""
        x = np.clip((self.matrix(texts) - self.mean) / self.scale, -8, 8)
        return soft(x @ self.w + self.b)


def soft(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)
