"""Benchmark decontamination by pigeonhole edit matching.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  An item of m words has an
error budget of e = floor(``budget`` * m) word edits and is split into e + 1 pieces; wherever a
document holds the item within the budget, one piece stands there unchanged.  Exact piece hits
are found by hash and then word by word; each gives a window of the document in which Myers'
bit-parallel algorithm (over words) finds the least edit distance.  Items are queries against all
documents: they are bounded, and travel with the tasks in blocks of ``BLOCK_BYTES``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, plainly
from .textkit import Words, alphanumeric, byte_values, runs

BLOCK_BYTES = 16 << 20
GRAM = 4


def item_words(text: str) -> list[int]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), alphanumeric(), byte_values(True)).hash.tolist()


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least distance of the pattern to any stretch of the text, the first end where it is reached)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (full & ~(xh | vp))
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = hn | (full & ~(xv | hp)), hp & xv
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """A block of items: their words, budgets and pieces."""

    def __init__(self, items: list[tuple[int, list[int]]], budget: float):
        self.items = [(i, w, int(budget * len(w))) for i, w in items if w]
        pieces: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for at, (_, w, e) in enumerate(self.items):
            cuts = [len(w) * k // (e + 1) for k in range(e + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                g = min(GRAM, b - a)
                key = _gram(w[a : a + g])
                pieces.setdefault(g, {}).setdefault(key, []).append((at, a, b))
        self.pieces = {g: (np.array(sorted(p), np.uint64), p) for g, p in pieces.items()}

    def hits(self, w: Words) -> dict[tuple[int, int], list[int]]:
        """(document, item) → starts that the items would have."""
        out: dict[tuple[int, int], list[int]] = {}
        for g, (keys, pieces) in self.pieces.items():
            grams = w.grams(g)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            where = np.flatnonzero(keys[at] == grams)
            doc = np.searchsorted(w.first, where, side="right") - 1
            for p, d in zip(where.tolist(), doc.tolist(), strict=True):
                for item, a, b in pieces[int(grams[p])]:
                    if p + b - a <= w.first[d + 1] and w.hash[p : p + b - a].tolist() == self.items[item][1][a:b]:
                        out.setdefault((d, item), []).append(p - a)
        return out

    def find(self, w: Words) -> list[tuple[int, int, int, int, int]]:
        """(document, item_id, distance, first word, end word) of the items' best places."""
        out = []
        for (d, item), starts in self.hits(w).items():
            item_id, words, e = self.items[item]
            low, high = int(w.first[d]), int(w.first[d + 1])
            best = None
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(low, s - e), min(high, s + len(words) + e)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            for a, b in spans:
                text = w.hash[a:b].tolist()
                distance, end = myers(words, text)
                if distance <= e and (best is None or distance < best[0]):
                    _, back = myers(words[::-1], text[:end][::-1])
                    best = (distance, a + end - back - low, a + end - low)
            if best:
                out.append((d, item_id, *best))
        return out


def _gram(words: list[int]) -> int:
    data = Words(np.zeros(0, np.uint8), np.zeros(2, np.int64), alphanumeric(), byte_values(True))
    data.hash = np.array(words, np.uint64)
    return int(data.grams(len(words))[0])


def item_blocks(benchmark: DataFrame, budget: float) -> list[Items]:
    """The items in blocks; items come to the driver as the stated query set."""
    blocks, held, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        held.append((row["item_id"], item_words(row["text"])))
        size += len(row["text"])
        if size >= BLOCK_BYTES:
            blocks.append(Items(held, budget))
            held, size = [], 0
    return [*blocks, Items(held, budget)]


def _search(items: Items):
    def run(batches):
        for batch in batches:
            ids, found = batch.column("doc_id"), []
            for i, _, data, offsets in runs(batch.column("text")):
                w = Words(data, offsets, alphanumeric(), byte_values(True))
                found += [(i + d, *rest) for d, *rest in items.find(w)]
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(rows), *(pa.array([f[k] for f in found], pa.int64()) for k in range(1, 5))], names=["doc_id", "item_id", "distance", "first_word", "end_word"])

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, budget: float = 0.15) -> DataFrame:
    """Rows (doc_id, item_id, distance, first_word, end_word): the best place of each item in each
    row of ``docs`` that holds it within its budget.

    Null and empty texts match nothing, nor do items without words; repeated items give one row
    each.  A null doc_id stays null.  Other columns are ignored.  An empty table on either side
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in item_blocks(benchmark, budget):
        found = docs.mapInArrow(_search(items), "doc_id long, item_id long, distance long, first_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def _without(items: Items):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, _, data, offsets in runs(batch.column("text")):
                for d, *_ in items.find(Words(data, offsets, alphanumeric(), byte_values(True))):
                    keep[i + d] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, budget: float = 0.15) -> DataFrame:
    """``docs`` with all its columns, whatever their names, without the rows that hold an item within its budget.

    Nulls, empty texts and empty tables are as in ``benchmark_matches``.  Each ``BLOCK_BYTES`` of
    items is a further pass over the documents."""
    plain = plainly(docs)
    for items in item_blocks(benchmark, budget):
        plain = plain.mapInArrow(lean(_without(items)), plain.schema)
    return plain.toDF(*docs.columns)
