"""Substring dedup with suffix automata of reference shards.

A window is ``window`` consecutive words of one document.  Each word covered by a window whose
word sequence also starts in a document with a smaller doc_id is removed.

An automaton of the whole corpus fits nowhere, and to stream every document through every
shard's automaton would cost the square of the corpus.  So the reference text is first cut down
to what can repeat, and each shard meets only the text that can match in it:

1. *Anchors.*  Of every window, the least of its ``ANCHOR``-word grams under a fixed order
   (grams of longer words first, then by hash) is its anchor.  Equal windows have equal
   anchors, so a window can only repeat where its anchor occurs in two documents.
2. *Stretches.*  The windows of such an anchor form a stretch of words; stretches go to the
   shard of their anchor.  Copies of a stretch within a block of documents travel once, with
   the least doc_id that holds them.  An anchor of many blocks is extended by the words that
   follow it in a window, or else by those before it, so that its stretches spread over shards.
3. *Automata.*  A shard's distinct stretches build one suffix automaton over words, whose
   states carry the least doc_id of their occurrences.  Stretches stream through it; where the
   match is as long as a window, the state of the window's words tells where it first occurs.
4. *Removal.*  First doc_ids return to the blocks, whose documents drop the covered spans.

Each shard's automaton lives in the task that streams its text, in place of a broadcast of
all automata to all tasks, which would grow with the corpus.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FLUSH_BYTES, Router, parts, text_bytes, unpack, width
from .textkit import Words, byte_values, mix, not_space, runs

ANCHOR = 3
LONG_WORD = 4
SHARD_WORDS = 120_000
U = np.uint64
ENTRY = ["u8", "i4"]
MANY = 1 << 30
HOT_BLOCKS = 256


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end window, anchor hash, anchor's word) of each stretch of windows with one anchor occurrence.

    Windows are named by their first word; stretches do not span documents."""
    k = min(ANCHOR, window)
    n, span = len(w.hash), window - k + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = w.grams(k)
    short = ((w.end - w.start) < LONG_WORD).astype(np.uint64)
    few = short.copy()
    for j in range(1, k):
        few[: n - j] += short[j:]
    order = (few << U(60)) | (grams >> U(4))
    # Sliding minimum: position of the least gram of each window, the leftmost of equals.
    best = np.arange(n)
    have = 1
    while have < span:
        step = min(have, span - have)
        other = np.minimum(np.arange(n) + step, n - 1)
        right = best[other]
        best = np.where(order[right] < order[best], right, best)
        have += step
    lengths = np.diff(w.first)
    valid = np.zeros(n, bool)
    counts = np.maximum(lengths - window + 1, 0)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, w.first[:-1][counts > 0], 1)
    np.add.at(marks, (w.first[:-1] + counts)[counts > 0], -1)
    valid = np.cumsum(marks[:-1]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.r_[True, (best[at[1:]] != best[at[:-1]]) | (at[1:] != at[:-1] + 1)]
    begin = np.flatnonzero(cut)
    stop = np.r_[begin[1:], len(at)]
    return at[begin], at[stop - 1] + 1, grams[best[at[begin]]], best[at[begin]]


def extended(w: Words, window: int, first: np.ndarray, end: np.ndarray, anchor: np.ndarray, place: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end window, key) with the stretches of ``hot`` anchors cut in two.

    Windows that hold the words after the anchor have the anchor with those as their key, the
    others the anchor with the words before it; equal windows still have equal keys."""
    k = min(ANCHOR, window)
    more = (window - k) // 2
    rows = np.flatnonzero(np.isin(anchor, hot)) if len(hot) and more else np.zeros(0, np.int64)
    if not len(rows):
        return first, end, anchor
    grams = w.grams(k + more)
    middle = np.clip(place[rows] - (window - k - more), first[rows], end[rows])
    before, after = grams[np.maximum(place[rows] - more, 0)] ^ U(1), grams[place[rows]]
    rest = np.ones(len(first), bool)
    rest[rows] = False
    first = np.concatenate([first[rest], first[rows], middle])
    key = np.concatenate([anchor[rest], before, after])
    end = np.concatenate([end[rest], middle, end[rows]])
    order = np.argsort(first, kind="stable")
    order = order[first[order] < end[order]]
    return first[order], end[order], key[order]


def _enter(window: int, buckets: int):
    def run(batches):
        """Rows come sorted by block; entries are (anchor, block), with a mark if two of the block's documents hold it."""
        is_word, values = not_space(), byte_values(lower=False)
        router, now, seen = Router(buckets, ENTRY), None, []

        def close():
            if not seen:
                return
            anchor, doc = np.concatenate([s[0] for s in seen]), np.concatenate([s[1] for s in seen])
            seen.clear()
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            new = np.r_[True, anchor[1:] != anchor[:-1]]
            cuts = np.flatnonzero(new)
            last = np.r_[cuts[1:], len(anchor)] - 1
            many = doc[cuts] != doc[last]
            one = anchor[cuts]
            yield from router.add((one % U(buckets)).astype(np.int32), one, np.full(len(one), now, np.int32) | np.where(many, MANY, 0).astype(np.int32))

        for batch in batches:
            block, ids, texts = batch.column("block").to_numpy(), batch.column("doc_id").to_numpy(), batch.column("text")
            bounds = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    yield from close()
                    now = int(block[a])
                for i, _, data, offsets in runs(texts.slice(a, b - a)):
                    w = Words(data, offsets, is_word, values)
                    first, _, anchor, _ = anchors(w, window)
                    row = np.searchsorted(w.first, first, side="right") - 1 + i + a
                    seen.append((anchor, ids[row]))
        yield from close()
        yield from router.flush()

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Anchors that occur in two documents, back to each block that holds them: kind 0 those of many blocks, 1 all."""
    anchor, block = unpack(group.column("packed"), ENTRY)
    order = np.argsort(anchor, kind="stable")
    anchor, block = anchor[order], block[order]
    cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(anchor)]
    many = np.add.reduceat((block & MANY) != 0, cuts, dtype=np.int64) > 0 if len(cuts) else np.zeros(0, bool)
    ok = np.repeat((ends - cuts > 1) | many, ends - cuts)
    hot = np.repeat(ends - cuts > HOT_BLOCKS, ends - cuts)
    blocks, kinds, packed = [], [], []
    for kind, chosen in ((0, hot), (1, ok)):
        held, where = anchor[chosen], block[chosen] & (MANY - 1)
        order = np.argsort(where, kind="stable")
        held, where = held[order], where[order]
        if not len(where):
            continue
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        blocks += where[cuts].tolist()
        kinds += [kind] * len(cuts)
        packed += [held[a:b].tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(where)], strict=True)]
    return pa.table({"block": pa.array(blocks, pa.int32()), "kind": pa.array(kinds, pa.int32()), "packed": pa.array(packed, pa.binary())})


def _stretches(docs: pa.Table, back: pa.Table, window: int):
    """The block's distinct stretches with shared anchors, in a fixed order, and where they occur.

    Returns per stretch (words, key, least doc_id) and per row of ``docs`` (in the order of
    doc_id and text, so that rows that share a doc_id are numbered alike in every task) its word
    hashes' run and the occurrences (first window, stretch)."""
    sent = lambda kind: [np.frombuffer(b.as_buffer(), np.uint64) for b, k in zip(back.column("packed"), back.column("kind").to_pylist(), strict=True) if k == kind]
    hot, known = (np.unique(np.concatenate([np.zeros(0, np.uint64), *sent(kind)])) for kind in (0, 1))
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    is_word, values = not_space(), byte_values(lower=False)
    ids = docs.column("doc_id").to_numpy()
    found: dict[tuple[int, bytes], int] = {}
    stretches: list[tuple] = []
    rows = []
    texts = docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string())
    for i, j, data, offsets in runs(texts):
        w = Words(data, offsets, is_word, values)
        first, end, anchor, place = anchors(w, window)
        if len(known):
            hit = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor
        else:
            hit = np.zeros(len(anchor), bool)
        first, end, anchor = extended(w, window, first[hit], end[hit], anchor[hit], place[hit], hot)
        row = np.searchsorted(w.first, first, side="right") - 1
        raw = data.tobytes()
        lo, hi = w.start[first], w.end[end + window - 2] if len(end) else end
        places: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        for a, r, h, x, y in zip(first.tolist(), row.tolist(), anchor.tolist(), lo.tolist(), hi.tolist(), strict=True):
            words = b" ".join(raw[x:y].split())
            at = found.get((h, words))
            if at is None:
                at = found[h, words] = len(stretches)
                stretches.append((words, h, int(ids[i + r])))
            places[r].append((a, at))
        rows.append((i, j, w, raw, offsets.tolist(), places))
    return ids, stretches, rows


def _send(window: int, shards: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py() if docs.num_rows else -1
        _, stretches, _ = _stretches(docs, back, window)
        n = len(stretches)
        return pa.table({
            "shard": pa.array([s[1] % shards for s in stretches], pa.int32()),
            "part": pa.array([s[1] // shards % 4096 for s in stretches], pa.int32()),
            "block": pa.array([block] * n, pa.int32()),
            "stretch": pa.array(range(n), pa.int32()),
            "doc_id": pa.array([s[2] for s in stretches], pa.int64()),
            "words": pa.array([s[0] for s in stretches], pa.binary()),
        })

    return run


class SuffixAutomaton:
    """Suffix automaton over words; each state knows the least doc_id among its occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.first = [-1], [0], [1 << 62]

    def add(self, words: list[bytes], doc: int) -> None:
        nexts, links, lens, firsts = self.next, self.link, self.len, self.first
        last = 0
        for c in words:
            at = nexts[last].get(c)
            if at is not None:
                if lens[at] == lens[last] + 1:
                    last = at
                else:
                    last = self._split(last, at, c)
            else:
                new = len(nexts)
                nexts.append({})
                links.append(0)
                lens.append(lens[last] + 1)
                firsts.append(1 << 62)
                p = last
                while p != -1 and c not in nexts[p]:
                    nexts[p][c] = new
                    p = links[p]
                if p != -1:
                    q = nexts[p][c]
                    links[new] = q if lens[p] + 1 == lens[q] else self._split(p, q, c)
                last = new
            if doc < firsts[last]:
                firsts[last] = doc

    def _split(self, p: int, q: int, c: bytes) -> int:
        nexts, links, lens = self.next, self.link, self.len
        clone = len(nexts)
        nexts.append(nexts[q].copy())
        lens.append(lens[p] + 1)
        links.append(links[q])
        self.first.append(1 << 62)
        while p != -1 and nexts[p].get(c) == q:
            nexts[p][c] = clone
            p = links[p]
        links[q] = clone
        return clone

    def finish(self) -> None:
        """What a state's extensions know of first occurrences holds for the state itself."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            p = self.link[s]
            if self.first[s] < self.first[p]:
                self.first[p] = self.first[s]

    def stream(self, words: list[bytes], window: int) -> list[int]:
        """Matching statistics, cut at ``window``: for each full window its first doc_id."""
        nexts, links, lens, firsts = self.next, self.link, self.len, self.first
        state = length = 0
        out = []
        for c in words:
            while state and c not in nexts[state]:
                state = links[state]
                length = lens[state]
            state = nexts[state].get(c, 0)
            length = length + 1 if state else 0
            while state and lens[links[state]] >= window:
                state = links[state]
                length = lens[state]
            if length >= window:
                out.append(firsts[state])
        return out


def _match(window: int):
    def run(group: pa.Table) -> pa.Table:
        part, texts = group.column("part").to_numpy(), group.column("words").to_pylist()
        doc = group.column("doc_id").to_numpy()
        total = sum(len(t) for t in texts) // 6
        pieces = -(-max(1, total) // SHARD_WORDS)
        results: list[bytes] = [b""] * len(texts)
        piece = part % pieces  # by anchor, so equal windows stay together
        for s in range(pieces):
            rows = np.flatnonzero(piece == s)
            least: dict[bytes, int] = {}
            for r in rows:
                t, d = texts[r], int(doc[r])
                if d < least.get(t, 1 << 62):
                    least[t] = d
            automaton = SuffixAutomaton()
            split = {t: t.split(b" ") for t in least}
            for t, d in least.items():
                automaton.add(split[t], d)
            automaton.finish()
            answer = {t: np.array(automaton.stream(w, window), np.int64).tobytes() for t, w in split.items()}
            for r in rows:
                results[r] = answer[texts[r]]
        return pa.table({"block": group.column("block"), "kind": pa.array(group.column("stretch").to_numpy() + 2, pa.int32()), "packed": pa.array(results, pa.binary())})

    return run


def _remove(window: int, keep_text: bool):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        ids, stretches, rows = _stretches(docs, back, window)
        first_docs: list = [None] * len(stretches)
        for kind, packed in zip(back.column("kind").to_pylist(), back.column("packed"), strict=True):
            if kind >= 2:
                first_docs[kind - 2] = np.frombuffer(packed.as_buffer(), np.int64)
        n_words, n_removed, kept, texts = [], [], [], []
        for i, j, w, raw, offsets, places in rows:
            for d in range(i, j):
                a, words = int(w.first[d - i]), raw[offsets[d - i] : offsets[d - i + 1]].split()
                n = len(words)
                earlier = [np.flatnonzero(first_docs[stretch] < ids[d]) + at - a for at, stretch in places[d - i]]
                earlier = np.concatenate(earlier) if earlier else np.zeros(0, np.int64)
                if len(earlier):
                    marks = np.bincount(earlier, minlength=n + 1) - np.bincount(earlier + window, minlength=n + 1)
                    words = list(compress(words, (np.cumsum(marks[:n]) == 0).tolist()))
                text = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode() if keep_text else None)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string()), "kept_text": pa.array(texts, pa.string())})

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def substring_dedup(docs: DataFrame, window: int = 13, keep_text: bool = True) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept_text), one per row of ``docs``.

    ``docs`` needs doc_id (integer) and text; other columns are ignored.  Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged; kept words are joined by one space, and kept_sha256 is
    the hex digest of that.  Null and empty texts have no words.  Rows with one doc_id, whatever
    their texts, are one another's equals: neither is earlier.  Rows without doc_id come after all others and do
    not make other rows lose words, nor lose any themselves.  An empty table gives an empty result.
    ``keep_text`` false leaves kept_text null.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    p, total = width(spark), text_bytes(docs)
    blocks, shards = parts(total, 4 << 20), parts(total, 1 << 20)
    lost = docs.where("doc_id IS NULL")
    placed = docs.where("doc_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition(p, "block")
    entries = placed.sortWithinPartitions("block").mapInArrow(_enter(window, shards), Router.SCHEMA)
    shared = entries.repartition(p, "bucket").groupBy("bucket").applyInArrow(_shared, "block int, kind int, packed binary")
    shared = shared.repartition(p, "block")
    sent = placed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send(window, shards), "shard int, part int, block int, stretch int, doc_id long, words binary")
    first = sent.repartition(p, "shard").groupBy("shard").applyInArrow(_match(window), "block int, kind int, packed binary")
    back = shared.unionByName(first)
    done = placed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_remove(window, keep_text), RESULT)
    if lost.limit(1).count():
        done = done.unionByName(lost.mapInArrow(_alone(keep_text), RESULT))
    return done


def _alone(keep_text: bool):
    def run(batches):
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            texts = [b" ".join(w) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode() if keep_text else None for t in texts], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run
