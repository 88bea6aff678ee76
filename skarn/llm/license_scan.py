"""License scan: an exact set-similarity join of license templates with text blocks.

A block is a line or, with ``wrapped``, a line and as many of the next lines as it takes to hold
the template's number of words after it, so that a template that starts in a line is in its block
however it is wrapped.  A template is found in a block when the block holds at least ``threshold``
of the template's distinct words (containment).  Template words are ordered by how many blocks
of the whole corpus hold them, rarest first; so are a block's words, as far as any template has
them.  A template's *prefix*, one word more than may be missing, must share a word with the
block; the block must be *long* enough; and from the *position* of the first shared word on,
enough words must be left in the template and in the block.  What passes is verified word by
word, so the join is exact.

Templates are a bounded parameter and travel with the tasks; blocks never do.
Phrases are also looked for at each place where their words stand consecutively.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, alphanumeric, byte_values, runs

#: Label of each phrase.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label and text of each template.
TEMPLATES = {
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "warranty-disclaimer": "The software is provided as is, without warranty of any kind, express or implied",
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
MAX_TEMPLATE_WORDS = 100_000


def template_words(text: str) -> list[str]:
    data = text.encode().lower() if text.isascii() else text.translate({c: c + 32 for c in range(65, 91)}).encode()
    ok = alphanumeric()
    return [w.decode() for w in "".join(chr(b) if ok[b] else " " for b in data).encode("latin-1").split()]


def _hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), alphanumeric(), byte_values(True)).hash


def _lines(w: Words) -> np.ndarray:
    """The line, counted through the run, of each word; documents start new lines."""
    breaks = np.flatnonzero(w.data == 10)
    line = np.searchsorted(breaks, w.start)
    doc = np.searchsorted(w.first, np.arange(len(w.start)), side="right")
    return line + doc


def _count(vocabulary: np.ndarray):
    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in runs(batch.column(0)):
                w = Words(data, offsets, alphanumeric(), byte_values(True))
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == w.hash)
                key = np.unique(_lines(w)[hit].astype(np.int64) * len(vocabulary) + at[hit])
                total += np.bincount(key % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocabulary)), pa.int32()), pa.array(total)], names=["word", "n"])

    return run


def _windows(w: Words, line: np.ndarray, hit: np.ndarray, reach: int) -> np.ndarray:
    """First word and end of the blocks that hold one of the words ``hit``: each line and what it
    takes of the document's next lines to hold ``reach`` words after it."""
    a = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    own = np.r_[a[1:], len(line)]
    doc_end = w.first[np.searchsorted(w.first, a, side="right")]
    b = np.searchsorted(line, line[np.minimum(own + reach, doc_end) - 1], side="right")
    found = np.searchsorted(hit, b) > np.searchsorted(hit, a)
    return np.stack([a[found], b[found]], 1)


def overlap(block: set, held: list[int], place: dict[int, int], rank: dict[int, int], need: int, prefix: int) -> int:
    """How many of a template's words a block holds; 0 where a filter tells that these are less than ``need``.

    ``held`` are the places, in order, of the block's words in the order of all template words,
    ``place`` has those of all, ``rank`` the template's words in the same order."""
    if len(block) < need:  # length
        return 0
    mine = [y for y in block if y in rank]
    first = min(mine, key=rank.__getitem__, default=None)
    if first is None or rank[first] >= prefix:  # prefix
        return 0
    if min(len(rank) - rank[first], len(held) - bisect_left(held, place[first])) < need:  # position
        return 0
    return len(mine) if len(mine) >= need else 0


def _scan(phrases: list[tuple[np.ndarray, str]], templates: list[tuple[str, np.ndarray]], threshold: float, keep_blocks: bool, often: dict[int, int], reach: dict[str, int] | None = None):
    """templates: (label, word hashes, rarest first); often: blocks that hold a word; reach: words of each template, for wrapped ones."""
    plan = []
    for label, words in templates:
        need = math.ceil(threshold * len(words) - 1e-9)
        plan.append((label, words, {int(h): k for k, h in enumerate(words)}, need, len(words) - need + 1))
    place = {h: k for k, h in enumerate(sorted({int(h) for _, words in templates for h in words}, key=lambda h: (often.get(h, 0), h)))}
    prefix_words = np.unique(np.concatenate([words[:n] for _, words, _, _, n in plan])) if plan else np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            n_words, n_base, first, last, base, labels, score, blocks = ([] for _ in range(8))
            for i, j, data, offsets in runs(batch.column("text")):
                w = Words(data, offsets, alphanumeric(), byte_values(True))
                h, n = w.hash, j - i
                found: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                for words, label in phrases:
                    at = np.flatnonzero(h == words[0])
                    for k, x in enumerate(words[1:], 1):
                        at = at[at + k < len(h)]
                        at = at[h[at + k] == x]
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    ok = at + len(words) <= w.first[doc + 1]
                    for d, a in zip(doc[ok].tolist(), at[ok].tolist(), strict=True):
                        found[d].append((a - int(w.first[d]), label))
                more: list[list[tuple[str, float, int, int]]] = [[] for _ in range(n)]
                if len(prefix_words):
                    at = np.minimum(np.searchsorted(prefix_words, h), len(prefix_words) - 1)
                    hit = np.flatnonzero(prefix_words[at] == h)
                    line = _lines(w) if len(hit) else np.zeros(0, np.int64)
                    if reach is not None and len(hit):
                        for label, words, rank, need, prefix in plan:
                            for a, b in _windows(w, line, hit[np.isin(h[hit], words[:prefix])], reach[label]):
                                block = set(h[a:b].tolist())
                                both = overlap(block, sorted(place[y] for y in block if y in place), place, rank, need, prefix)
                                if both:
                                    d = int(np.searchsorted(w.first, a, side="right")) - 1
                                    more[d].append((label, both / len(words), int(a - w.first[d]), int(b - w.first[d])))
                    for x in np.unique(line[hit]) if reach is None else ():
                        a, b = np.searchsorted(line, x), np.searchsorted(line, x, side="right")
                        block = set(h[a:b].tolist())
                        held = sorted(place[y] for y in block if y in place)
                        for label, words, rank, need, prefix in plan:
                            both = overlap(block, held, place, rank, need, prefix)
                            if both:
                                d = int(np.searchsorted(w.first, a, side="right")) - 1
                                more[d].append((label, both / len(words), int(a - w.first[d]), int(b - w.first[d])))
                for d in range(n):
                    places = [a for a, _ in found[d]]
                    n_words.append(int(w.first[d + 1] - w.first[d]))
                    n_base.append(len(places))
                    first.append(min(places, default=None))
                    last.append(max(places, default=None))
                    base.append(",".join(sorted({x for _, x in found[d]})))
                    labels.append(",".join(sorted({x for _, x in found[d]} | {x[0] for x in more[d]})))
                    score.append(1.0 if places else max((x[1] for x in more[d]), default=0.0))
                    blocks.append(";".join(f"{x[0]}:{x[2]}:{x[3]}" for x in more[d]) if keep_blocks else None)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, long), pa.array(n_base, long), pa.array(first, long), pa.array(last, long), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(blocks, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.9, keep_blocks: bool = True, wrapped: bool = False) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, blocks.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  ``blocks`` lists
    label:first word:end word of each block found.  score is 1 where a phrase stands, else the
    best containment found, else 0.  Null and empty texts have no words, empty labels and score
    0; a null doc_id stays null.  Other columns are ignored.  Templates without words find nothing.
    """
    phrases = PHRASES if phrases is None else phrases
    texts = {label: sorted(set(template_words(t))) for label, t in (TEMPLATES if templates is None else templates).items()}
    if sum(map(len, texts.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of over {MAX_TEMPLATE_WORDS} words in all")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = np.unique(np.concatenate([_hashes(t) for t in texts.values() if t] or [np.zeros(1, np.uint64)]))
    rows = docs.select("text").mapInArrow(_count(vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    often = {int(vocabulary[r["word"]]): r["n"] for r in rows}  # at most one row for each template word
    ordered = [(label, np.array(sorted(_hashes(t).tolist(), key=lambda x: (often.get(x, 0), x)), np.uint64)) for label, t in texts.items() if t]
    reach = {label: len(template_words(t)) for label, t in (TEMPLATES if templates is None else templates).items()} if wrapped else None
    words = [(_hashes(template_words(p)), label) for p, label in phrases.items()]
    return docs.mapInArrow(_scan(words, ordered, threshold, keep_blocks, often, reach), RESULT)
