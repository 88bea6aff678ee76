"""Vectorised text kernels over Arrow string buffers.

All kernels work on whole texts.  A batch is cut into runs of documents of about ``CHUNK``
bytes (a longer document makes a run of its own), so memory follows the longest document and
not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def byte_values(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte; with ``lower``, A-Z take the values of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    if lower:
        table[65:91] = table[97:123]
    return table


def not_space() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n+1 offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    _, offs, data = texts.buffers()
    if offs is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of consecutive documents of about ``limit`` bytes."""
    data, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a run of documents: byte spans, hashes and where each document's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, values: np.ndarray):
        n = len(data)
        inside = is_word[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[firsts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[firsts[firsts > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        with np.errstate(over="ignore"):
            power = np.full(n, _BASE, np.uint64)
            np.cumprod(power, out=power)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values[data] * power, out=sums[1:])
            del power
            back = np.full(n, _INVERSE, np.uint64)
            np.cumprod(back, out=back)
            self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start]) if n else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets)
        self.data = data

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; starts near the end of a document hold rubbish."""
        h = self.hash
        out = np.zeros(len(h), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out *= _STEP
                out[: len(h) - j] += h[j:]
        return mix(out)

    def sequence_hash(self, a: int, b: int) -> int:
        """Hash of the words a..b-1, as grams(b - a) gives for a."""
        with np.errstate(over="ignore"):
            x = U(0)
            for h in self.hash[a:b]:
                x = x * _STEP + h
            return mix(np.array([x], np.uint64))[0]
