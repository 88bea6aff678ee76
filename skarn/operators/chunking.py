"""The chunker: files to bounded, line-ranged records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .. import model


def pieces(line: str, most: int = model.CHUNK_BYTES) -> list[str]:
    """A line in pieces of at most ``most`` bytes, cut between characters."""
    raw, out = line.encode(), []
    while raw:
        end = min(most, len(raw))
        while end < len(raw) and end > 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[:end].decode())
        raw = raw[end:]
    return out


def windows(content: str) -> Iterator[tuple[int, int, str, bool]]:
    """(first line, last line, text, whether it is a piece of a long line)."""
    lines = content.split("\n")
    sizes = [len(line.encode()) for line in lines]
    at = 0
    while at < len(lines):
        if sizes[at] > model.CHUNK_BYTES:
            for piece in pieces(lines[at]):
                if piece.strip():
                    yield at + 1, at + 1, piece.strip(), True
            at += 1
            continue
        end, total = at, -1
        while end < len(lines) and end - at < model.CHUNK_LINES and total + 1 + sizes[end] <= model.CHUNK_BYTES:
            total += 1 + sizes[end]
            end += 1
        text = "\n".join(lines[at:end]).strip()
        if text:
            yield at + 1, end, text, False
        if end >= len(lines):
            return
        at = max(end - model.CHUNK_OVERLAP, at) if end - model.CHUNK_OVERLAP > at else end


def chunk_records(files: DataFrame) -> DataFrame:
    """Records of files(path, content): one ``file`` record each, then its windows.  Null contents give the file record only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows.append((path, 1, 1, "file", path, path, None, "core", 0))
                for k, (a, b, text, piece) in enumerate(windows(content or ""), 1):
                    rows.append((path, a, b, "text-chunk", f"{path}:{a}", text, json.dumps({"semantic": False}) if piece else None, "core", k))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in model.RECORD.split(", ")])

    return files.select("path", "content").mapInPandas(run, model.RECORD)
