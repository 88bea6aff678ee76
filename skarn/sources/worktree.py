"""Working trees on a shared file system: listed on the driver, as git does or by a walk, and read by tasks.

Unlike Spark's binary reader this sees names that begin with a dot or an underscore."""

from __future__ import annotations

import os
import stat
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from .tables import checked

FILES_PER_TASK = 256


def git_paths(root: str, wait: float = 60) -> list[str] | None:
    """Tracked and untracked files that git doesn't ignore; None where git can't tell."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, timeout=wait)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return None if done.returncode else [p for p in os.fsdecode(done.stdout).split("\0") if p]


def walked_paths(root: str) -> list[str]:
    """Files below ``root``, but for those of .git; folders that can't be opened are passed over."""
    out = []
    for folder, inner, names in os.walk(root):
        inner[:] = [d for d in inner if d != ".git"]
        out += [os.path.relpath(os.path.join(folder, n), root) for n in names]
    return out


def listing(root: str) -> list[tuple[str, int, int]]:
    """(path, size, mtime_ns) of the regular files, in order; links aren't followed and names that aren't UTF-8 are passed over."""
    found = git_paths(root)
    out = []
    for path in sorted(set(walked_paths(root) if found is None else found)):
        try:
            path.encode()
            told = os.lstat(os.path.join(root, path))
        except (OSError, UnicodeEncodeError):
            continue
        if stat.S_ISREG(told.st_mode):
            out.append((path, told.st_size, told.st_mtime_ns))
    return out


def read_worktree(spark: SparkSession, root: str, ignore: list[str] | None = None, most: int = model.MAX_FILE_BYTES, only: set[str] | None = None) -> DataFrame:
    """The columns of ``read_files`` for a working tree; only files that may pass are opened.

    ``only`` names the paths to read.  A file that vanished after the listing has the reason
    "unreadable".  An empty tree gives no rows."""
    rows = [r for r in listing(root) if only is None or r[0] in only]
    files = spark.createDataFrame(rows, "path string, size long, mtime_ns long").where(~T.ignored(F.col("path"), ignore or []))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 16):
                part = frame.iloc[a : a + 16].copy()
                raw = []
                for path, size, secret in zip(part["path"], part["size"], part.pop("secret"), strict=True):
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            raw.append(None if size > most or secret else f.read())
                    except OSError:
                        raw.append(None)
                yield part.assign(raw=raw)

    files = files.withColumn("secret", T.extension(F.col("path")).isin(model.SECRET_EXTENSIONS))
    tasks = -(-len(rows) // FILES_PER_TASK) or 1
    raw = files.repartition(tasks).mapInPandas(read, "path string, size long, mtime_ns long, raw binary")
    out = checked(raw, most)
    return out.withColumn("reason", F.when(F.col("content").isNull(), F.coalesce("reason", F.lit("unreadable"))))
