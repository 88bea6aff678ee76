"""Whether a working tree is as it was: one token over its configuration and what has changed in it."""

from __future__ import annotations

import hashlib
import os
import subprocess

from ..config import Config, embedding_fingerprint, extraction_fingerprint
from ..functions.text import glob_regex
from .worktree import listing


def _state(root: str, path: str) -> str:
    try:
        told = os.lstat(os.path.join(root, path))
    except OSError:
        return f"{path!r} missing"
    return f"{path!r} {told.st_mode} {told.st_size} {told.st_mtime_ns}"


def _git(root: str, *command: str) -> bytes | None:
    try:
        done = subprocess.run(["git", "-C", root, *command], capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return None if done.returncode else done.stdout


def dirty_paths(status: bytes) -> list[str]:
    """Paths of a porcelain status with zero bytes between: both sides of renames and copies."""
    out, entries = [], iter(status.split(b"\0"))
    for entry in entries:
        if len(entry) > 3:
            out.append(os.fsdecode(entry[3:]))
            if entry[:1] in b"RC" or entry[1:2] in b"RC":
                out.append(os.fsdecode(next(entries, b"")))
    return out


def freshness(root: str, config: Config) -> str:
    """Changes with the fingerprints, the commit, and any dirty file's mode, size or time; without git, with any file's."""
    import re

    parts = [extraction_fingerprint(config), "embedding:none" if config.embedding is None else embedding_fingerprint(config.embedding)]
    status = _git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all")
    if status is not None:
        head = _git(root, "rev-parse", "HEAD") or b"unborn"
        parts += [head.decode().strip(), status.hex(), *(_state(root, p) for p in dirty_paths(status))]
    else:
        ignored = [re.compile(glob_regex(g)) for g in config.ignoreGlobs]
        parts += [f"{path!r} {size} {time}" for path, size, time in listing(root) if not any(g.match(path) for g in ignored)]
    return "sha256:" + hashlib.sha256("\n".join(parts).encode("utf-8", "surrogateescape")).hexdigest()
