"""Suites of retrieval cases: read strictly, checked, and what they cover."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import subprocess
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The schema, and the modes, classes and kinds that a case may name.
SCHEMA = "skarn.suite/v1"
MODES = ("lexical", "semantic", "graph", "auto")
CLASSES = ("lexical-exact", "semantic-paraphrase", "graph-neighbor", "hybrid-cross-signal")
MATCHES = ("", "fixed", "regexp")
REPOSITORY = {"id": str, "url": str}
CASE = {
    "id": str, "repositoryId": str, "revision": str, "fixRevision": str, "query": str, "matchKind": str, "about": str, "sourceUrl": str, "expectedPaths": list,
    "sourceKinds": list, "problemClasses": list, "architectureClasses": list, "retrievalClass": str, "expectedBestModes": list,
}


class SuiteError(ValueError):
    """A suite that can't be used."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise SuiteError(message)


def _typed(value: object, allowed: dict, where: str) -> dict:
    _need(isinstance(value, dict) and set(value) <= set(allowed), f"{where}: an object with known fields is needed")
    for name, item in value.items():
        _need(type(item) is allowed[name] and (type(item) is str or all(isinstance(x, str) for x in item)), f"{where}: {name} has another type")
    return {name: kind() for name, kind in allowed.items()} | value


def _https(url: str) -> bool:
    parts = urlsplit(url)
    return parts.scheme == "https" and bool(parts.netloc)


def _relative(path: str) -> bool:
    return not path.startswith("/") and path not in ("", ".", "..") and not path.startswith("../") and posixpath.normpath(path) == path


def _distinct(values: list[str]) -> bool:
    return len(set(values)) == len(values)


def check(suite: dict) -> dict:
    """The suite with all fields, or SuiteError."""
    _need(isinstance(suite, dict) and set(suite) <= {"schema", "id", "repositories", "cases"}, "unknown fields")
    _need(suite.get("schema") == SCHEMA, f"the schema must be {SCHEMA}")
    repositories = [_typed(r, REPOSITORY, "repositories") for r in suite.get("repositories") or []]
    cases = [_typed(c, CASE, "cases") for c in suite.get("cases") or []]
    _need(bool(suite.get("id")) and bool(cases), "a suite needs an id and cases")
    _need(all(r["id"] and _https(r["url"]) for r in repositories) and _distinct([r["id"] for r in repositories]), "repositories need ids of their own and https addresses")
    _need(all(c["id"] for c in cases) and _distinct([c["id"] for c in cases]), "cases need ids of their own")
    known = {r["id"] for r in repositories}
    for c in cases:
        where = f"case {c['id']}: "
        _need(c["repositoryId"] in known, where + "no such repository")
        _need(all(re.fullmatch("[0-9a-f]{40}", c[k]) for k in ("revision", "fixRevision")), where + "revisions are full hashes")
        _need(bool(c["query"].strip()) and all(c[k] for k in ("expectedPaths", "sourceKinds", "problemClasses", "architectureClasses")), where + "a query, paths and classes are needed")
        _need(bool(c["retrievalClass"]) == bool(c["expectedBestModes"]), where + "retrievalClass and expectedBestModes go together")
        _need(c["matchKind"] in MATCHES and c["retrievalClass"] in ("", *CLASSES), where + "no such kind or class")
        _need(set(c["expectedBestModes"]) <= set(MODES) and _distinct(c["expectedBestModes"]), where + "no such mode, or one twice")
        _need(_https(c["sourceUrl"]), where + "sourceUrl is an https address")
        _need(all(map(_relative, c["expectedPaths"])) and _distinct(c["expectedPaths"]), where + "paths are clean, relative and named once")
    return {"schema": SCHEMA, "id": suite["id"], "repositories": repositories, "cases": cases}


def load(path: str) -> tuple[dict, str]:
    """(suite, hash of its bytes)."""
    with open(path, "rb") as f:
        data = f.read()
    try:
        return check(json.loads(data)), "sha256:" + hashlib.sha256(data).hexdigest()
    except json.JSONDecodeError as e:
        raise SuiteError(f"not one JSON value: {e}") from None


def attribute_sets(cases: DataFrame, attributes: list[str]) -> DataFrame:
    """One row: the number of cases and, for each attribute (an array column), its distinct values in order."""
    gathered = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(a)))).alias(a) for a in attributes]
    return cases.agg(F.count("*").alias("cases"), *gathered)


def unchanged_truth(root: str, case: dict) -> list[str]:
    """Expected paths that the fix did not change, as git tells; SuiteError if it can't."""
    done = subprocess.run(["git", "-C", root, "diff", "--name-only", "-z", case["revision"], case["fixRevision"], "--"], capture_output=True, timeout=60)
    _need(done.returncode == 0, "a revision is missing")
    changed = set(done.stdout.decode().split("\0"))
    return [p for p in case["expectedPaths"] if p not in changed]
