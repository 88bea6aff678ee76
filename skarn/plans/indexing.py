"""Indexing a working tree: only files that changed are read, and the next version has all that hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import extractors, graph, snapshot
from ..operators.chunking import chunk_records
from ..operators.index import Index, write_index
from ..sources.freshness import freshness
from ..sources.worktree import listing, read_worktree


def index_tree(spark: SparkSession, root: str, store: snapshot.Store, config: C.Config | None = None, full: bool = False, progress=None, batch: int = 5000) -> dict:
    """Brings ``store`` up to date with the tree and returns what was done, by counts.

    Unchanged size, time and fingerprint pass a file over unread (but for ``full``); of what was read,
    an unchanged hash only refreshes size and time.  Changed and vanished files lose their records,
    vectors and edges.  Files that are left out now, with the reason, count as vanished."""
    config = config or C.load(root)
    fingerprint, say = C.extraction_fingerprint(config), progress or (lambda *a, **k: None)
    found = spark.createDataFrame(listing(root), "path string, size long, mtime_ns long").where(~T.ignored(F.col("path"), config.ignoreGlobs))
    old = store.read("files")
    states = spark.createDataFrame([], "path string, size long, mtime_ns long, extraction_fingerprint string, content_hash string") if old is None else old
    told = {state: [r["path"] for r in rows] for state, rows in _by_state(snapshot.changes(found, states, fingerprint, full)).items()}
    asked = told.get("new", []) + told.get("check", [])
    say("discover", len(asked), len(asked), terminal=True)
    read = _kept(read_worktree(spark, root, config.ignoreGlobs, config.maxFileBytes, only=set(asked)), store)
    sound = read.where("reason IS NULL").withColumn("extraction_fingerprint", F.lit(fingerprint))
    same = sound.join(states.select("path", "content_hash", "extraction_fingerprint"), ["path", "content_hash", "extraction_fingerprint"], "left_semi")
    changed = sound.join(same.select("path"), "path", "left_anti")
    gone = spark.createDataFrame([(p,) for p in told.get("deleted", [])], "path string").unionByName(read.where("reason IS NOT NULL").select("path"))
    plugins = {p.id: p for p in config.plugins}
    chosen = {name: (plugins[name].includeGlobs if name in plugins else globs, f) for name, (globs, f) in extractors.EXTRACTORS.items() if not plugins or name in plugins}
    facts = extractors.extract(changed, chosen)
    records = chunk_records(changed).unionByName(facts.where("message IS NULL").drop("message"))
    files = changed.select("path", "kind", "size", "mtime_ns", "content_hash", "extraction_fingerprint")
    run = snapshot.apply_batch(store, files, records, gone, same.select("path", "size", "mtime_ns"), snapshot.diagnostics(facts, "extract", "extract"), freshness=freshness(root, config))
    kept = store.read("records")
    store.write({"edges": graph.resolve(graph.edges(kept), store.read("files"))}, derived_from=run, freshness=freshness(root, config))
    write_index(kept, f"{store.root}/index-{run}")
    say("index", len(asked), len(asked), terminal=True)
    return {"run": run, "read": len(asked), "changed": changed.count(), "refreshed": same.count(), "gone": gone.count(), "unchanged": len(told.get("unchanged", [])), "records": kept.count()}


def _by_state(states: DataFrame) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in states.collect():  # the tree's listing, which the driver has made
        out.setdefault(r["state"], []).append(r)
    return out


def _kept(read: DataFrame, store: snapshot.Store) -> DataFrame:
    """Contents as they were read once: files may change while an index is made."""
    import os

    folder = f"{store.root}/read-{os.urandom(6).hex()}"
    read.write.parquet(folder)
    return read.sparkSession.read.schema(read.schema).parquet(folder)


def open_index(spark: SparkSession, store: snapshot.Store) -> Index | None:
    """The inverted index of the last version; None where there is none yet."""
    now = store.version()
    return None if now is None or "derived_from" not in now else Index(spark, f"{store.root}/index-{now['derived_from']}")


def status(root: str, store: snapshot.Store, config: C.Config | None = None) -> dict:
    """What the store holds, and whether the tree is as it was when that was made."""
    now, config = store.version(), config or C.load(root)
    counts = {name: store.read(name).count() for name in now["tables"]} if now else {}
    return {"run": now and now["id"], "counts": counts, "fresh": bool(now) and now.get("freshness") == freshness(root, config)}
