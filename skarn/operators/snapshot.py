"""Incremental snapshots: what changed, the next version, drift, and the work queue for vectors."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): new, modified, deleted or unchanged, from (path, content_hash) on both sides."""
    o, n = old.select("path", F.col("content_hash").alias("_o")), new.select("path", F.col("content_hash").alias("_n"))
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("modified")
    return o.join(n, "path", "full_outer").select("path", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, gone: DataFrame | None = None, key: str = "path") -> DataFrame:
    """The next version: rows of ``new`` replace those of their key, keys of ``gone`` go."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    if gone is not None:
        kept = kept.join(gone.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts by state; a skipped file is not new."""
    counts = {s: F.sum((F.col("state") == s).cast("long")).alias(s) for s in ("new", "modified", "deleted", "unchanged")}
    return diff(old, new).agg(*counts.values())


def embeddable(records: DataFrame) -> DataFrame:
    """Records for the vector lane with their input and its hash."""
    kept = records.where((F.col("kind") != "file") & T.flag(F.col("metadata"), "semantic", True))
    return kept.withColumns({"input": T.input_text(F.col("title"), F.col("text")), "input_hash": T.input_hash(F.col("title"), F.col("text"))})


def missing_inputs(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct inputs without a vector (input_hash, input, record_id), the shortest first.

    ``records`` has record_id, input, input_hash; ``vectors`` record_id, input_hash."""
    lacking = records.join(vectors.select("record_id", "input_hash"), ["record_id", "input_hash"], "left_anti")
    return lacking.groupBy("input_hash", "input").agg(F.min("record_id").alias("record_id")).orderBy(F.length("input"), "record_id")


def fan_out(records: DataFrame, results: DataFrame) -> DataFrame:
    """A vector for every record of its input: results(input_hash, vector) joined back."""
    return records.select("record_id", "input_hash").join(results, "input_hash")


def coverage(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """(records, embedded, complete) in one row."""
    joined = records.select("record_id", "input_hash").join(vectors.select("record_id", "input_hash", F.lit(1).alias("_v")).distinct(), ["record_id", "input_hash"], "left")
    return joined.agg(F.count("*").alias("records"), F.count("_v").alias("embedded")).withColumn("complete", F.col("records") == F.col("embedded"))


def changes(candidates: DataFrame, states: DataFrame, fingerprint: str, full: bool = False) -> DataFrame:
    """(path, state) from candidates(path, size, mtime_ns) and states(path, size, mtime_ns, extraction_fingerprint).

    A file is unchanged if size, time and fingerprint are as they were, and need not be read; else
    it is new or to be checked.  Vanished files are deleted.  ``full`` checks every file."""
    known = states.select("path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"), F.col("extraction_fingerprint").alias("_f"))
    same = (F.col("size") == F.col("_s")) & (F.col("mtime_ns") == F.col("_m")) & (F.col("_f") == fingerprint) & F.lit(not full)
    state = F.when(F.col("_s").isNull(), "new").when(F.col("size").isNull(), "deleted").when(same, "unchanged").otherwise("check")
    return candidates.select("path", "size", "mtime_ns").join(known, "path", "full_outer").select("path", state.alias("state"))


def refresh(files: DataFrame, told: DataFrame) -> DataFrame:
    """``files`` with size and mtime_ns of told(path, size, mtime_ns) where it has them: touched, not changed."""
    new = told.select("path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"))
    joined = files.join(new, "path", "left").withColumns({"size": F.coalesce("_s", "size"), "mtime_ns": F.coalesce("_m", "mtime_ns")})
    return joined.select(files.columns)


def record_keys(records: DataFrame) -> DataFrame:
    """``records`` with record_key and record_id: source, path and the extractor's id, or else place, kind and number.

    The id follows from the key, so that a record keeps it from version to version."""
    own = F.col("id") if "id" in records.columns else F.lit(None).cast("string")
    place = F.concat_ws(":", "source", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "kind", F.col("ordinal").cast("string"))
    key = F.when(F.coalesce(own, F.lit("")) != "", F.concat_ws(":", "source", "path", own)).otherwise(place)
    return records.withColumn("record_key", key).withColumn("record_id", F.shiftrightunsigned(F.xxhash64("record_key"), 1))


def repeated_keys(records: DataFrame) -> DataFrame:
    """Keys that occur more than once; there must be none."""
    return records.groupBy("record_key").agg(F.count("*").alias("n")).where("n > 1")


def cascade(records: DataFrame, derived: DataFrame, *on: str) -> DataFrame:
    """Rows of a derived table (vectors, edges, postings) whose records are still there."""
    return derived.join(records.select(*on).distinct(), list(on), "left_semi")


def diagnostics(found: DataFrame, run: str, stage: str) -> DataFrame:
    """(run_id, path, stage, message) of what extractors or providers could not do."""
    return found.where(F.col("message").isNotNull()).select(F.lit(run).alias("run_id"), "path", F.lit(stage).alias("stage"), "message")


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to follow."""


class Store:
    """Versioned tables in a folder: immutable folders of tables and a log of runs, a file for each.

    The last completed run names the tables that readers see; they keep the version that they
    opened.  A log file is made once: of two writers that follow one version the second gets
    Conflict.  A failed run leaves the tables as they were."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[dict]:
        folder, fs = self._path("log")
        if not fs.exists(folder):
            return []
        rows = self.spark.read.schema("value string").text(f"{self.root}/log", wholetext=True).collect()  # a row per run
        return sorted((json.loads(r["value"]) for r in rows if r["value"]), key=lambda e: e["number"])

    def _publish(self, entry: dict) -> None:
        path, fs = self._path(f"log/{entry['number']:012d}.json")
        try:
            out = fs.create(path, False)
        except Exception as error:
            if "AlreadyExists" in str(error):
                raise Conflict(f"run {entry['number']} is another writer's") from error
            raise
        out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
        out.close()

    def version(self) -> dict | None:
        done = [e for e in self._entries() if e["status"] == "completed"]
        return done[-1] if done else None

    def read(self, name: str) -> DataFrame | None:
        now = self.version()
        return self.spark.read.parquet(now["tables"][name]) if now and name in now["tables"] else None

    def write(self, tables: dict[str, DataFrame], **summary) -> str:
        """Writes the tables, then the log file: a run is seen whole or not at all.  Tables not named stay as they are."""
        entries = self._entries()
        began, number = time.time_ns() // 10**6, entries[-1]["number"] + 1 if entries else 1
        kept = next((e["tables"] for e in reversed(entries) if e["status"] == "completed"), {})
        stamp = f"{time.time_ns():020d}-{os.urandom(4).hex()}"
        entry = {"number": number, "id": stamp, "started_at_ms": began, "tables": kept}
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/{stamp}/{name}")
        except Exception as error:
            self._publish(entry | {"status": "failed", "finished_at_ms": time.time_ns() // 10**6, "error": str(error)[:500]} | summary)
            raise
        new = {name: f"{self.root}/{stamp}/{name}" for name in tables}
        self._publish(entry | {"status": "completed", "finished_at_ms": time.time_ns() // 10**6, "tables": kept | new} | summary)
        return stamp

    def runs(self) -> list[dict]:
        """All runs, the latest last."""
        return self._entries()

    def clone(self, root: str, **identity) -> "Store":
        """A store of its own that begins with this one's tables; runs and diagnostics are not taken along."""
        now, other = self.version(), Store(self.spark, root)
        if now is None:
            raise ValueError("there is no version to clone")
        tables = {name: path for name, path in now["tables"].items() if name != "diagnostics"}
        moment = time.time_ns() // 10**6
        other._publish({"number": 1, "id": now["id"], "started_at_ms": moment, "finished_at_ms": moment, "status": "completed", "tables": tables, "seeded_from": self.root} | identity)
        return other


def apply_batch(store: Store, files: DataFrame, records: DataFrame, gone: DataFrame | None = None, touched: DataFrame | None = None, found: DataFrame | None = None, **summary) -> str:
    """The next version of a store: files(path, ...) replace those of their paths with all their records, paths of
    ``gone`` go, ``touched`` gets new sizes and times; vectors and edges of records that went go too.

    ``records`` has no keys yet; a key that occurs twice raises ValueError and nothing is written."""
    keyed = record_keys(records)
    keyed = keyed.withColumn("input_hash", T.input_hash(F.col("title"), F.col("text")))
    twice = repeated_keys(keyed).limit(3).collect()
    if twice:
        raise ValueError(f"record keys occur twice: {[r['record_key'] for r in twice]}")
    old = {name: store.read(name) for name in ("files", "records", "vectors", "edges", "diagnostics")}
    paths = files.select("path") if gone is None else files.select("path").unionByName(gone.select("path"))
    out = {"files": files, "records": keyed}
    if old["files"] is not None:
        kept = old["files"] if touched is None else refresh(old["files"], touched)
        out["files"] = upsert(kept, files, gone)
        out["records"] = old["records"].join(paths.distinct(), "path", "left_anti").unionByName(keyed, allowMissingColumns=True)
    for name, on in (("vectors", ("record_id", "input_hash")), ("edges", ("record_id",))):
        if old[name] is not None:
            out[name] = cascade(out["records"], old[name], *on)
    if found is not None:
        out["diagnostics"] = found if old["diagnostics"] is None else old["diagnostics"].unionByName(found)
    return store.write(out, **summary)


class Progress:
    """Calls ``emit`` with events, those of one phase at least ``every`` seconds apart; the last of a phase always."""

    def __init__(self, emit, every: float = 0.5, clock=time.monotonic):
        self.emit, self.every, self.clock, self.last = emit, every, clock, {}

    def __call__(self, phase: str, done: int, total: int, terminal: bool = False) -> None:
        now = self.clock()
        if terminal or now - self.last.get(phase, -1e18) >= self.every:
            self.last[phase] = now
            self.emit({"schema": "skarn.progress/v1", "phase": phase, "done": done, "total": total, "terminal": terminal})


def seed_order(indexes: list[dict], head: str) -> list[dict]:
    """Sibling indexes (head, live, updated_at_ms) from the best to begin with: of the same commit first, then of a tree
    that is still there, then the newest."""
    return sorted(indexes, key=lambda i: (i["head"] != head, not i["live"], -i["updated_at_ms"]))


def prunable(indexes: list[dict]) -> list[dict]:
    """Indexes that nobody needs: their tree is gone, not registered, and nobody holds the lock."""
    return [i for i in indexes if not (i["live"] or i["registered"] or i["locked"])]
