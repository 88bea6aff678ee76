"""What the operators share: settings, packed shuffles, checkpoints and connected components."""

from __future__ import annotations

import ctypes
import functools
import math
import os
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FLUSH_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: as the session says."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder of spark.checkpoint.dir.

    Where none is named, a local session gets a temporary folder; a cluster is refused, as its
    executors would each write to a disk of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skarn-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, so that lost executors cost no earlier stage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: the figure by which shuffles are sized."""
    return int(docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)


def parts(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def bounded_sample(rows: DataFrame, most: int, *key: str, n: int | None = None, wide: float = 1.3) -> DataFrame:
    """At most ``most`` of the rows, those first by a hash of ``key``; all rows if there are no more.

    The count tells which share of the hash's range to keep, so no task sends the driver more than
    its part of the sample.  Rows that repeat a key lie at one place of the range: there may be
    fewer than ``most`` in it, but for a larger ``wide``."""
    order, span, name = F.shiftrightunsigned(F.xxhash64(*key), 2), 1 << 62, free(rows.columns, "_order")
    n = rows.count() if n is None else n
    if n > most:
        rows = rows.where(order < int(min(1.0, wide * most / n + 200 / n) * span))
    return rows.withColumn(name, order).orderBy(name, *key).limit(most).drop(name)


SAMPLE_BYTES, SAMPLE_TEXT = 64 << 20, 1 << 20


def sample_texts(rows: DataFrame, most: int) -> list[Row]:
    """At most ``most`` rows (doc_id, text, ...) for training, those first by a hash of both, on the driver.

    Texts of over ``SAMPLE_TEXT`` bytes are not drawn, and rows end where their texts reach
    ``SAMPLE_BYTES``, so the driver's share is bounded in rows and in bytes."""
    rows = rows.where(F.octet_length("text") <= SAMPLE_TEXT)
    size = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))  # ``most`` rows
    n, wide = rows.count(), 1.3
    while True:
        drawn = bounded_sample(rows, most, "doc_id", "text", n=n, wide=wide).withColumn("_size", size).orderBy("doc_id", "text").collect()
        if len(drawn) >= 0.9 * min(most, n) or wide * most > n:
            return [r for r in drawn if r["_size"] <= SAMPLE_BYTES]
        wide *= 64


class Router:
    """Packs fixed-width entries into one binary row per bucket and flush.

    ``fields`` are the dtypes of an entry's columns.  A row (bucket, packed) holds the columns
    one after the other, each a plain array, so that receivers read them without copies.
    """

    SCHEMA = "bucket int, packed binary"

    def __init__(self, buckets: int, fields: list[str], most: int = FLUSH_BYTES):
        self.buckets, self.fields, self.most = buckets, fields, most
        self.size, self.held = sum(np.dtype(f).itemsize for f in fields), []
        self.bytes = 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((bucket, *columns))
        self.bytes += len(bucket) * self.size
        if self.bytes >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        bucket = np.concatenate([h[0] for h in self.held])
        columns = [np.concatenate([h[k + 1] for h in self.held]).astype(f) for k, f in enumerate(self.fields)]
        self.held, self.bytes = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        columns = [c[order] for c in columns]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        ends = np.r_[cuts[1:], len(bucket)] if len(bucket) else []
        rows = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts, ends, strict=True)]
        for a in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[a : a + 512]].astype(np.int32)), pa.array(rows[a : a + 512], pa.binary())], names=["bucket", "packed"])


def unpack(packed: pa.ChunkedArray, fields: list[str]) -> list[np.ndarray]:
    """The columns of all entries in rows that a Router packed."""
    size = sum(np.dtype(f).itemsize for f in fields)
    out: list[list[np.ndarray]] = [[] for _ in fields]
    for row in packed:
        raw = memoryview(row.as_buffer())
        n, at = len(raw) // size, 0
        for k, f in enumerate(fields):
            out[k].append(np.frombuffer(raw, f, n, at))
            at += n * np.dtype(f).itemsize
    return [np.concatenate(o) if o else np.zeros(0, f) for o, f in zip(out, fields, strict=True)]


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL(None)
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def give_back() -> None:
    """Returns memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a function of an iterator of batches, which gives its memory back when it ends.

    Workers serve one task after the other, of all stages; what allocators keep of the largest task
    adds to the executor's memory for as long as the worker lives."""

    def leanly(batches):
        yield from run(batches)
        give_back()

    return leanly


def lean_group(run: Callable) -> Callable:
    """The same for a function of a group's table."""

    def leanly(group: pa.Table) -> pa.Table:
        out = run(group)
        give_back()
        return out

    return leanly


def free(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it until no column of ``taken`` has it, in any case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plainly(docs: DataFrame) -> DataFrame:
    """``docs`` with names that Arrow functions take: those with dots, spaces or backticks get others, in place."""
    names: list[str] = []
    for i, c in enumerate(docs.columns):
        names.append(c if c.isidentifier() else free([*docs.columns, *names], f"_c{i}"))
    return docs.toDF(*names)


def with_fields(schema: StructType, *more: str) -> StructType:
    """``schema`` and more fields, each as "name type" with a name that is free in ``schema``."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(more)).fields])


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and readers take the columns they need."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


HOT_KEYS = 10_000
HOT_ROWS = 200


def hot_above(rows: int) -> int:
    """Keys with more of the ``rows`` than this are hot: less than ``HOT_KEYS`` keys, by arithmetic."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def spread_join(big: DataFrame, small: DataFrame, rows: int, on: list[str], n: str = "n") -> DataFrame:
    """``big`` inner joined with ``small`` without a task that gets all rows of a hot key.

    ``small`` has each key once and ``n``, the number of its rows in ``big``, which has ``rows`` in
    all.  As there are less than ``HOT_KEYS`` hot keys, their rows of ``small`` are broadcast and
    ``big`` isn't shuffled for them; the rest meets by a shuffle."""
    small = checkpoint(small)
    hot = small.where(F.col(n) > hot_above(rows))
    if not hot.limit(1).count():
        return big.join(small, on)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small, on)
    return big.join(F.broadcast(hot), on).unionByName(rest)


SIEVE_BITS, SIEVE_PIECE = 1 << 25, 1 << 16


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint64)
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _sieve(bits: int):
    def run(batches):
        held = np.zeros(bits, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), bits):
                held[at] = True
        whole = np.packbits(held)
        for a in range(0, len(whole), SIEVE_PIECE):
            if (part := whole[a : a + SIEVE_PIECE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["at", "packed"])

    return run


def _either(group: pa.Table) -> pa.Table:
    parts = [np.frombuffer(zlib.decompress(p.as_py()), np.uint8) for p in group.column("packed")]
    return pa.table({"at": group.column("at").slice(0, 1), "packed": pa.array([zlib.compress(np.bitwise_or.reduce(parts).tobytes(), 1)], pa.binary())})


def sieve(keys: DataFrame, rows: int) -> Callable[[Column], Column]:
    """A filter on hashes (``F.xxhash64`` columns), which lets pass all of those in ``keys``, a column
    of ``rows`` hashes, and few others.

    What it stops needs no shuffle to a join with ``keys``.  It is a Bloom filter of two places in 16
    bits a key, at most ``SIEVE_BITS`` of them, whatever the number of keys; with more keys more others pass."""
    bits = min(SIEVE_BITS, 1 << max(10, (16 * rows - 1).bit_length()))
    schema, whole = "at long, packed binary", np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(lean(_sieve(bits)), schema).groupBy("at").applyInArrow(_either, schema).collect():  # SIEVE_BITS / 8 / SIEVE_PIECE rows at most
        part = np.frombuffer(zlib.decompress(r["packed"]), np.uint8)
        whole[r["at"] : r["at"] + len(part)] = part
    shared = keys.sparkSession.sparkContext.broadcast(whole)

    def passes(h: pa.Array) -> pa.Array:
        first, second = ((shared.value[at >> 3] >> (7 - (at & 7))) & 1 for at in _places(h.to_numpy(zero_copy_only=False), bits))
        return pa.array((first & second).astype(bool))

    return F.arrow_udf(passes, "boolean")


FOREST_EDGES = 1 << 21
FEW_EDGES = 1 << 20


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that the edges reach from it), for nodes other than that."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low, new = np.minimum(x, y), root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, root):
            break
        root = new
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _forests(whole: bool):
    """Star forests of a task's edges, of all of them or of ``FOREST_EDGES`` at a time."""

    def run(batches):
        held, size = [], 0

        def close():
            u, v = star_forest(*(np.concatenate([h[c] for h in held]) for c in (0, 1)))
            held.clear()
            return u, v

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("u", "v")))
            size += batch.num_rows
            if size >= FOREST_EDGES:
                u, v = close()
                if whole:
                    held.append((u, v))
                    size = len(u) // 2  # the forest of all nodes so far may be larger than what is read between
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    size = 0
        if held:
            u, v = close()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), the least node.

    Rounds of two steps, checkpointed.  The first gives a node's larger neighbours the node's least
    neighbour (a grouped minimum and a join); edges of hot nodes, such as the centre of a large
    group, stay where they are and meet the minimum by a broadcast of bounded size.  The second
    makes star forests of the edges within tasks, before and after they are dealt by their larger
    node, so that a hot one has no more than an edge per task.  Edges of no more than ``FEW_EDGES``
    are one task's work at once.  Nodes without an edge to another node are not returned.
    """
    p = width(edges.sparkSession)
    stars = lambda e: e.repartition(p, "u").mapInArrow(lean(_forests(True)), "u long, v long")
    first = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = checkpoint(stars(first.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    while e.count() > FEW_EDGES:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        degree = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        state = degree.agg(F.max("up").alias("up"), F.max("n").alias("n"), F.sum("n").alias("rows"), F.max(((F.col("up") > 0) & (F.col("up") < F.col("n"))).cast("int")).alias("chained")).first()
        if (state["up"] or 1) == 1 and not state["chained"]:  # a forest of stars
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count("*").alias("n"))
        near = spread_join(both, least, state["rows"], ["u"]) if state["n"] > hot_above(state["rows"]) else both.join(least.drop("n"), "u")
        e = checkpoint(stars(near.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).mapInArrow(lean(_forests(False)), "u long, v long")))
    else:
        e = checkpoint(e.coalesce(1).mapInArrow(lean(_forests(True)), "u long, v long"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for tables that a job writes and reads again."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"skarn-{os.urandom(8).hex()}")
