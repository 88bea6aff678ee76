"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample: each node splits its sample by the plane midway between two
random members.  Every row is then sent to its leaf in each tree.  A query walks all trees through
one priority queue, by the squared distance to the planes it has crossed, until the leaves taken
hold a set number of sample points; the candidates of those leaves are reranked by the exact
inner product in double precision.  The scores of the sample points in those leaves, which are
candidates themselves, bound what is worth sending on.  Largest inner product becomes nearest direction by one more coordinate that gives all
indexed vectors one length.  Equal vectors are indexed once, with the least ids that a
result can need; results expand to them.  Leaves are never cut off: one with many rows is dealt
out in chunks, and its queries in blocks, so that a task holds a chunk and a block at a time.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint

LEAF = 48
LEAVES = 96
CHUNK_ROWS, BLOCK_QUERIES = 50_000, 20_000


class Tree:
    """Planes of inner nodes in arrays; children below zero are leaves (-1 - leaf)."""

    def __init__(self, sample: np.ndarray, seed: int):
        r = np.random.default_rng(seed)
        self.normal, self.offset, self.child, self.size = [], [], [], []

        self.home = np.zeros(len(sample), np.int64)
        most = max(LEAF, len(sample) // LEAVES)

        def grow(rows: np.ndarray, depth: int) -> int:
            if len(rows) > most and depth < 40:
                for _ in range(5):
                    a, b = sample[r.choice(rows, 2, replace=False)]
                    normal = (a - b) / max(np.linalg.norm(a - b), 1e-12)
                    offset = float(normal @ (a + b) / 2)
                    left = sample[rows] @ normal < offset
                    if 0 < left.sum() < len(rows):
                        at = len(self.normal)
                        self.normal.append(normal)
                        self.offset.append(offset)
                        self.child.append([0, 0])
                        self.child[at] = [grow(rows[left], depth + 1), grow(rows[~left], depth + 1)]
                        return at
            self.home[rows] = len(self.size)
            self.size.append(len(rows))
            return -len(self.size)

        self.root = grow(np.arange(len(sample)), 0)
        self.normal = np.array(self.normal).reshape(-1, sample.shape[1])
        self.offset = np.array(self.offset)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.normal[node]) >= self.offset[node]).astype(np.int64)
            at[inner] = self.child[node, side]
        return -1 - at


class Forest:
    def __init__(self, sample: np.ndarray, top: float, trees: int, seed: int = 3):
        self.top = top
        lifted = self.lift(sample)
        self.trees = [Tree(lifted, seed + t) for t in range(trees)]
        self.sample = sample

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))[:, None]])

    def search(self, q: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) pairs, by one queue over all trees, until they hold ``enough`` sample points."""
        length = np.linalg.norm(q)
        q = np.append(q / length if length else q, 0.0) * np.sqrt(self.top)
        queue = [(0.0, t, tree.root) for t, tree in enumerate(self.trees)]
        margins = [tree.normal @ q - tree.offset if len(tree.offset) else np.zeros(0) for tree in self.trees]
        heapq.heapify(queue)
        out, got = [], 0
        while queue and got < enough:
            key, t, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[t][node]
                near, far = self.trees[t].child[node][:: -1 if m >= 0 else 1]
                heapq.heappush(queue, (key + m * m, t, int(far)))
                node = int(near)
            out.append((t, -1 - node))
            got += self.trees[t].size[-1 - node]
        return out

    def bound(self, q: np.ndarray, taken: list[tuple[int, int]], k: int) -> float:
        """A score that the k + 1 best sample points of the taken leaves reach."""
        seen = np.zeros(len(self.sample), bool)
        for t, tree in enumerate(self.trees):
            mine = np.zeros(len(tree.size), bool)
            mine[[n for s, n in taken if s == t]] = True
            seen |= mine[tree.home]
        z = self.sample[seen] @ q
        return float(np.partition(z, -(k + 1))[-(k + 1)]) - 1e-9 if len(z) > k else -np.inf


def _place(forest: Forest):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            lifted = forest.lift(x)
            for t, tree in enumerate(forest.trees):
                leaf = tree.leaves(lifted)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(leaf, pa.int32()), batch.column("ids"), batch.column("v")], names=["tree", "leaf", "ids", "v"])

    return run


def _count(forest: Forest):
    """Rows of each leaf."""

    def run(batches):
        total = [np.zeros(len(t.size), np.int64) for t in forest.trees]
        for batch in batches:
            lifted = forest.lift(_matrix(batch.column("v")))
            for t, tree in enumerate(forest.trees):
                total[t] += np.bincount(tree.leaves(lifted), minlength=len(tree.size))
        rows = [(t, n, int(c)) for t, counts in enumerate(total) for n, c in enumerate(counts) if c]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["tree", "leaf", "n"])

    return run


def _ask(forest: Forest, enough: int, k: int):
    def run(batches):
        for batch in batches:
            x, rows, tree, leaf, bound = _matrix(batch.column("v")), [], [], [], []
            for i, q in enumerate(x):
                taken = forest.search(q, enough)
                least = forest.bound(q, taken, k)
                for t, n in taken:
                    rows.append(i)
                    tree.append(t)
                    leaf.append(n)
                    bound.append(least)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), batch.column("query_id").take(rows), batch.column("v").take(rows), pa.array(bound, pa.float64())], names=["tree", "leaf", "query_id", "v", "bound"])

    return run


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _score(k: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        query, ids, score = [], [], []
        if index.num_rows and asked.num_rows:
            x, q = _matrix(index.column("v")), _matrix(asked.column("v"))
            members, first = index.column("ids").to_pylist(), np.array([i[0] for i in index.column("ids").to_pylist()])
            names, bound = asked.column("query_id").to_pylist(), asked.column("bound").to_numpy()
            for a in range(0, len(q), 256):
                z = q[a : a + 256] @ x.T
                for r in range(len(z)):
                    least = max(bound[a + r], np.partition(z[r], -(k + 1))[-(k + 1)] if len(x) > k else -np.inf)
                    near = np.flatnonzero(z[r] >= least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else np.ones(len(x), bool))
                    # The scores that count are sums of their own: those of the product depend on what else was in it.
                    exact = (x[near] * q[a + r]).sum(1)
                    best = np.lexsort((first[near], -exact))[: k + 1]
                    query += [names[a + r]] * len(best)
                    ids += [members[n] for n in near[best]]
                    score += exact[best].tolist()
        return pa.table({"query_id": pa.array(query, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "score": pa.array(score, pa.float64())})

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 4, sample: int = 20_000, effort: float = 1.0) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its ``k`` nearest.

    ``vectors`` has vec_id (integer) and embedding; other columns are ignored.  Nearness is the
    inner product in double precision, ties go to the smaller vec_id; a query's own vec_id is no
    candidate.  Rows without vec_id take no part, nor vectors that are null, empty, zero or
    hold null or non-finite components, nor those of another length than the most frequent.
    Repeated rows count once.  ``sample`` bounds the vectors that trees are fitted on;
    ``effort`` is how many sample points a query's leaves hold over all trees, as a multiple of the
    sample (at most ``trees``); vectors without structure need about 1 for a recall over 0.9.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    lengths = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    v = v.where(F.size("embedding") == lengths["n"]).distinct()
    numbered = v.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = checkpoint(numbered.groupBy(F.col("embedding").alias("v")).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = classes.agg(F.max(norm).alias("m")).first()["m"]
    rows = bounded_sample(classes.select("v"), sample, "v").collect()  # ``sample`` rows: a stated bound
    forest = Forest(np.array([r["v"] for r in rows]), top, trees)
    enough = int(max(effort * len(rows), min(len(rows) * trees, 40 * k)))
    kind = vectors.schema["embedding"].dataType.simpleString()
    index = classes.mapInArrow(_place(forest), f"tree int, leaf int, ids array<long>, v {kind}")
    asked = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")).mapInArrow(_ask(forest, enough, k), f"tree int, leaf int, query_id long, v {kind}, bound double")
    leaves = classes.select("v").mapInArrow(_count(forest), "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()  # a row per leaf
    queries = v.where(F.col("vec_id") % every == 0).count()
    chunks = spark.createDataFrame([(r["tree"], r["leaf"], -(-r["n"] // CHUNK_ROWS)) for r in leaves], "tree int, leaf int, chunks int")
    blocks = F.lit(max(1, -(-queries // BLOCK_QUERIES)))
    index = index.join(F.broadcast(chunks), ["tree", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("ids"), "chunks").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    asked = asked.join(F.broadcast(chunks), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    place = ["tree", "leaf", "chunk", "block"]
    found = index.drop("chunks").groupBy(*place).cogroup(asked.drop("chunks").groupBy(*place)).applyInArrow(_score(k), "query_id long, ids array<long>, score double")
    pairs = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
