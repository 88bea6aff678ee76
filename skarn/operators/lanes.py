"""Retrieval lanes: ordered candidates (record_id, path, ..., rank), limited by distinct paths."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T

NEED_ALL, NEED_ANY, NEED_PHRASE = "all", "any", "phrase"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(tokens: Column, terms: list[str]) -> Column:
    """Places where the terms stand consecutively."""
    n = len(terms)
    if n == 1:
        return F.size(F.filter(tokens, lambda x: x == terms[0]))
    starts = F.filter(F.transform(tokens, lambda x, i: F.when(x == terms[0], i)), lambda i: i.isNotNull())
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i + 1, n) == F.array(*map(F.lit, terms))))


def bm25(records: DataFrame, terms: list[str], need: str = NEED_ANY, weights: dict[str, float] | None = None) -> DataFrame:
    """``records`` that match, with score.  Statistics are those of all ``records``.

    One scan counts each term per column; the corpus's counts are one small row, joined back.
    A frequency is weighted by column, length is all columns' tokens, and inverse document
    frequency has a small floor.  A phrase counts as one term.
    """
    weights = weights or model.COLUMN_WEIGHTS
    units = [terms] if need == NEED_PHRASE else [[t] for t in dict.fromkeys(terms)]
    columns = list(weights)
    counts = lambda c: _let(T.tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.array(F.size(t), *(_count(t, u) for u in units)))
    tokened = records.withColumns({f"_c_{c}": counts(c) for c in columns})
    length = reduce(add, (F.col(f"_c_{c}")[0] for c in columns))
    found = {f"_f{k}": reduce(add, (F.col(f"_c_{c}")[k + 1] * F.lit(float(weights[c])) for c in columns)) for k in range(len(units))}
    counted = tokened.withColumns({"_d": length, **found}).drop(*(f"_c_{c}" for c in columns))
    corpus = counted.agg(F.count("*").alias("_n"), F.avg("_d").alias("_avg"), *(F.sum((F.col(f) > 0).cast("long")).alias(f"_df{k}") for k, f in enumerate(found)))
    scored = counted.crossJoin(F.broadcast(corpus))  # one row
    total = F.lit(0.0)
    for k in range(len(units)):
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5)), F.lit(model.BM25_FLOOR))
        f = F.col(f"_f{k}")
        total = total + idf * (f * (model.BM25_K1 + 1)) / (f + model.BM25_K1 * (1 - model.BM25_B + model.BM25_B * F.col("_d") / F.col("_avg")))
    hits = [F.col(f"_f{k}") > 0 for k in range(len(units))]
    ok = reduce((lambda a, b: a & b) if need == NEED_ALL else (lambda a, b: a | b), hits)
    return scored.where(ok).withColumn("score", F.round(total, 9)).select(*(F.col(c) for c in records.columns), "score")


def ranked(found: DataFrame, *order: Column) -> DataFrame:
    """Explicit ranks in a total order, for few rows: a window that one task sees whole."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ranked_widely(found: DataFrame, *order: Column) -> DataFrame:
    """The same for any number of rows: a sort by ranges, kept by a checkpoint, and offsets of its partitions."""
    from ..plans.search import _cut

    laid = _cut(found.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = laid.groupBy("_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))  # a row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_n")
    out = laid.join(F.broadcast(offsets), "_p").withColumn("rank", (F.col("_i") - F.col("_first") + F.col("_before") + 1).cast("int"))
    return out.drop("_p", "_i", "_first", "_before")


def top(found: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of an order, ranked; only ``limit`` rows per task meet in one."""
    return ranked(found.orderBy(*order).limit(limit), *order)


SCORE_KEYS = (("score", True), ("path", False), ("start_line", False), ("record_id", False))
PATH_KEYS = (("path", False), ("start_line", False), ("record_id", False))


def distinct_path_top(found: DataFrame, limit: int, *order: tuple[str, bool]) -> DataFrame:
    """The ordered prefix up to and with the first record of the ``limit``-th path; all if there are fewer.

    ``order`` are (column, descending), descending for numbers only.  The cut is the greatest key
    among the ``limit`` paths that come first, found by grouped minima, so no window spans all
    candidates."""
    key = F.struct(*((-F.col(c) if down else F.col(c)).alias(f"k{i}") for i, (c, down) in enumerate(order)))
    keyed = found.withColumn("_key", key)
    firsts = keyed.groupBy("path").agg(F.min("_key").alias("_first")).orderBy("_first").limit(limit)
    cut = firsts.agg(F.max("_first").alias("_cut"), F.count("*").alias("_paths"))
    kept = keyed.crossJoin(F.broadcast(cut)).where((F.col("_key") <= F.col("_cut")) | (F.col("_paths") < limit)).drop("_key", "_cut", "_paths")  # one row
    return ranked(kept, *(F.desc(c) if down else F.asc(c) for c, down in order))


def fixed(records: DataFrame, literal: str) -> DataFrame:
    return records.where((F.col("kind") != "file") & F.col("text").contains(literal))


def literal(records: DataFrame, pattern: str, terms: list[str], identifier: bool) -> DataFrame:
    """Token-index hits that hold the literal itself, bounded as an identifier if it is one."""
    out = bm25(records, terms).where((F.col("kind") != "file") & F.col("text").contains(pattern))
    return out.where(T.has_identifier(F.col("text"), pattern)) if identifier else out


def regexp(records: DataFrame, pattern: str) -> DataFrame:
    return records.where((F.col("kind") != "file") & F.col("text").rlike(T.java_regex(pattern)))


def path_matches(records: DataFrame, terms: list[str]) -> DataFrame:
    """Records by how many terms their path holds."""
    low = F.lower("path")
    n = reduce(add, (F.when(low.contains(t.lower()), 1).otherwise(0) for t in terms), F.lit(0))
    return records.withColumn("matches", n).where("matches > 0")


def by(keys: tuple[tuple[str, bool], ...]) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in keys]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def similarities(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """``vectors`` with their similarity to the one row of ``query`` (column q)."""
    return vectors.crossJoin(F.broadcast(query)).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("q")), 9)).where("similarity IS NOT NULL").drop("q")


def vector_top(vectors: DataFrame, query: DataFrame, limit: int) -> DataFrame:
    """The vectors nearest to the one row of ``query`` (column q): exact, filtered before it is ranked."""
    return top(similarities(vectors, query), limit, F.desc("similarity"), F.asc("record_id"))


def vector_paths(vectors: DataFrame, query: DataFrame, limit: int) -> DataFrame:
    """The same up to the first record of the ``limit``-th path."""
    return distinct_path_top(similarities(vectors, query), limit, ("similarity", True), ("record_id", False))
