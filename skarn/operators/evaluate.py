"""Retrieval metrics over results(case_id, path, rank) and truth(case_id, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_paths(results: DataFrame) -> DataFrame:
    """One row per path, at its first rank among distinct paths."""
    first = results.groupBy("case_id", "path").agg(F.min("rank").alias("rank"))
    from pyspark.sql import Window

    return first.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "path")))


def case_metrics(results: DataFrame, truth: DataFrame) -> DataFrame:
    """recall_at_10, mrr (within 20) and noise_at_20 of every case with truth."""
    t = truth.select("case_id", "path").distinct()
    sizes = t.groupBy("case_id").agg(F.count("*").alias("n"))
    got = unique_paths(results).where("rank <= 20").join(t.withColumn("hit", F.lit(1)), ["case_id", "path"], "left")
    sums = got.groupBy("case_id").agg(
        F.sum(F.when((F.col("rank") <= 10) & F.col("hit").isNotNull(), 1).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"),
        F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)).alias("noise"),
    )
    return sizes.join(sums, "case_id", "left").select(
        "case_id",
        F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 9).alias("recall_at_10"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("mrr"),
        F.round(F.coalesce("noise", F.lit(0.0)), 9).alias("noise_at_20"),
    )


def nearest_rank(value: Column, q: float) -> Column:
    """The smallest value that at least a share ``q`` of the values doesn't exceed."""
    a = F.array_sort(F.collect_list(value))
    return F.element_at(a, F.greatest(F.ceil(F.lit(q) * F.size(a)).cast("int"), F.lit(1)))


def percentile(value: str, q: float) -> Column:
    """The same without gathering values: percentile_disc is a nearest rank."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def by_class(scored: DataFrame) -> DataFrame:
    """Means per retrieval class and mode."""
    return scored.groupBy("class", "mode").agg(F.round(F.avg("recall_at_10"), 9).alias("recall_at_10"), F.round(F.avg("mrr"), 9).alias("mrr"), F.count("*").alias("cases"))


def token_counts(records: DataFrame, words: list[str]) -> DataFrame:
    """Per path the matches of all tokens, without case: the baseline."""
    from functools import reduce
    from operator import add

    from ..functions.text import quote

    n = reduce(add, (F.regexp_count(F.lower("text"), F.lit(quote(w.lower()))) for w in words))
    return records.groupBy("path").agg(F.sum(n).cast("long").alias("matches")).where("matches > 0")


def citation_rate(results: DataFrame) -> DataFrame:
    ok = (F.col("path") != "") & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line"))
    return results.agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 9).alias("citation_rate"))


def expected_best(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, measured, supported) of scored(case_id, mode, recall_at_10, mrr) and expected(case_id, mode)."""
    best = scored.groupBy("case_id").agg(F.max(F.struct("recall_at_10", "mrr")).alias("best"))
    mine = expected.join(scored, ["case_id", "mode"]).groupBy("case_id").agg(F.max(F.struct("recall_at_10", "mrr")).alias("own"))
    joined = expected.select("case_id").distinct().join(best, "case_id", "left").join(mine, "case_id", "left")
    return joined.select("case_id", F.col("own").isNotNull().alias("measured"), F.coalesce((F.col("own") == F.col("best")) & ((F.col("best.recall_at_10") > 0) | (F.col("best.mrr") > 0)), F.lit(False)).alias("supported"))


def path_ranks(expected: DataFrame, retrieval: DataFrame, measured: DataFrame) -> DataFrame:
    """(case_id, path, mode, rank) of expected(case_id, path) in retrieval(case_id, mode, path, rank).

    measured(case_id, mode) has what was run: rank is 0 for a path that a mode did not find, and
    null where the mode was not run but for some other case."""
    modes = measured.select("mode").distinct()
    asked = expected.select("case_id", "path").distinct().join(F.broadcast(modes), how="cross")  # a handful of modes
    ran = measured.select("case_id", "mode").distinct().withColumn("ran", F.lit(True))
    first = retrieval.groupBy("case_id", "mode", "path").agg(F.min("rank").alias("found"))
    joined = asked.join(ran, ["case_id", "mode"], "left").join(first, ["case_id", "mode", "path"], "left")
    return joined.select("case_id", "path", "mode", F.when(F.col("ran"), F.coalesce("found", F.lit(0))).cast("int").alias("rank"))
