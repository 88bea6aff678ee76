"""Evidence lines, citation choice and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query import is_marked_identifier

PRIORITY = {"fixed": 0, "regexp": 1, "literal": 2, "exact": 3, "all-terms": 4, "anchor": 5, "extractor": 6, "lexical": 7}


GROUPS = 60


def _hit(line: Column, group: list[str]) -> Column:
    """Whether one of the terms is a token of the line, without case."""
    return line.rlike(r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(map(T.quote, group)) + r")(?![\p{L}\p{N}])")


def _mask(groups: list[list[str]]):
    """From a line to the groups that it holds, as bits."""
    return lambda line: reduce(Column.__add__, (F.when(_hit(line, g), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, g in enumerate(groups)))


def evidence(records: DataFrame, groups: list[list[str]], literal: str | None = None, text: str = "text") -> DataFrame:
    """``records`` with evidence_line (0-based; -1 without evidence), evidence_terms and literal_hit.

    The first line with the literal, bounded as an identifier if it is one; else the line whose two
    neighbours on each side hold the most term groups with it, the earliest of equals.  A term is
    a token of a line or a part of one.  Lines hold their groups as bits; no shuffle."""
    content = F.coalesce(F.col(text), F.lit(""))
    with_lines = records.withColumn("_lines", F.split(content, "\n", -1))
    both = with_lines.withColumn("_both", F.zip_with("_lines", F.split(T.camel_spaced(content), "\n", -1), lambda a, b: F.concat(a, F.lit(" "), b)))
    masks = []
    for k in range(0, len(groups), GROUPS):
        both = both.withColumn(f"_m{k}", F.transform("_both", _mask(groups[k : k + GROUPS])))
        masks.append(f"_m{k}")
    near = lambda m, i: reduce(Column.bitwiseOR, (F.coalesce(F.get(m, i + d), F.lit(0).cast("long")) for d in (-2, -1, 0, 1, 2)))
    score = F.transform("_lines", lambda _, i: reduce(Column.__add__, (F.bit_count(near(F.col(m), i)) for m in masks))) if masks else F.transform("_lines", lambda _: F.lit(0))
    scored = both.withColumn("_score", score)
    best = F.array_max("_score")
    at = F.array_position("_score", best).cast("int") - 1
    out = scored.withColumn("evidence_terms", best).withColumn("evidence_line", F.when(best > 0, at).otherwise(-1))
    if literal:
        holds = (lambda x: T.has_identifier(x, literal)) if is_marked_identifier(literal) else (lambda x: x.contains(literal))
        first = F.array_position(F.transform("_lines", holds), True).cast("int") - 1
        out = out.withColumn("literal_hit", first >= 0).withColumn("evidence_line", F.when(first >= 0, first).otherwise(F.col("evidence_line")))
        out = out.withColumn("evidence_terms", F.when(F.col("literal_hit"), 1).otherwise(F.col("evidence_terms")))
    else:
        out = out.withColumn("literal_hit", F.lit(False))
    return out.drop("_lines", "_both", "_score", *masks)


def choose(candidates: DataFrame) -> DataFrame:
    """One record per path: literal, then more terms, then lane, line of the evidence, score and id; the first by line without terms."""
    first = F.when(F.col("kind") == "file", 1).otherwise(0)
    priority = F.coalesce(*(F.when(F.array_contains(F.split("retrieval", ","), lane), p) for lane, p in sorted(PRIORITY.items(), key=lambda x: x[1])), F.lit(8))
    some = F.coalesce(F.col("evidence_terms"), F.lit(0)) > 0
    by = (F.when(some, priority), F.col("start_line") + F.when(some, F.col("evidence_line")).otherwise(0), F.when(some, -F.col("score")))
    order = Window.partitionBy("path").orderBy(first, F.desc("literal_hit"), F.desc("evidence_terms"), *by, "record_id")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def localize(chosen: DataFrame, limit: int) -> DataFrame:
    """Citation (start_line, end_line, title, excerpt): the window from two lines above the evidence.

    Records without evidence, and those that sum up a longer range of lines, are cited as they
    are.  A title that is the path and first line follows the window."""
    lines = F.split("text", "\n", -1)
    whole = (F.col("evidence_terms") == 0) | (F.col("evidence_line") < 0) | (F.col("end_line") - F.col("start_line") + 1 < F.size(lines))
    skip = F.when(whole, 0).otherwise(F.greatest(F.col("evidence_line") - 2, F.lit(0)))
    cited = chosen.withColumns({"_skip": skip, "_whole": whole})
    cited = cited.withColumn("excerpt", T.excerpt(F.array_join(F.slice(lines, F.col("_skip") + 1, F.size(lines)), "\n"), limit))
    start = F.col("start_line") + F.col("_skip")
    end = F.when(F.col("_whole"), F.col("end_line")).otherwise(F.least(F.col("end_line"), start + F.size(F.split("excerpt", "\n", -1)) - 1))
    if "title" in chosen.columns:
        named = lambda at: F.concat("path", F.lit(":"), at.cast("string"))
        cited = cited.withColumn("title", F.when(F.col("title") == named(F.col("start_line")), named(start)).otherwise(F.col("title")))
    return cited.withColumns({"end_line": end, "start_line": start}).drop("_skip", "_whole")
