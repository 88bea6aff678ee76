"""Import edges: building, resolution of relative targets, one hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T

#: Extensions that a target may lack, in the order in which they are tried.
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".go", ".py"]


def edges(records: DataFrame) -> DataFrame:
    """(source_path, relation, target, record_id) of import and export records of extractors."""
    keep = F.col("source").startswith("plugin:") & (F.col("kind").endswith("-import") | F.col("kind").endswith("-export")) & (F.coalesce("title", F.lit("")) != "")
    relation = F.when(F.col("kind").endswith("-import"), "import").otherwise("export")
    found = records.where(keep & ~T.flag(F.col("metadata"), "structural", False))
    return found.select(F.col("path").alias("source_path"), relation.alias("relation"), F.col("title").alias("target"), "record_id").dropDuplicates(["record_id", "relation", "target"])


def clean(path: Column) -> Column:
    """A relative path without empty, ``.`` and resolvable ``..`` segments."""
    step = lambda s, x: F.when(x.isin("", "."), s).when((x == "..") & (F.size(s) > 0) & (F.element_at(s, -1) != ".."), F.slice(s, 1, F.size(s) - 1)).otherwise(F.concat(s, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def candidates(source: Column, target: Column) -> Column:
    """Paths that a relative target may mean, the most likely first."""
    base = clean(F.concat(F.regexp_replace(source, "[^/]*$", ""), F.regexp_replace(target, r"[?#].*$", "")))
    stem = F.regexp_replace(base, r"\.[^./]*$", "")
    own = F.regexp_extract(source, r"(\.[^./]*)$", 1)
    ends = F.concat(F.filter(F.array(own), lambda e: e != ""), F.array(*map(F.lit, SUFFIXES)))
    return F.concat(F.array(base), F.flatten(F.transform(ends, lambda e: F.array(F.concat(stem, e), F.concat(base, F.lit("/index"), e)))))


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` with target_path: the first candidate that is a file; null for other targets.

    Two equi-joins on paths and a grouped minimum."""
    relative = found.where(F.col("target").startswith(".")).select("source_path", "target").distinct()
    asked = relative.select("source_path", "target", F.posexplode(candidates(F.col("source_path"), F.col("target"))).alias("ordinal", "path"))
    hit = asked.join(files.select("path").distinct(), "path").groupBy("source_path", "target").agg(F.min_by("path", "ordinal").alias("target_path"))
    return found.join(hit, ["source_path", "target"], "left")


def one_hop(resolved: DataFrame, seeds: DataFrame, scope: str = "") -> DataFrame:
    """Neighbours (path, score, record_id) of seeds(path, rank): the better of an edge's two directions.

    A neighbour that imports a seed is cited by the importing record; the least record_id of equals."""
    real = resolved.where(F.col("target_path").isNotNull() & (F.col("target_path") != F.col("source_path")))
    s = F.broadcast(seeds.select(F.col("path").alias("seed"), "rank"))  # at most GRAPH_SEEDS rows
    share = model.EDGE_WEIGHT / (model.LANE_K + F.col("rank"))
    importing = real.join(s, real.target_path == F.col("seed")).select(F.col("source_path").alias("path"), share.alias("score"), "record_id")
    imported = real.join(s, real.source_path == F.col("seed")).select(F.col("target_path").alias("path"), share.alias("score"), F.lit(None).cast("long").alias("record_id"))
    both = importing.unionByName(imported).where(T.in_segment_scope(F.col("path"), scope)).join(s.select(F.col("seed").alias("path")), "path", "left_anti")
    best = both.groupBy("path").agg(F.round(F.max("score"), 12).alias("score"), F.min(F.struct((-F.col("score")).alias("s"), F.coalesce("record_id", F.lit((1 << 63) - 1)).alias("r"))).alias("b"))
    return best.select("path", "score", F.nullif(F.col("b.r"), F.lit((1 << 63) - 1)).alias("record_id"))


def neighbours(resolved: DataFrame, seeds: DataFrame, limit: int, scope: str = "") -> DataFrame:
    found = one_hop(resolved, seeds, scope).orderBy(F.desc("score"), "path").limit(limit)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
