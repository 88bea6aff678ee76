"""Fusion of lanes: reciprocal ranks of records in lanes and of paths in families, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model


def family(lane: Column) -> Column:
    return F.when(lane.isin("semantic", "extractor", "graph"), lane).otherwise(F.lit("lexical"))


def weight(name: Column) -> Column:
    return F.when(name == "extractor", model.EXTRACTOR_WEIGHT).when(name == "graph", model.GRAPH_WEIGHT).otherwise(1.0)


def lane_scores(lanes: DataFrame) -> DataFrame:
    """Record scores from (lane_id, lane, rank, record_id, path, start_line, kind)."""
    share = weight(F.col("lane")) / (model.LANE_K + F.col("rank"))
    return lanes.groupBy("record_id", "path", "start_line", "kind").agg(F.round(F.sum(share), 12).alias("score"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("retrieval"))


def path_scores(lanes: DataFrame) -> DataFrame:
    """Path scores: a path's best record votes in each lane, votes add up in a family, families fuse by rank."""
    best = lanes.groupBy("lane_id", "lane", "path").agg(F.min("rank").alias("rank"))
    voted = best.withColumn("family", family(F.col("lane"))).groupBy("family", "path").agg(F.round(F.sum(weight(F.col("lane")) / (model.LANE_K + F.col("rank"))), 12).alias("votes"))
    placed = voted.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("votes"), "path")))
    return placed.groupBy("path").agg(F.round(F.sum(weight(F.col("family")) / (model.FAMILY_K + F.col("place"))), 12).alias("path_score"))


def without_file_records(records: DataFrame) -> DataFrame:
    """A path's file record goes if the path has another record."""
    other = F.max((F.col("kind") != "file").cast("int")).over(Window.partitionBy("path"))
    return records.withColumn("_o", other).where("_o = 0 OR kind <> 'file'").drop("_o")


def with_path_evidence(records: DataFrame, lanes: DataFrame) -> DataFrame:
    """The path lane's score goes to the path's best other record, else stays with the file record."""
    from_path = lanes.where("lane = 'path'").groupBy("path").agg(F.round(F.sum(1.0 / (model.LANE_K + F.col("rank"))), 12).alias("_extra"))
    order = Window.partitionBy("path").orderBy((F.col("kind") == "file").cast("int"), F.desc("score"), "start_line", "record_id")
    placed = records.withColumn("_n", F.row_number().over(order)).join(from_path, "path", "left")
    gains = (F.col("_n") == 1) & (F.col("kind") != "file") & F.col("_extra").isNotNull()
    return placed.withColumn("score", F.round(F.col("score") + F.when(gains, F.col("_extra")).otherwise(0.0), 12)).drop("_n", "_extra")


def fuse(lanes: DataFrame) -> DataFrame:
    """One row per path in final order before diversity: (position, path, record_id, score, path_score, retrieval).

    The path of the best record comes first; the others follow by path score."""
    records = without_file_records(with_path_evidence(lane_scores(lanes), lanes))
    order = Window.partitionBy("path").orderBy(F.desc("score"), "start_line", "record_id")
    best = records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").join(path_scores(lanes), "path")
    head = best.agg(F.min_by("path", F.struct(-F.col("score"), "path", "start_line", "record_id")).alias("_head"))
    led = best.crossJoin(F.broadcast(head))
    place = F.row_number().over(Window.orderBy((F.col("path") != F.col("_head")).cast("int"), F.desc("path_score"), "path"))
    return led.withColumn("position", place).select("position", "path", "record_id", "start_line", "kind", "score", "path_score", "retrieval")


def root(path: str) -> str:
    return path.split("/", 1)[0] if "/" in path else "."


def promote_third_root(items: list, key=lambda x: x) -> list:
    """If the first two share a root, the first later one of another root comes third."""
    if len(items) > 3 and root(key(items[0])) == root(key(items[1])):
        for k in range(2, len(items)):
            if root(key(items[k])) != root(key(items[0])):
                return [*items[:2], items[k], *items[2:k], *items[k + 1 :]]
    return items


def root_diversity(ordered: DataFrame) -> DataFrame:
    """The same over rows (position, path), as windows: positions change, rows stay."""
    r = F.when(F.col("path").contains("/"), F.split("path", "/")[0]).otherwise(F.lit("."))
    w = ordered.withColumn("_r", r)
    facts = w.agg(F.max(F.when(F.col("position") == 1, F.col("_r"))).alias("_a"), F.max(F.when(F.col("position") == 2, F.col("_r"))).alias("_b"))
    w = w.crossJoin(F.broadcast(facts))
    third = w.where("position >= 3 AND _r <> _a").agg(F.min("position").alias("_p"))
    w = w.crossJoin(F.broadcast(third))
    moved = F.when((F.col("_a") != F.col("_b")) | F.col("_p").isNull(), F.col("position")).when(F.col("position") == F.col("_p"), 3).when((F.col("position") >= 3) & (F.col("position") < F.col("_p")), F.col("position") + 1).otherwise(F.col("position"))
    return w.withColumn("position", moved.cast("int")).drop("_r", "_a", "_b", "_p")


def promote_graph(items: list, neighbour, limit: int, key=lambda x: x) -> list:
    """The strongest neighbour takes the last of the first ten places, unless it stands as high already.

    What stood there goes to the end, or to the overflow's end if there are more."""
    target = min(limit, 10) - 1
    if target < 1:
        return items
    at = next((k for k, x in enumerate(items) if key(x) == key(neighbour)), None)
    if at is not None and at <= target or target >= len(items) + (at is None):
        return items
    rest = [x for k, x in enumerate(items) if k != at]
    if target >= len(rest):
        return [*rest, neighbour]
    displaced = rest[target]
    out = [*rest[:target], neighbour, *rest[target + 1 :], displaced]
    last = target + model.OVERFLOW
    if len(out) - 1 > last:
        out[last], out[-1] = out[-1], out[last]
    return out
