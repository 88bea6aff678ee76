"""The search planner: from a query to lanes, fusion, citations and a result.

All token lanes come from one table of weighted frequencies (an index's postings, or one scan of
the texts); each keeps the records of its first paths.  What is left, a few hundred rows, is
checkpointed; paths are ordered from it, and only the records of paths that come out meet texts.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import query as Q
from ..functions import text as T
from ..operators import citation, fusion, graph, lanes
from ..operators.index import SLIM, Index, lexical_records, scan_counts

MODES = ("auto", "lexical", "semantic", "graph")


class SemanticUnavailable(ValueError):
    """Semantic search was asked for and can't be done."""


def candidate_limit(limit: int) -> int:
    return max(100, min(120, limit * 10))


def _cut(rows: DataFrame) -> DataFrame:
    """A few rows that are read many times, by a checkpoint, so that what they come from is planned and run once."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skarn-checkpoint-"))
    return rows.checkpoint()


@dataclass
class Lane:
    """A lane over counted records: who is in it, and by what it is ordered before path, line and id."""

    name: str
    match: Column
    first: Column
    second: Column = field(default_factory=lambda: F.lit(0))


def _score(units: list[int], totals: dict) -> Column:
    """BM25 of some units, with a corpus's totals; the larger the better."""
    out = F.lit(0.0)
    for k in units:
        n, df, f = F.lit(float(totals["n"])), F.lit(float(totals[f"f{k}"] or 0)), F.col(f"f{k}")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(model.BM25_FLOOR))
        out = out + idf * (f * (model.BM25_K1 + 1)) / (f + model.BM25_K1 * (1 - model.BM25_B + model.BM25_B * F.col("tokens") / F.lit(float(totals["average"] or 1))))
    return F.round(out, 9)


def _totals(counted: DataFrame, units: int, where: Column) -> dict:
    row = counted.where(where).agg(F.count("*").alias("n"), F.avg("tokens").alias("average"), *(F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"f{k}") for k in range(units))).first()
    return row.asDict()


def lane_rows(records: DataFrame, plan: Q.Plan, limit: int, extractors: bool = False, index: Index | None = None) -> DataFrame:
    """(lane_id, lane, rank, record_id, path, start_line, kind) of every lane that the query's shape asks for."""
    spark, k = records.sparkSession, candidate_limit(limit)
    literal = plan.match == "text" and Q.is_literal(plan.pattern)
    if plan.match == "text":
        tokens = T.token_list(plan.pattern)
        units = [[t] for t in plan.terms]
        phrases = [] if literal else ([tokens] if len(plan.terms) > 1 else []) + [T.token_list(a) for a in Q.anchors(plan.pattern)]
    else:
        units, phrases = [], []
    every = units + phrases
    text = F.col("text")
    holds = {"fixed": lambda: text.contains(plan.pattern), "regexp": lambda: text.rlike(T.java_regex(plan.pattern)), "text": lambda: T.has_identifier(text, plan.pattern) if Q.is_marked_identifier(plan.pattern) else text.contains(plan.pattern)}[plan.match]
    known = lexical_records(records)
    if index is not None and every:
        counted = index.counts(every)
        if literal:
            counted = counted.where(reduce(or_, (F.col(f"f{i}") > 0 for i in range(len(units))))).join(known.where(holds()).select("record_id", F.lit(True).alias("holds")), "record_id", "left")
    else:
        base = known.withColumn("holds", holds() if literal or plan.match != "text" else F.lit(True))
        counted = scan_counts(base, every) if every else base.withColumn("tokens", F.lit(0)).where("holds")
    counted = _cut(counted.select(*SLIM, "tokens", *(f"f{i}" for i in range(len(every))), *(["holds"] if "holds" in counted.columns else [])))
    terms, other = list(range(len(units))), F.col("kind") != "file"
    found: list[Lane] = []
    if plan.match != "text":
        found.append(Lane(plan.match, F.col("holds") & other, F.lit(0.0)))
    else:
        totals = _totals(counted, len(every), F.lit(True)) if index is None or not literal else _totals(index.counts(every), len(every), F.lit(True))
        some, score = reduce(or_, (F.col(f"f{i}") > 0 for i in terms)), -_score(terms, totals)
        if literal:
            found.append(Lane("literal", some & other & F.col("holds"), score))
        else:
            if len(terms) > 1:
                p = len(units)
                found.append(Lane("exact", F.col(f"f{p}") > 0, -_score([p], totals)))
                found.append(Lane("all-terms", reduce(and_, (F.col(f"f{i}") > 0 for i in terms)), score))
            found.append(Lane("lexical", some, score))
            if extractors:
                mine = F.col("source").startswith("plugin:")
                found.append(Lane("extractor", mine & some, -_score(terms, _totals(counted, len(every), mine))))
            first = len(units) + (len(terms) > 1)
            found += [Lane("anchor", F.col(f"f{i}") > 0, -_score([i], totals)) for i in range(first, len(every))]
    rows = _stacked(counted, found, plan.scope)
    if plan.match == "text" and not literal and (wanted := Q.path_terms(plan.pattern)):
        low = F.lower("path")
        n = reduce(add, (F.when(low.contains(t), 1).otherwise(0) for t in wanted))
        rows = rows.unionByName(_stacked(records.where("kind = 'file'").select(*SLIM), [Lane("path", n > 0, -n.cast("double"), F.length("path"))], plan.scope, len(found)))
    return _cut(_first_paths(rows, k)) if found else spark.createDataFrame([], model.LANE)


def _stacked(counted: DataFrame, found: list[Lane], scope: str, start: int = 0) -> DataFrame:
    entry = [F.when(x.match, F.struct(F.lit(start + i).alias("lane_id"), F.lit(x.name).alias("lane"), x.first.cast("double").alias("k1"), x.second.cast("int").alias("k2"))) for i, x in enumerate(found)]
    out = counted.where(T.in_scope(F.col("path"), scope)).withColumn("e", F.explode(F.array_compact(F.array(*entry))))
    return out.select("e.lane_id", "e.lane", F.struct("e.k1", "e.k2", "path", "start_line", "record_id").alias("key"), "record_id", "path", "start_line", "kind")


def _first_paths(rows: DataFrame, k: int) -> DataFrame:
    """Of each lane the ordered prefix up to the first record of the k-th path, ranked.

    A lane keeps k paths at most, and a path no more records than a file has chunks."""
    firsts = rows.groupBy("lane_id", "path").agg(F.min("key").alias("first"))
    place = F.row_number().over(Window.partitionBy("lane_id").orderBy("first"))
    cut = firsts.withColumn("place", place).where(F.col("place") <= k).groupBy("lane_id").agg(F.max("first").alias("cut"), F.count("*").alias("paths"))
    kept = rows.join(F.broadcast(cut), "lane_id").where((F.col("key") <= F.col("cut")) | (F.col("paths") < k))  # a row per lane
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lane_id").orderBy("key"))).select("lane_id", "lane", "rank", "record_id", "path", "start_line", "kind")


def order_paths(rows: DataFrame) -> list[str]:
    """Paths in final order before the graph's slot: by path score, two roots among the first three, the best record's first.

    The driver sees a row per path of the lanes, some hundreds at most."""
    told = fusion.fuse(rows).select("path", "path_score", "position").collect()
    by_score = [r["path"] for r in sorted(told, key=lambda r: (-r["path_score"], r["path"]))]
    mixed = fusion.promote_third_root(by_score)
    head = [r["path"] for r in told if r["position"] == 1]
    return head + [p for p in mixed if p not in head]


def graph_rows(records: DataFrame, edges: DataFrame, direct: DataFrame, limit: int, scope: str) -> DataFrame:
    """The graph lane: neighbours of the first paths so far, each with the record that tells of it or its first."""
    spark = records.sparkSession
    paths = order_paths(direct)[: model.GRAPH_SEEDS]
    if not paths:
        return spark.createDataFrame([], model.LANE)
    seeds = spark.createDataFrame([(p, i) for i, p in enumerate(paths, 1)], "path string, rank int")
    near = _cut(graph.neighbours(edges, seeds, candidate_limit(limit), scope))
    order = F.struct((F.col("kind") == "file").cast("int").alias("f"), "start_line", "record_id")
    held = lexical_records(records).join(F.broadcast(near.select("path", F.col("record_id").alias("told"))), "path")  # candidate_limit rows
    first = held.groupBy("path").agg(F.min_by(F.struct("record_id", "start_line", "kind"), F.struct((F.col("told").isNull() | (F.col("record_id") != F.col("told"))).cast("int").alias("t"), order.alias("o"))).alias("r"))
    return near.drop("record_id").join(first, "path").select(F.lit(1000).alias("lane_id"), F.lit("graph").alias("lane"), "rank", "r.record_id", "path", "r.start_line", "r.kind")


@dataclass
class SearchResult:
    """What a search gives: cited records, paths beyond them, and how it was done."""

    records: DataFrame
    more_paths: list[str]
    requested_mode: str
    active_mode: str
    fallback_reason: str
    plan: Q.Plan


def search(
    records: DataFrame, pattern: str, match: str = "text", about: str = "", scope: str = "", limit: int = 10, mode: str = "auto", vectors: DataFrame | None = None,
    provider: Callable[[str], list[float]] | None = None, complete: bool = True, edges: DataFrame | None = None, index: Index | None = None,
) -> SearchResult:
    """Searches ``records``; see ``SearchResult``.

    ``vectors`` (record_id, path, start_line, kind, embedding; metadata, if there, may opt out) and
    ``provider``, from a text to its vector, make the semantic lane; ``complete`` says whether every
    record has its vector.  Resolved ``edges`` make the graph lane.  ``index`` saves reading all
    texts.  Where a mode falls back to token lanes, the reason says why; mode ``semantic`` raises."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if not 1 <= limit <= model.MAX_RESULTS:
        raise ValueError(f"limit is from 1 to {model.MAX_RESULTS}")
    plan = Q.plan_query(pattern, match, about, scope)
    literal = plan.match == "text" and Q.is_literal(plan.pattern)
    active, reason, semantic = "lexical", "", None
    rows = records.sparkSession.createDataFrame([], model.LANE) if mode == "semantic" else lane_rows(records, plan, limit, edges is not None, index)
    if mode == "semantic" or (mode == "auto" and not literal):
        why = "semantic-query-empty" if not plan.semantic else "semantic-unconfigured" if provider is None or vectors is None else "semantic-incomplete" if not complete else ""
        vector = None
        if not why:
            try:
                vector = [float(x) for x in provider(plan.semantic)]
            except Exception as e:  # whatever a provider raises is its failure
                why = "semantic-provider-error"
                if mode == "semantic":
                    raise SemanticUnavailable(str(e)) from e
        if why and mode == "semantic":
            raise SemanticUnavailable(why)
        reason = why
        if vector is not None:
            asked = records.sparkSession.createDataFrame([(vector,)], "q array<double>")
            able = vectors.where(T.flag(F.col("metadata"), "semantic", True)) if "metadata" in vectors.columns else vectors
            semantic = lanes.vector_paths(able.where(T.in_scope(F.col("path"), scope)), asked, candidate_limit(limit))
            semantic = _cut(semantic.select(F.lit(999).alias("lane_id"), F.lit("semantic").alias("lane"), "rank", "record_id", "path", "start_line", "kind"))
            active = "semantic" if mode == "semantic" else "hybrid"
    neighbour = None
    if mode == "graph" or (mode == "auto" and edges is not None and (literal or semantic is not None)):
        direct = rows if semantic is None or rows.limit(1).count() else semantic
        near = _cut(graph_rows(records, edges, direct, limit, scope)) if edges is not None else rows.limit(0)
        first = near.orderBy("rank").limit(1).collect()
        neighbour = first[0]["path"] if first else None
        if mode == "graph":
            rows, active = near, "graph"
        else:
            rows = rows.unionByName(near)
            active = "hybrid" if first or not literal else active
    if semantic is not None:
        rows = rows.unionByName(semantic)
    paths = order_paths(rows)[: min(model.MAX_RESULTS, limit + model.OVERFLOW)]
    if mode == "auto" and active == "hybrid" and limit > 1 and neighbour is not None:
        paths = fusion.promote_graph(paths, neighbour, limit)
    return SearchResult(_cited(records, rows, plan, paths[:limit], limit), paths[limit : limit + model.OVERFLOW], mode, active, reason, plan)


def _cited(records: DataFrame, rows: DataFrame, plan: Q.Plan, paths: list[str], limit: int) -> DataFrame:
    """The paths in order, each cited by the best of its records in the lanes; only their records meet texts."""
    shown = records.sparkSession.createDataFrame([(p, i) for i, p in enumerate(paths, 1)], "path string, position int")
    scores = fusion.path_scores(rows).select("path", "path_score")
    candidates = fusion.without_file_records(fusion.lane_scores(rows)).select("record_id", "path", "score", "retrieval")
    candidates = candidates.join(F.broadcast(shown), "path").join(scores, "path").drop("path")  # ``limit`` paths
    named = [c for c in ("title", "source") if c in records.columns]
    texts = records.where(F.col("path").isin(paths)).select("record_id", "path", "start_line", "end_line", "kind", "text", *named).join(F.broadcast(candidates), "record_id")
    told = citation.choose(citation.evidence(texts, Q.evidence_groups(plan.evidence), plan.pattern if Q.is_literal(plan.pattern) else None))
    return citation.localize(told, T.excerpt_limit(limit)).select("position", "path", "record_id", "start_line", "end_line", "kind", *named, F.col("path_score").alias("score"), "retrieval", "excerpt")


def search_records(records: DataFrame, pattern: str, match: str = "text", about: str = "", scope: str = "", limit: int = 10, mode: str = "auto", vectors: DataFrame | None = None, query_vector: list[float] | None = None, edges: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """The cited records of ``search``, with a vector that is there already."""
    provider = None if query_vector is None else lambda _: query_vector
    return search(records, pattern, match, about, scope, limit, mode, vectors, provider, True, edges, index).records


def search_files(files: DataFrame, pattern: str, match: str = "text", about: str = "", scope: str = "", limit: int = 10) -> SearchResult:
    """Searches files(path, kind, content) themselves, where an index is busy or missing.

    Files are ranked by literal, terms of the evidence, terms in the path, line of the evidence, length
    of the path and path; the scope takes whole segments.  Null contents are left out."""
    plan = Q.plan_query(pattern, match, about, scope)
    literal = plan.match == "text" and Q.is_literal(plan.pattern)
    text = F.col("content")
    held = files.where(text.isNotNull() & T.in_segment_scope(F.col("path"), scope))
    before = lambda start: F.size(F.split(start, "\n", -1)) - 1
    sought = plan.pattern if plan.match == "text" else plan.evidence
    told = citation.evidence(held, Q.evidence_groups(sought), plan.pattern if literal else sought if Q.is_literal(sought) else None, "content")
    if plan.match == "fixed":
        told = told.where(text.contains(plan.pattern)).withColumns({"literal_hit": F.lit(True), "evidence_line": before(F.substring_index(text, plan.pattern, 1)), "evidence_terms": F.greatest("evidence_terms", F.lit(1))})
    elif plan.match == "regexp":
        pattern_ = T.java_regex(plan.pattern)
        start = F.regexp_instr(text, F.lit(pattern_))
        told = told.where(text.rlike(pattern_)).withColumns({"evidence_line": before(F.substring(text, F.lit(1), start - 1)), "evidence_terms": F.greatest("evidence_terms", F.lit(1))})
    elif literal:
        told = told.where("literal_hit")
    by_path = plan.match == "text" and not literal
    slim = _cut(told.select("path", "kind", "evidence_line", "evidence_terms", "literal_hit"))  # without texts, and judged once
    if by_path:
        paths = citation.evidence(slim.select("path", F.col("path").alias("p")), Q.evidence_groups(plan.pattern), None, "p")
        slim = slim.join(paths.select("path", F.col("evidence_terms").alias("path_terms")), "path")
    else:
        slim = slim.withColumn("path_terms", F.lit(0))
    order = [F.desc("literal_hit"), F.desc("evidence_terms"), F.desc("path_terms"), F.asc("evidence_line"), F.octet_length("path"), F.asc("path")]
    best = slim.where("evidence_terms > 0 OR path_terms > 0").orderBy(*order).limit(limit + model.OVERFLOW)
    best = _cut(best.withColumn("position", F.row_number().over(Window.orderBy(*order))))
    shown = best.where(F.col("position") <= limit).join(files.select("path", text.alias("text")), "path").withColumns({"title": F.col("path"), "start_line": F.lit(1), "end_line": F.size(F.split("text", "\n", -1))})
    cited = citation.localize(shown, T.excerpt_limit(limit)).withColumn("source", F.lit("filesystem"))
    more = [r["path"] for r in best.where(F.col("position") > limit).orderBy("position").select("path").collect()]
    return SearchResult(cited.drop("text"), more, "auto", "lexical", "index-busy", plan)


def public(records: DataFrame) -> DataFrame:
    """(position, json) of cited records: kind, title and source only where they say something, no score."""
    plain = F.concat("path", F.lit(":"), F.col("start_line").cast("string"))
    shown = {"kind": F.when(F.col("kind") != "text-chunk", F.col("kind")), "title": F.when((F.col("title") != F.col("path")) & (F.col("title") != plain), F.col("title")), "source": F.when(F.col("source") != "core", F.col("source"))}
    fields = [F.col("path"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), *(F.when(c != "", c).alias(n) for n, c in shown.items()), F.col("excerpt")]
    return records.select("position", F.to_json(F.struct(*fields)).alias("json"))


def envelope(command: str, data, **more) -> str:
    """One JSON object for a caller."""
    return json.dumps({"schema": "skarn.cli/v1", "command": command, "data": data} | more, ensure_ascii=False)


def result_json(result: SearchResult) -> str:
    """The envelope of a search."""
    rows = [json.loads(r["json"]) for r in public(result.records).orderBy("position").collect()]
    data = {"requestedMode": result.requested_mode, "activeMode": result.active_mode, "records": rows}
    if result.fallback_reason:
        data["fallbackReason"] = result.fallback_reason
    if result.more_paths:
        data["morePaths"] = result.more_paths
    return envelope("search", data)
