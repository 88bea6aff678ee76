"""More named queries with SQL twins: query analysis, extractors on synthetic files, citations, snapshots, evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model
from ..functions import query as Q
from ..functions import text as T
from ..operators import citation, embedding, evaluate, extractors, fusion, graph, lanes, snapshot
from ..sources.tables import document_files, table
from . import search as S
from . import suite
from .queries import _LANES_SQL, _lanes, _records, query

WORD = r"[\p{L}\p{N}]+"
#: Patterns of several shapes, by rule from the parts' names.
_PATTERNS_SQL = """
patterns AS (
  SELECT p_partkey, CASE p_partkey % 8
    WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN upper(p_name[1]) || replace(substr(p_name, 2), ' ', '')
    WHEN 3 THEN 'get' || upper(split_part(p_name, ' ', 1)[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || p_brand || ' ' || lower(p_type)
    WHEN 4 THEN replace(p_name, ' ', '_') || ' ' || p_brand WHEN 5 THEN p_brand || ' ' || p_brand || ' of ' || p_name WHEN 6 THEN '  ' || p_type || ', ' || p_name || '! ' ELSE 'HTTP' || upper(p_name[1]) || substr(p_name, 2) || '2x' END AS pattern
  FROM part)"""


def _patterns(spark, sf):
    n, k = F.col("p_name"), F.col("p_partkey") % 8
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1000))
    first = F.split(n, " ")[0]
    shapes = [n, F.replace(n, F.lit(" "), F.lit("-")), F.replace(cap(n), F.lit(" "), F.lit("")), F.concat(F.lit("get"), cap(first), F.lit(" "), "p_brand", F.lit(" "), F.lower("p_type")), F.concat(F.replace(n, F.lit(" "), F.lit("_")), F.lit(" "), "p_brand"), F.concat("p_brand", F.lit(" "), "p_brand", F.lit(" of "), n), F.concat(F.lit("  "), "p_type", F.lit(", "), n, F.lit("! ")), F.concat(F.lit("HTTP"), cap(n), F.lit("2x"))]
    out = shapes[-1]
    for i, s in reversed(list(enumerate(shapes[:-1]))):
        out = F.when(k == i, s).otherwise(out)
    return table(spark, sf, "part").select("p_partkey", out.alias("pattern"))


def _told(patterns, columns: dict):
    """Facts of patterns that the driver's functions tell, by column name."""
    schema = "p_partkey long, pattern string, " + ", ".join(f"{c} string" for c in columns)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"p_partkey": f["p_partkey"], "pattern": f["pattern"]} | {c: f["pattern"].map(g) for c, g in columns.items()})

    return patterns.select(F.col("p_partkey").cast("long").alias("p_partkey"), "pattern").mapInPandas(run, schema)


_FIRST_OF = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(rf"""WITH {_PATTERNS_SQL}, t AS (SELECT p_partkey, pattern, regexp_extract_all(pattern, '{WORD}') AS w FROM patterns)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, pattern, array_to_string(w, ' ') AS tokens,
  array_to_string({_FIRST_OF.format("list_filter(list_transform(w, lambda x: lower(x)), lambda x: length(x) >= 4)")}[1:6], ' ') AS path_terms,
  array_to_string({_FIRST_OF.format(r"list_filter(list_transform(regexp_extract_all(lower(pattern), '[^\s]+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$', '', 'g')), lambda x: strlen(x) >= 3)")}, ' ') AS baseline
FROM t""")
def query_tokens(spark, sf):
    """Tokens, path terms and the baseline's tokens of patterns."""
    return _told(_patterns(spark, sf), {"tokens": lambda p: " ".join(Q.words(p)), "path_terms": lambda p: " ".join(Q.path_terms(p)), "baseline": lambda p: " ".join(Q.baseline_tokens(p))})


@query(rf"""WITH {_PATTERNS_SQL}, t AS (SELECT p_partkey, pattern, regexp_extract_all(pattern, '{WORD}') AS w, regexp_extract_all(pattern, '[^\s]+') AS f FROM patterns),
m AS (SELECT *, len(w) = 1 AND w[1] = pattern AND length(pattern) > 1 AND regexp_matches(pattern, '\p{{Lu}}') AS marked FROM t)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, pattern, CAST(marked AS VARCHAR) AS identifier,
  CAST(len(f) = 1 AND len(w) > 0 AND (regexp_matches(pattern, '[-_.:/#<>=()"''`]') OR marked) AS VARCHAR) AS literal FROM m""")
def query_shape(spark, sf):
    """Whether a pattern is a literal, and an identifier with marks of case."""
    say = lambda b: str(bool(b)).lower()
    return _told(_patterns(spark, sf), {"identifier": lambda p: say(Q.is_marked_identifier(p)), "literal": lambda p: say(Q.is_literal(p))})


_CAMEL_SQL = rf"regexp_extract_all(regexp_replace(regexp_replace({{0}}, '(\p{{{{Ll}}}})(\p{{{{Lu}}}})', '\1 \2', 'g'), '([\p{{{{L}}}}\p{{{{N}}}}])(\p{{{{Lu}}}}\p{{{{Ll}}}})', '\1 \2', 'g'), '{WORD.replace('{', '{{').replace('}', '}}')}')"


@query(rf"""WITH {_PATTERNS_SQL}, w AS (SELECT p_partkey, pattern, unnest(regexp_extract_all(pattern, '{WORD}')) AS token, generate_subscripts(regexp_extract_all(pattern, '{WORD}'), 1) AS i FROM patterns),
first AS (SELECT p_partkey, pattern, lower(token) AS k, arg_min(token, i) AS token, min(i) AS i FROM w GROUP BY ALL),
parts AS (SELECT p_partkey, pattern, i, list_transform(list_prepend(token, {_CAMEL_SQL.format('token')}), lambda x: lower(x)) AS l FROM first),
groups AS (SELECT p_partkey, pattern, string_agg(array_to_string({_FIRST_OF.format('l')}, '+'), ' ' ORDER BY i) AS groups FROM parts GROUP BY ALL)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, pattern, groups FROM groups""")
def query_evidence_groups(spark, sf):
    """Term groups of the evidence: each token with its parts."""
    return _told(_patterns(spark, sf), {"groups": lambda p: " ".join("+".join(g) for g in Q.evidence_groups(p))})


@query(rf"""WITH {_PATTERNS_SQL}, f AS (SELECT p_partkey, pattern, regexp_extract_all(pattern, '[^\s]+') AS f FROM patterns),
e AS (SELECT p_partkey, pattern, len(f) AS n, {_FIRST_OF.format('f')} AS f FROM f),
m AS (SELECT *, list_filter(f, lambda x: (len(regexp_extract_all(x, '{WORD}')) > 1 AND regexp_matches(x, '[-_.:/#]')) OR (len(regexp_extract_all(x, '{WORD}')) = 1 AND regexp_matches(substr(x, 2), '\p{{Lu}}') AND regexp_matches(x, '\p{{Ll}}')))[1:4] AS a FROM e)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, pattern, CASE WHEN n > 1 AND (len(a) > 1 OR (len(a) = 1 AND regexp_matches(substr(a[1], 2), '\p{{Lu}}') AND regexp_matches(a[1], '\p{{Ll}}'))) THEN array_to_string(a, ' ') ELSE '' END AS anchors FROM m""")
def query_anchors(spark, sf):
    """Structured fields of a query that make phrase lanes of their own."""
    return _told(_patterns(spark, sf), {"anchors": lambda p: " ".join(Q.anchors(p))})


@query(rf"""SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS size, lower(p_brand) || '+' || p_name AS literals FROM (SELECT p_partkey, p_name, replace(p_brand, '#', ' ') AS p_brand, p_type FROM part)""")
def query_regexp_literals(spark, sf):
    """Literals of regular expressions, made from brands and names."""
    made = table(spark, sf, "part").select("p_partkey", "p_name", F.concat(F.lit("(?i)^"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))), F.lit(r"[0-9]*\s+(?:"), F.replace("p_name", F.lit(" "), F.lit(".*")), F.lit(")$")).alias("pattern"))

    def run(frames):
        for f in frames:
            words = [Q.regex_literals(p) for p in f["pattern"]]
            yield pd.DataFrame({"p_partkey": f["p_partkey"], "size": f["p_name"].str.len(), "literals": [" ".join(w[:2]) + "+" + " ".join(w[2:]) for w in words]})

    return made.mapInPandas(run, "p_partkey long, size long, literals string")


@query(r"""SELECT doc_id, CASE WHEN octet_length(encode(t)) <= 101 THEN t ELSE cut END AS text, 'passage: ' || substr(t, 1, 91) AS shaped
FROM (SELECT doc_id, text AS t, (SELECT arg_max(substr(text, 1, n), n) FROM range(1, 102) r(n) WHERE octet_length(encode(substr(text, 1, n))) <= 101) AS cut FROM documents)""")
def text_truncation(spark, sf):
    """Texts cut by bytes, between characters, and prefixed inputs cut by characters."""
    return table(spark, sf, "documents").select("doc_id", T.byte_cut(F.col("text"), 101).alias("text"), F.substring(F.concat(F.lit("passage: "), "text"), 1, 100).alias("shaped"))


@query(rf"""WITH {_PATTERNS_SQL} SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(pattern, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '[_-]+', ' ', 'g')), ' +', ' ', 'g')) AS words FROM patterns""")
def identifier_words(spark, sf):
    return _patterns(spark, sf).select("p_partkey", T.identifier_words(F.col("pattern")).alias("words"))


@query("""SELECT doc_id, path, path = 'en/src1' OR starts_with(path, 'en/src1/') AS by_segment, starts_with(path, 'en/src1') AS by_prefix, split_part(path, '/', 1) AS root,
  CASE WHEN doc_id % 3 = 0 THEN path ELSE lang || chr(10) || path END AS input
FROM (SELECT doc_id, lang, lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents)""")
def scopes_and_inputs(spark, sf):
    """Scopes by prefix and by segment, roots of paths, inputs of vectors."""
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    d = table(spark, sf, "documents").select("doc_id", "lang", path.alias("path"))
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return d.select("doc_id", "path", T.in_segment_scope(F.col("path"), "en/src1/").alias("by_segment"), T.in_scope(F.col("path"), "en/src1").alias("by_prefix"), T.path_root(F.col("path")).alias("root"), T.input_text(title, F.col("path")).alias("input"))


@query(r"""SELECT item_id, round(x[1] / l, 6) AS v1, round(x[2] / l, 6) AS v2, round(x[32] / l, 6) AS v32 FROM (
  SELECT item_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS l FROM (
    SELECT item_id, list_transform(range(0, 32), lambda i: (CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) - 127.5) / 127.5) AS x FROM (SELECT item_id, sha256('0' || chr(0) || text) AS h FROM benchmark)))""")
def test_vectors(spark, sf):
    """Deterministic vectors of the benchmark's texts: their first two and last components."""
    inputs = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("input_hash"), F.col("text").alias("input"))
    v = embedding.embed(inputs, lambda texts: [[float(x) for x in embedding.hash_vector(t, 32)] for t in texts], 32)
    return v.select(F.col("input_hash").cast("long").alias("item_id"), *(F.round(F.element_at("vector", i).cast("double"), 6).alias(f"v{i}") for i in (1, 2, 32)))


# ---- fusion, citations, results

#: Lanes of turns with a path lane over the file records: its score goes to the path's best other record.
_PATH_LANE = """
path_lane AS (SELECT * FROM (SELECT 3 AS lane_id, 'path' AS lane, record_id, path, start_line, kind, row_number() OVER (ORDER BY length(path), path, record_id) AS rank FROM turns WHERE kind = 'file' AND record_id % 2 = 0) WHERE rank <= 40)"""


def _with_path_lane(spark, sf):
    c = table(spark, sf, "conversations").where("turn = 0 AND conv_id * 1000 % 2 = 0")
    path = F.concat((F.col("conv_id") % 7).cast("string"), F.lit("/conv/"), F.col("conv_id").cast("string"))
    files = c.select((F.col("conv_id") * 1000).alias("record_id"), path.alias("path"), F.lit(0).alias("start_line"), F.lit("file").alias("kind"))
    lane = lanes.top(files, 40, F.length("path"), F.asc("path"), F.asc("record_id")).select(F.lit(3).alias("lane_id"), F.lit("path").alias("lane"), "record_id", "path", "start_line", "kind", "rank")
    return _lanes(spark, sf).unionByName(lane)


@query(f"""WITH {_LANES_SQL.split('records_scored AS')[0].rstrip().rstrip(',')}, {_PATH_LANE},
every AS (SELECT lane_id, lane, record_id, path, start_line, kind, rank FROM lanes UNION ALL SELECT lane_id, lane, record_id, path, start_line, kind, rank FROM path_lane),
scored AS (SELECT record_id, path, start_line, kind, round(sum(CASE lane WHEN 'extractor' THEN 0.5 ELSE 1.0 END / (60 + rank)), 12) AS score FROM every GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY (kind = 'file')::INT, score DESC, start_line, record_id) AS n FROM scored),
extra AS (SELECT path, round(1.0 / (60 + rank), 12) AS more FROM path_lane)
SELECT record_id, path, round(score + CASE WHEN n = 1 AND kind <> 'file' THEN coalesce(more, 0) ELSE 0 END, 12) AS score FROM placed LEFT JOIN extra USING (path)""")
def path_evidence(spark, sf):
    rows = _with_path_lane(spark, sf)
    return fusion.with_path_evidence(fusion.lane_scores(rows), rows).select("record_id", "path", "score")


def _split(spark, sf, limit: int):
    """(position, path, shown) of the fused paths, the strongest neighbour in its place: the driver's list of some dozens."""
    paths = S.order_paths(_lanes(spark, sf))[: limit + model.OVERFLOW]
    paths = fusion.promote_graph(paths, paths[-1], limit)
    return [(p, path, "record" if p <= limit else "path") for p, path in enumerate(paths[: limit + model.OVERFLOW], 1)]


@query(f"""WITH {_LANES_SQL},
byscore AS (SELECT path, row_number() OVER (ORDER BY path_score DESC, path) AS position, split_part(path, '/', 1) AS root FROM firsts),
f AS (SELECT max(root) FILTER (position = 1) AS a, max(root) FILTER (position = 2) AS b FROM byscore), p AS (SELECT min(position) AS p FROM byscore, f WHERE position >= 3 AND root <> a),
mixed AS (SELECT path, CASE WHEN a <> b OR p IS NULL THEN position WHEN position = p THEN 3 WHEN position >= 3 AND position < p THEN position + 1 ELSE position END AS position FROM byscore, f, p),
headed AS (SELECT path, row_number() OVER (ORDER BY (path <> head)::INT, position) AS position FROM mixed, head QUALIFY position <= 28),
n AS (SELECT max(position) AS n FROM headed),
moved AS (SELECT path, CASE WHEN position = n AND n > 8 THEN 8 WHEN position = 8 AND n > 8 THEN n ELSE position END AS position FROM headed, n)
SELECT CAST(position AS INTEGER) AS position, path, CASE WHEN position <= 8 THEN 'record' ELSE 'path' END AS shown FROM moved""")
def graph_slot_and_overflow(spark, sf):
    """Eight records, then up to twenty paths; the last path stands for the strongest neighbour and takes the eighth place."""
    return spark.createDataFrame(_split(spark, sf, 8), "position int, path string, shown string")


@query("""
WITH t AS (SELECT conv_id, turn, text, length(text) % 3 AS terms, length(text) % 5 = 0 AS literal, conv_id * 1000 + turn AS record_id, CAST(turn AS INTEGER) AS start_line, CAST(length(text) % 4 AS INTEGER) AS line, length(text) % 7 AS score,
  CASE turn % 3 WHEN 0 THEN 'exact,lexical' WHEN 1 THEN 'lexical' ELSE 'graph' END AS retrieval FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY literal DESC, terms DESC, CASE WHEN terms > 0 THEN CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 8 END END, start_line + CASE WHEN terms > 0 THEN line ELSE 0 END, CASE WHEN terms > 0 THEN -score END, record_id) AS n FROM t)
SELECT conv_id, record_id FROM o WHERE n = 1""")
def citation_choice(spark, sf):
    """Of a conversation's turns the one to cite, by evidence that follows from the texts' lengths."""
    n = F.length("text")
    retrieval = F.when(F.col("turn") % 3 == 0, "exact,lexical").when(F.col("turn") % 3 == 1, "lexical").otherwise("graph")
    t = table(spark, sf, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("path"), (F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"), F.lit("text-chunk").alias("kind"), F.col("turn").cast("int").alias("start_line"), retrieval.alias("retrieval"), (n % 3).alias("evidence_terms"), (n % 4).alias("evidence_line"), (n % 5 == 0).alias("literal_hit"), (n % 7).alias("score"))
    return citation.choose(t).select("conv_id", "record_id")


@query(r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, text, doc_id % 6 AS k FROM documents),
e AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE CAST(k AS INTEGER) END AS line, CASE WHEN k = 1 THEN 0 ELSE 1 END AS terms, CASE WHEN k = 2 THEN 1 ELSE len(l) + 10 END AS last FROM d),
w AS (SELECT *, terms = 0 OR last - 1 + 1 < len(l) AS whole FROM e),
s AS (SELECT *, CASE WHEN whole THEN 0 ELSE greatest(line - 2, 0) END AS skip FROM w),
t AS (SELECT *, regexp_replace(array_to_string(l[skip + 1:], chr(10)), '^\s+|\s+$', '', 'g') AS t FROM s),
x AS (SELECT *, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(substr(t, 1, 240), '^\s+|\s+$', '', 'g') || '…' END AS excerpt FROM t)
SELECT doc_id, CAST(1 + skip AS INTEGER) AS start_line, CAST(CASE WHEN whole THEN last ELSE least(last, 1 + skip + len(string_split(excerpt, chr(10))) - 1) END AS INTEGER) AS end_line, 'p:' || (1 + skip) AS title, excerpt FROM x""")
def citation_window(spark, sf):
    """Windows of documents about evidence whose line follows from doc_id."""
    k, n = (F.col("doc_id") % 6).cast("int"), F.size(F.split("text", "\n", -1))
    d = table(spark, sf, "documents").select("doc_id", F.lit("p").alias("path"), "text", F.lit(1).alias("start_line"), F.when(k == 2, 1).otherwise(n + 10).alias("end_line"), F.lit("p:1").alias("title"), k.alias("evidence_line"), F.when(k == 1, 0).otherwise(1).alias("evidence_terms"))
    return citation.localize(d, T.excerpt_limit(10)).select("doc_id", "start_line", "end_line", "title", "excerpt")


@query(r"""SELECT doc_id, json_object('path', 'a/' || doc_id, 'startLine', 1, 'endLine', 1) AS json FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, json_object('path', 'a/' || doc_id, 'startLine', 1, 'endLine', 1, 'kind', lang) FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, json_object('path', 'a/' || doc_id, 'startLine', 1, 'endLine', 1, 'title', source) FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, json_object('path', 'a/' || doc_id, 'startLine', 1, 'endLine', 1, 'source', 'plugin:x') FROM documents WHERE doc_id % 4 = 3""")
def result_projection(spark, sf):
    """Records as callers see them: what goes without saying is left out."""
    m = F.col("doc_id") % 4
    path = F.concat(F.lit("a/"), F.col("doc_id").cast("string"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("position"), path.alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.when(m == 1, F.col("lang")).otherwise("text-chunk").alias("kind"), F.when(m == 2, F.col("source")).when(m == 3, path).otherwise(F.concat(path, F.lit(":1"))).alias("title"), F.when(m == 3, "plugin:x").otherwise("core").alias("source"), F.lit(None).cast("string").alias("excerpt"))
    return S.public(d).select(F.col("position").alias("doc_id"), "json")


_LIVE_TERMS = ["license", "token"]


@query(rf"""
WITH f AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS path, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM f),
s AS (SELECT path, i, lower(line || ' ' || regexp_replace(regexp_replace(line, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '([\p{{L}}\p{{N}}])(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')) AS wide FROM l),
g AS (SELECT path, i, {", ".join(f"list_contains(regexp_extract_all(wide, '{WORD}'), '{t}')::INT AS g{k}" for k, t in enumerate(_LIVE_TERMS))} FROM s),
w AS (SELECT path, i, {" + ".join(f"max(g{k}) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)" for k in range(2))} AS terms FROM g),
b AS (SELECT path, terms, i FROM w QUALIFY row_number() OVER (PARTITION BY path ORDER BY terms DESC, i) = 1 AND terms > 0),
o AS (SELECT path, row_number() OVER (ORDER BY terms DESC, i, strlen(path), path) AS position FROM b)
SELECT CAST(position AS INTEGER) AS position, path FROM o WHERE position <= 15""")
def live_scan(spark, sf):
    """Files searched without an index."""
    d = table(spark, sf, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    found = S.search_files(d.select(path.alias("path"), F.lit("txt").alias("kind"), F.col("text").alias("content")), "license token", limit=15)
    return found.records.select("position", "path")


@query()
def search_modes(spark, sf):
    """The same query in each mode, with vectors by test embedding and edges between neighbours in number."""
    records = _records(spark, sf).withColumn("end_line", F.size(F.split("text", "\n", -1)))
    vectors = table(spark, sf, "embeddings").join(records.select(F.col("record_id").alias("vec_id"), "path", "start_line", "kind"), "vec_id").select(F.col("vec_id").alias("record_id"), "path", "start_line", "kind", "embedding")
    files = document_files(table(spark, sf, "documents"))
    edges = files.select(F.col("path").alias("source_path"), F.lit("import").alias("relation"), F.lit("x").alias("target"), F.lead("path").over(Window.partitionBy("kind").orderBy("path")).alias("target_path"), F.col("doc_id").alias("record_id"))
    out = None
    for mode in S.MODES:
        r = S.search(records, "license token", mode=mode, limit=5, vectors=vectors, provider=lambda _: [1.0] * 64, edges=edges)
        one = r.records.select(F.lit(mode).alias("mode"), F.lit(r.active_mode).alias("active_mode"), "position", "path", "score")
        out = one if out is None else out.unionByName(one)
    return out


# ---- snapshots

_STATES = """
old AS (SELECT doc_id, n_chars AS size, doc_id * 7 AS mtime, CASE WHEN doc_id % 13 = 0 THEN 'f1' ELSE 'f2' END AS fp FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT doc_id, n_chars AS size, doc_id * 7 + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 10 <> 1)"""


def _states(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("n_chars").cast("long").alias("size"))
    fp = F.when(F.col("doc_id") % 13 == 0, "f1").otherwise("f2")
    old = d.where("doc_id % 10 <> 0").select("path", "size", (F.col("doc_id") * 7).alias("mtime_ns"), fp.alias("extraction_fingerprint"))
    new = d.where("doc_id % 10 <> 1").select("path", "size", (F.col("doc_id") * 7 + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)).alias("mtime_ns"))
    return new, old


@query(f"""WITH {_STATES} SELECT coalesce(o.doc_id, n.doc_id)::VARCHAR AS path, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.size = n.size AND o.mtime = n.mtime AND fp = 'f2' THEN 'unchanged' ELSE 'check' END AS state FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
def change_detection(spark, sf):
    return snapshot.changes(*_states(spark, sf), "f2")


@query(f"""WITH {_STATES} SELECT o.doc_id::VARCHAR AS path, o.size, coalesce(n.mtime, o.mtime) AS mtime_ns, fp AS extraction_fingerprint FROM old o LEFT JOIN new n ON o.doc_id = n.doc_id""")
def metadata_refresh(spark, sf):
    new, old = _states(spark, sf)
    return snapshot.refresh(old, new)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat_ws(':', 'plugin:x', source, 'id' || doc_id) ELSE concat_ws(':', 'plugin:x', source, doc_id, doc_id + 1, lang, 4) END AS record_key FROM documents""")
def record_keys(spark, sf):
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    d = table(spark, sf, "documents").select("doc_id", F.lit("plugin:x").alias("source"), F.col("source").alias("path"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + 1).alias("end_line"), F.col("lang").alias("kind"), F.lit(4).alias("ordinal"), own.alias("id"))
    return snapshot.record_keys(d).select("doc_id", "record_key")


@query("""SELECT concat_ws(':', 'core', source, 1, 1, lang, 0) AS record_key, count(*) AS n FROM documents GROUP BY source, lang HAVING count(*) > 1""")
def repeated_keys(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("core").alias("source"), F.col("source").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("lang").alias("kind"), F.lit(0).alias("ordinal"))
    return snapshot.repeated_keys(snapshot.record_keys(d))


@query("""SELECT v.vec_id AS record_id FROM embeddings v JOIN documents d ON v.vec_id = d.doc_id WHERE d.source <> 'src3' AND v.label <> 2""")
def cascading_delete(spark, sf):
    """Vectors that stay once the files of one source are gone: those of remaining records, and of the live lane."""
    records = table(spark, sf, "documents").where("source <> 'src3'").select(F.col("doc_id").alias("record_id"), F.lit("h").alias("input_hash"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), F.when(F.col("label") == 2, "old").otherwise("live").alias("fingerprint"), F.lit("h").alias("input_hash"))
    return embedding.live_vectors(records, vectors, "live").select("record_id")


STAGES = ("click", "error", "purchase", "signup", "view")


@query("""SELECT event_type AS stage, CAST(user_id AS VARCHAR) AS path, 'run1' AS run_id, props AS message FROM events WHERE value > 50""")
def diagnostics(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("path"), F.when(F.col("value") > 50, F.col("props")).alias("message"))
    out = None
    for stage in STAGES:
        one = snapshot.diagnostics(e.where(F.col("event_type") == stage), "run1", stage)
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def latest_row(spark, sf):
    """The latest event of each user, as the latest run of a store."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# ---- evaluation

_RANKS = """
found AS (SELECT lang AS case_id, m AS mode, doc_id::VARCHAR AS path, row_number() OVER (PARTITION BY lang, m ORDER BY CASE m WHEN 'lexical' THEN n_chars ELSE doc_id END DESC, doc_id) AS rank FROM documents, (VALUES ('lexical'), ('semantic')) t(m) WHERE m = 'lexical' OR lang <> 'de' QUALIFY rank <= 100),
wanted AS (SELECT lang AS case_id, doc_id::VARCHAR AS path FROM documents WHERE doc_id % 17 = 0)"""


def _ranks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("case_id"), F.col("doc_id").cast("string").alias("path"), "doc_id", "n_chars")
    rank = lambda by: F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(by), "doc_id"))
    lexical = d.select("case_id", F.lit("lexical").alias("mode"), "path", rank("n_chars").alias("rank"))
    semantic = d.where("case_id <> 'de'").select("case_id", F.lit("semantic").alias("mode"), "path", rank("doc_id").alias("rank"))
    return d.where("doc_id % 17 = 0").select("case_id", "path"), lexical.unionByName(semantic).where("rank <= 100")


@query(f"""WITH {_RANKS} SELECT w.case_id, w.path, m AS mode, CAST(CASE WHEN m = 'lexical' OR w.case_id <> 'de' THEN coalesce(f.rank, 0) END AS INTEGER) AS rank
FROM wanted w CROSS JOIN (VALUES ('lexical'), ('semantic')) t(m) LEFT JOIN found f ON f.case_id = w.case_id AND f.path = w.path AND f.mode = m""")
def eval_path_ranks(spark, sf):
    expected, found = _ranks(spark, sf)
    return evaluate.path_ranks(expected, found, found.select("case_id", "mode").distinct())


@query("""SELECT round(avg((doc_id % 9 <> 0 AND doc_id % 5 > 0 AND doc_id % 7 >= doc_id % 5)::INT), 9) AS citation_rate FROM documents""")
def eval_citation_rate(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("source")).alias("path"), (F.col("doc_id") % 5).alias("start_line"), (F.col("doc_id") % 7).alias("end_line"))
    return evaluate.citation_rate(d)


@query("""
WITH s AS (SELECT user_id AS case_id, event_type AS mode, max(value > 90)::INT AS recall_at_10, round(max(value) / 1000, 6) AS mrr FROM events GROUP BY ALL),
e AS (SELECT DISTINCT user_id AS case_id, CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'error' ELSE 'no such mode' END AS mode FROM events),
b AS (SELECT case_id, max((recall_at_10, mrr)) AS best FROM s GROUP BY case_id), m AS (SELECT case_id, max((recall_at_10, mrr)) AS own FROM e JOIN s USING (case_id, mode) GROUP BY case_id)
SELECT e.case_id, own IS NOT NULL AS measured, coalesce(own = best, false) AS supported FROM e LEFT JOIN b USING (case_id) LEFT JOIN m USING (case_id)""")
def eval_expected_best(spark, sf):
    e = table(spark, sf, "events")
    scored = e.groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("mode")).agg(F.max((F.col("value") > 90).cast("int")).alias("recall_at_10"), F.round(F.max("value") / 1000, 6).alias("mrr"))
    mode = F.when(F.col("case_id") % 3 == 0, "click").when(F.col("case_id") % 3 == 1, "error").otherwise("no such mode")
    return evaluate.expected_best(scored, scored.select("case_id").distinct().withColumn("mode", mode))


@query("""SELECT count(*) AS cases, (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest([p_brand, p_type]) AS x FROM part)) AS kinds, (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part)) AS words FROM part""")
def eval_attribute_sets(spark, sf):
    cases = table(spark, sf, "part").select(F.array("p_brand", "p_type").alias("kinds"), F.split("p_name", " ").alias("words"))
    return suite.attribute_sets(cases, ["kinds", "words"]).select("cases", *(F.array_join(c, ",").alias(c) for c in ("kinds", "words")))


# ---- extractors, on files made by rule from small tables


def _facts(spark, sf, name: str, path, content):
    """(path, kind, title, start_line, end_line, message) of one extractor over files made from nations."""
    files = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), path.alias("path"), content.alias("content"))
    return extractors.extract(files, {name: extractors.EXTRACTORS[name]}).select("path", "kind", "title", "start_line", "end_line", "message")


def _extractor_sql(path: str, facts: list[tuple]) -> str:
    """Facts (kind, title expression, start, end or null, condition) of files of ``path``."""
    return " UNION ALL ".join(f"SELECT {path} AS path, '{kind}' AS kind, {title} AS title, CAST({a} AS INTEGER) AS start_line, CAST({b} AS INTEGER) AS end_line, CAST(NULL AS VARCHAR) AS message FROM nation WHERE {where}" for kind, title, a, b, where in facts)


def _name():
    return F.col("n_name")


@query(_extractor_sql("'d/' || n_name || '.md'", [("markdown-section", "n_name", 1, 4, "true"), ("markdown-section", "'Part of ' || n_regionkey", 5, "CASE WHEN n_nationkey % 2 = 0 THEN 8 ELSE 10 END", "true"), ("markdown-fence", "'sh'", 7, 10, "true")]))
def extract_markdown(spark, sf):
    comment = F.when(F.col("n_nationkey") % 2 == 0, "# not a section").otherwise("echo")
    return _facts(spark, sf, "markdown", F.concat(F.lit("d/"), _name(), F.lit(".md")), F.concat(F.lit("# "), _name(), F.lit(" ##\ntext\n#hashtag\n\n## Part of "), F.col("n_regionkey").cast("string"), F.lit("\n\n```sh\nls\n"), comment, F.lit("\n```")))


@query(_extractor_sql("'m/' || n_name || '.py'", [("python-import", "'os'", 1, 1, "n_nationkey % 5 <> 0"), ("python-import", "'.' || lower(n_name)", 2, 2, "n_nationkey % 5 <> 0"), ("python-class", "n_name", 3, 3, "n_nationkey % 5 <> 0"), ("python-method", "n_name || '.run'", 4, 4, "n_nationkey % 5 <> 0"), ("python-function", "'f_' || lower(n_name)", 5, 5, "n_nationkey % 5 <> 0"), ("python-navigation", "'m/' || n_name || '.py'", 1, 5, "n_nationkey % 5 <> 0")]) + " UNION ALL SELECT 'm/' || n_name || '.py', NULL, NULL, NULL, NULL, 'line 1: invalid syntax' FROM nation WHERE n_nationkey % 5 = 0")
def extract_python(spark, sf):
    good = F.concat(F.lit("import os\nfrom ."), F.lower(_name()), F.lit(" import x\nclass "), _name(), F.lit(":\n    async def run(self): pass\ndef f_"), F.lower(_name()), F.lit("(a): return 1"))
    return _facts(spark, sf, "python", F.concat(F.lit("m/"), _name(), F.lit(".py")), F.when(F.col("n_nationkey") % 5 == 0, "def (:").otherwise(good))


@query(_extractor_sql("'g/' || n_name || '.go'", [("go-import", "'fmt'", 3, 3, "true"), ("go-type", "n_name", 5, 5, "true"), ("go-const", "'C' || n_nationkey", 7, 7, "true"), ("go-function", "'New' || n_name", 9, 9, "true"), ("go-method", "n_name || '.Run'", 13, 13, "true"), ("go-navigation", "'g/' || n_name || '.go'", 1, 13, "true")]))
def extract_go(spark, sf):
    return _facts(spark, sf, "go", F.concat(F.lit("g/"), _name(), F.lit(".go")), F.concat(F.lit('package a\n\nimport "fmt"\n\ntype '), _name(), F.lit(" struct{}\n\nconst C"), F.col("n_nationkey").cast("string"), F.lit(' = "func No() {}"\n\nfunc New'), _name(), F.lit("() {\n\tvar inner = 1\n}\n\nfunc (n *"), _name(), F.lit(") Run() {}")))


@query(_extractor_sql("'w/' || n_name || '.ts'", [("typescript-import", "'./' || lower(n_name)", 1, 1, "true"), ("typescript-export", "'../region'", 2, 2, "true"), ("typescript-interface", "n_name", 3, 3, "true"), ("typescript-const", "'key'", 4, 4, "true"), ("typescript-function", "'load'", 5, 5, "true"), ("typescript-navigation", "'w/' || n_name || '.ts'", 1, 8, "true")]))
def extract_typescript(spark, sf):
    return _facts(spark, sf, "typescript", F.concat(F.lit("w/"), _name(), F.lit(".ts")), F.concat(F.lit("import { a } from './"), F.lower(_name()), F.lit("'\nexport * from '../region'\nexport interface "), _name(), F.lit(" {}\nconst key = "), F.col("n_nationkey").cast("string"), F.lit("\nexport async function load() {\n  const inner = 2\n}\n// class No {}")))


@query(_extractor_sql("'p/' || n_nationkey || '/package.json'", [("npm-package", "lower(n_name)", 1, 1, "true"), ("npm-dependency", "'dep-' || n_regionkey", 1, 1, "true"), ("npm-dependency", "'dev-' || n_nationkey", 1, 1, "true"), ("package-script", "'build'", 1, 1, "true"), ("workspace-member", "'packages/*'", 1, 1, "true")]))
def extract_manifest(spark, sf):
    k, r = (F.col(c).cast("string") for c in ("n_nationkey", "n_regionkey"))
    content = F.concat(F.lit('{"name": "'), F.lower(_name()), F.lit('", "dependencies": {"dep-'), r, F.lit('": "^1"}, "devDependencies": {"dev-'), k, F.lit('": "2"}, "scripts": {"build": "make"}, "workspaces": ["packages/*"]}'))
    return _facts(spark, sf, "manifest", F.concat(F.lit("p/"), k, F.lit("/package.json")), content)


@query(_extractor_sql("'i/' || n_name || '.tf'", [("terraform-block", "'resource.aws_x.' || lower(n_name)", 1, 1, "true"), ("terraform-attribute", "'resource.aws_x.' || lower(n_name) || '.name'", 2, 2, "true")]))
def extract_terraform(spark, sf):
    return _facts(spark, sf, "terraform", F.concat(F.lit("i/"), _name(), F.lit(".tf")), F.concat(F.lit('resource "aws_x" "'), F.lower(_name()), F.lit('" {\n  name = var.region\n}')))


@query(_extractor_sql("'j/' || n_name || '.java'", [("java-package", "'a.' || lower(n_name)", 1, 1, "true"), ("java-import", "'c.D'", 2, 2, "true"), ("java-definition", "n_name", 3, 3, "true"), ("java-definition", "n_name || '.run'", 4, 4, "true")]))
def extract_jvm(spark, sf):
    return _facts(spark, sf, "jvm-dotnet", F.concat(F.lit("j/"), _name(), F.lit(".java")), F.concat(F.lit("package a."), F.lower(_name()), F.lit(";\nimport c.D;\npublic class "), _name(), F.lit(" {\n  public void run() {\n  }\n}")))


@query(_extractor_sql("'c/' || n_name || '.clj'", [("clojure-file", "'a.' || lower(n_name)", 1, 3, "true")]))
def extract_clojure(spark, sf):
    return _facts(spark, sf, "clojure", F.concat(F.lit("c/"), _name(), F.lit(".clj")), F.concat(F.lit("(ns a."), F.lower(_name()), F.lit("\n  (:require [b.util :as u]))\n(defn f [x] x)")))


_BAD = [("kind", "a record lacks kind or text, or names a source"), ("lines", "a record's lines are not in the file"), ("twice", "an id occurs twice"), ("many", "too many records")]


@query("""SELECT n_name AS path, CASE n_nationkey % 5 """ + " ".join(f"WHEN {i} THEN '{m.replace(chr(39), chr(39) * 2)}'" for i, (_, m) in enumerate(_BAD)) + """ END AS message, CASE WHEN n_nationkey % 5 = 4 THEN 'plugin:odd' END AS source FROM nation""")
def extractor_validation(spark, sf):
    """Answers that are refused as a whole, and one that is not."""

    def odd(path: str, content: str) -> list[dict]:
        good = {"kind": "k", "title": "t", "text": "x", "start_line": 1, "end_line": 1}
        return {"0": [good, good | {"kind": ""}], "1": [good | {"end_line": 2}], "2": [good | {"id": "a"}, good | {"id": "a"}], "3": [good] * (model.MAX_RECORDS + 1)}.get(content, [good])

    files = table(spark, sf, "nation").select(F.col("n_name").alias("path"), (F.col("n_nationkey") % 5).cast("string").alias("content"))
    return extractors.extract(files, {"odd": (["**"], odd)}).select("path", "message", F.when(F.col("message").isNull(), F.col("source")).alias("source"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'env' ELSE 'md' END AS kind FROM nation""")
def dotenv_names(spark, sf):
    """Names of dotenv files, in any case."""
    path = F.when(F.col("n_nationkey") % 3 == 0, F.when(F.col("n_nationkey") % 2 == 0, "a/.ENV").otherwise("b/Prod.Env.Local")).otherwise("c/environment.md")
    return table(spark, sf, "nation").select("n_nationkey", T.kind(path).alias("kind"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'bin/a.ts' END AS target_path FROM nation""")
def graph_sources_without_extension(spark, sf):
    """A source without extension has no extension of its own to try."""
    files = spark.createDataFrame([("bin/a",), ("bin/a.ts",)], "path string")
    target = F.when(F.col("n_nationkey") % 2 == 0, "./a.b/c").otherwise("./a.b")
    found = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("bin/run"), F.col("n_nationkey").cast("string")).alias("source_path"), target.alias("target"))
    return graph.resolve(found, files).select("n_nationkey", "target_path")

