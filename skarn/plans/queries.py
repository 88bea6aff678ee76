"""Named queries over the driver's tables, one per operator of the inventory, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from ..operators import chunking, citation, evaluate, fusion, graph, lanes, snapshot
from ..sources.tables import document_files, document_records, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TERMS = ["tion", "the", "shthon", "eauer"]
PHRASE = ["of", "the"]
PASSAGE_WORDS = ["the", "with", "queeau", "berlich"]
PATH = "lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt'"
RECORDS = f"records AS (SELECT doc_id AS record_id, {PATH} AS path, lang || ' ' || source AS title, text, 1 AS start_line, source FROM documents)"
TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bm25_sql(units: list[list[str]], need: str, where: str = "true", weights: dict[str, float] | None = None, limit: int = 20) -> str:
    weights = weights or model.COLUMN_WEIGHTS
    places = lambda c, u: f"len(list_filter(t_{c}, lambda x: x = '{u[0]}'))" if len(u) == 1 else f"len(list_filter(range(1, greatest(len(t_{c}) - {len(u) - 1}, 0) + 1), lambda i: list_slice(t_{c}, i, i + {len(u) - 1}) = {u!r}))"
    found = ", ".join(" + ".join(f"{weights[c]} * {places(c, u)}" for c in weights) + f" AS f{k}" for k, u in enumerate(units))
    n = range(len(units))
    hit = (" AND " if need == "all" else " OR ").join(f"f{k} > 0" for k in n)
    score = " + ".join(f"greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * (f{k} * 2.2) / (f{k} + 1.2 * (0.25 + 0.75 * d / av))" for k in n)
    return f"""
WITH {RECORDS},
tok AS (SELECT record_id, path, start_line, {", ".join(TOKENS.format(c) + f" AS t_{c}" for c in weights)} FROM records WHERE {where}),
counted AS (SELECT record_id, path, start_line, {" + ".join(f"len(t_{c})" for c in weights)} AS d, {found} FROM tok),
corpus AS (SELECT count(*) AS n, avg(d) AS av, {", ".join(f"count(*) FILTER (f{k} > 0) AS df{k}" for k in n)} FROM counted),
scored AS (SELECT record_id, path, start_line, round({score}, 9) AS score FROM counted, corpus WHERE {hit}),
ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, start_line, record_id) AS rank FROM scored)
SELECT record_id, path, score, CAST(rank AS INTEGER) AS rank FROM ordered WHERE rank <= {limit}"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return document_records(table(spark, sf, "documents"))


def _top(found: DataFrame, limit: int = 20) -> DataFrame:
    return lanes.top(found, limit, *lanes.by(lanes.SCORE_KEYS)).select("record_id", "path", "score", "rank")


@query(bm25_sql([[t] for t in TERMS], "any"))
def bm25_any(spark, sf):
    return _top(lanes.bm25(_records(spark, sf), TERMS))


@query(bm25_sql([[t] for t in PASSAGE_WORDS[:2]], "all"))
def bm25_all_terms(spark, sf):
    return _top(lanes.bm25(_records(spark, sf), PASSAGE_WORDS[:2], lanes.NEED_ALL))


@query(bm25_sql([PHRASE], "any"))
def bm25_phrase(spark, sf):
    return _top(lanes.bm25(_records(spark, sf), PHRASE, lanes.NEED_PHRASE))


@query(bm25_sql([["en"], ["src3"], ["the"]], "any", weights={"path": 8.0, "title": 4.0, "text": 1.0}))
def bm25_weighted_columns(spark, sf):
    return _top(lanes.bm25(_records(spark, sf), ["en", "src3", "the"]))


@query(bm25_sql([[t] for t in TERMS], "any", where="source IN ('src1', 'src2', 'src3')"))
def extractor_subset_bm25(spark, sf):
    return _top(lanes.bm25(_records(spark, sf).where(F.col("source").isin("src1", "src2", "src3")), TERMS))


@query(f"""WITH {RECORDS} SELECT record_id, path, CAST(row_number() OVER (ORDER BY path, start_line, record_id) AS INTEGER) AS rank FROM records WHERE contains(text, 'token = "')""")
def fixed_contains(spark, sf):
    return lanes.ranked_widely(lanes.fixed(_records(spark, sf), 'token = "'), *lanes.by(lanes.PATH_KEYS)).select("record_id", "path", "rank")


@query(f"""WITH {RECORDS}, found AS (SELECT * FROM records WHERE contains(text, 'Apache License') AND list_has_any({TOKENS.format('text')}, ['apache', 'license'])) SELECT record_id, path FROM found""")
def literal_prefilter(spark, sf):
    return lanes.literal(_records(spark, sf), "Apache License", ["apache", "license"], False).select("record_id", "path")


@query(r"""SELECT page_id, url FROM pages WHERE regexp_matches(html, '(^|[^\p{L}\p{N}\p{M}_$])track([^\p{L}\p{N}\p{M}_$]|$)')""")
def identifier_boundary(spark, sf):
    return table(spark, sf, "pages").where(T.has_identifier(F.col("html"), "track")).select("page_id", "url")


REGEX = r"licen[cs]ed? under.*(Apache|CC BY)"


@query(f"""WITH {RECORDS} SELECT record_id, path, CAST(row_number() OVER (ORDER BY path, start_line, record_id) AS INTEGER) AS rank FROM records WHERE regexp_matches(lower(text), '{REGEX.lower()}')""")
def regexp_scan(spark, sf):
    low = _records(spark, sf).withColumn("text", F.lower("text"))
    return lanes.ranked_widely(lanes.regexp(low, REGEX.lower()), *lanes.by(lanes.PATH_KEYS)).select("record_id", "path", "rank")


@query(f"""
WITH {RECORDS}, m AS (SELECT record_id, path, contains(lower(path), 'src1')::INT + contains(lower(path), '0000')::INT + contains(lower(path), 'fr/')::INT AS matches FROM records),
o AS (SELECT *, row_number() OVER (ORDER BY matches DESC, length(path), path, record_id) AS rank FROM m WHERE matches > 0)
SELECT record_id, path, CAST(matches AS INTEGER) AS matches, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 100""")
def path_terms_rank(spark, sf):
    found = lanes.path_matches(_records(spark, sf), ["src1", "0000", "fr/"])
    return lanes.top(found, 100, F.desc("matches"), F.length("path"), F.asc("path"), F.asc("record_id")).select("record_id", "path", F.col("matches").cast("int").alias("matches"), "rank")


@query(bm25_sql([["the"], ["of"]], "any", limit=10**9).replace("FROM scored)", "FROM scored WHERE starts_with(path, 'en/src5/'))").replace("rank <= 1000000000", "rank <= 15"))
def scope_prefix_topk(spark, sf):
    return _top(lanes.bm25(_records(spark, sf), ["the", "of"]).where(T.in_scope(F.col("path"), "en/src5/")), 15)


@query("""
WITH t AS (SELECT conv_id, turn, 'conv/' || conv_id AS path, CAST(turn AS INTEGER) AS start_line, conv_id * 1000 + turn AS record_id, length(text) AS score FROM conversations),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, start_line, record_id) AS rn FROM t),
f AS (SELECT path, min(rn) AS first FROM o GROUP BY path), k AS (SELECT max(first) AS cut FROM (SELECT first FROM f ORDER BY first LIMIT 10))
SELECT record_id, path, score, CAST(rn AS INTEGER) AS rank FROM o, k WHERE rn <= cut""")
def distinct_path_topk(spark, sf):
    c = table(spark, sf, "conversations")
    r = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").cast("int").alias("start_line"), F.length("text").cast("long").alias("score"))
    return lanes.distinct_path_top(r, 10, *lanes.SCORE_KEYS).select("record_id", "path", "score", "rank")


@query(f"""
WITH {RECORDS}, c AS (SELECT path, sum(len(regexp_extract_all(lower(text), 'with')) + len(regexp_extract_all(lower(text), 'tion'))) AS matches FROM records GROUP BY path),
o AS (SELECT *, row_number() OVER (ORDER BY matches DESC, path) AS rank FROM c WHERE matches > 0)
SELECT path, CAST(matches AS BIGINT) AS matches, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 20""")
def token_counts_baseline(spark, sf):
    return lanes.top(evaluate.token_counts(_records(spark, sf), ["with", "tion"]), 20, F.desc("matches"), F.asc("path"))


GLOBS = ["en/**/*1.txt", "fr/src?/*.txt"]


@query(rf"SELECT doc_id, {PATH} AS path FROM documents WHERE regexp_full_match({PATH}, 'en/(?:.*/)?[^/]*1\.txt') OR regexp_full_match({PATH}, 'fr/src[^/]/[^/]*\.txt')")
def glob_filter(spark, sf):
    return document_files(table(spark, sf, "documents")).where(T.matches_any(F.col("path"), GLOBS)).select("doc_id", "path")


NAMES = "CASE doc_id % 7 WHEN 0 THEN '.env' WHEN 1 THEN 'a.KEY' WHEN 2 THEN 'Makefile' WHEN 3 THEN 'x.Tar.GZ' WHEN 4 THEN '.env.local' WHEN 5 THEN 'b.pem' ELSE 'c.md' END"


def _named(spark, sf):
    return table(spark, sf, "documents").withColumn("path", F.concat("source", F.lit("/"), F.expr(NAMES)))


@query(f"""SELECT doc_id, source || '/' || {NAMES} AS path, CASE doc_id % 7 WHEN 0 THEN 'env' WHEN 4 THEN 'env' WHEN 1 THEN 'key' WHEN 2 THEN 'text' WHEN 3 THEN 'gz' WHEN 5 THEN 'pem' ELSE 'md' END AS kind FROM documents""")
def kind_derivation(spark, sf):
    return _named(spark, sf).select("doc_id", "path", T.kind(F.col("path")).alias("kind"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'non-regular' WHEN octet_length(encode(text)) > 8000 THEN 'file-too-large' WHEN doc_id % 7 IN (1, 5) THEN 'secret-material' WHEN doc_id % 13 = 0 THEN 'non-text' END AS reason FROM documents""")
def secret_skip_reasons(spark, sf):
    raw = F.when(F.col("doc_id") % 13 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.encode("text", "UTF-8"))
    return _named(spark, sf).select("doc_id", T.skip_reason(F.col("path"), F.octet_length("text"), F.col("doc_id") % 11 != 0, raw, 8000).alias("reason"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'export ' ELSE '' END || n_name_ || '=<redacted>' || chr(10) || chr(10) || 'B:<redacted>' AS content FROM (SELECT n_nationkey, regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') AS n_name_ FROM nation)""")
def env_redaction(spark, sf):
    name = F.regexp_replace("n_name", "[^A-Za-z0-9_]", "_")
    content = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "export ").otherwise(""), name, F.lit("=s3cret value\nsome prose\nB: never"))
    return table(spark, sf, "nation").select("n_nationkey", T.redact_env(content).alias("content"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events WHERE coalesce(TRY_CAST(json_extract_string(props, '$.lexical') AS BOOLEAN), true) AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50""")
def json_optout_filter(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").where(T.flag(F.col("props"), "lexical", True) & (k > 50)).select("event_id", F.coalesce(k, F.lit(-1)).alias("k"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"WITH {RECORDS} SELECT 'sha256:' || sha256(title || chr(10) || text) AS input_hash, min(record_id) AS record_id, count(*) AS records FROM records GROUP BY 1")
def input_hash_dedupe(spark, sf):
    r = snapshot.embeddable(_records(spark, sf).withColumn("metadata", F.lit(None).cast("string")))
    return r.groupBy("input_hash").agg(F.min("record_id").alias("record_id"), F.count("*").alias("records"))


def _with_vectors(spark, sf):
    r = snapshot.embeddable(_records(spark, sf).withColumn("metadata", F.lit(None).cast("string")))
    return r, r.where("record_id % 3 = 0").select("record_id", "input_hash")


@query(f"""
WITH {RECORDS}, i AS (SELECT record_id, title || chr(10) || text AS input FROM records WHERE record_id % 3 <> 0)
SELECT 'sha256:' || sha256(input) AS input_hash, min(record_id) AS record_id, length(input) AS size FROM i GROUP BY input""")
def missing_embedding_queue(spark, sf):
    return snapshot.missing_inputs(*_with_vectors(spark, sf)).select("input_hash", "record_id", F.length("input").cast("long").alias("size"))


@query("SELECT count(*) AS records, count(*) FILTER (doc_id % 3 = 0) AS embedded, bool_and(doc_id % 3 = 0) AS complete FROM documents")
def embedding_coverage(spark, sf):
    return snapshot.coverage(*_with_vectors(spark, sf))


_COSINE = """
WITH v AS (SELECT vec_id AS record_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT e AS q FROM v WHERE record_id = 7),
s AS (SELECT record_id, label, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 9) AS similarity FROM v, q{where}),
o AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, record_id) AS rank FROM s)
SELECT record_id, similarity, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 25"""


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "record_id")
    return v, v.where("record_id = 7").select(F.col("embedding").alias("q"))


@query(_COSINE.format(where=""))
def vector_cosine_topk(spark, sf):
    v, q = _vectors(spark, sf)
    return lanes.vector_top(v, q, 25).select("record_id", "similarity", "rank")


@query(_COSINE.format(where=" WHERE label = 3"))
def vector_scoped_topk(spark, sf):
    v, q = _vectors(spark, sf)
    return lanes.vector_top(v.where("label = 3"), q, 25).select("record_id", "similarity", "rank")


#: Three lanes of conversations' turns: by length, by order, by number of words; a path is a conversation.
_LANES_SQL = """
turns AS (SELECT conv_id * 1000 + turn AS record_id, (conv_id % 7) || '/conv/' || conv_id AS path, CAST(turn AS INTEGER) AS start_line, CASE WHEN turn = 0 THEN 'file' ELSE 'text-chunk' END AS kind, length(text) AS a, len(regexp_extract_all(text, '[^ ]+')) AS b FROM conversations),
lanes AS (
  SELECT * FROM (SELECT 0 AS lane_id, 'lexical' AS lane, record_id, path, start_line, kind, row_number() OVER (ORDER BY a DESC, record_id) AS rank FROM turns) WHERE rank <= 100
  UNION ALL SELECT * FROM (SELECT 1, 'semantic', record_id, path, start_line, kind, row_number() OVER (ORDER BY b DESC, record_id) AS rank FROM turns WHERE record_id % 2 = 0) WHERE rank <= 100
  UNION ALL SELECT * FROM (SELECT 2, 'extractor', record_id, path, start_line, kind, row_number() OVER (ORDER BY a, record_id) AS rank FROM turns WHERE record_id % 3 = 0) WHERE rank <= 100),
records_scored AS (SELECT record_id, path, start_line, kind, round(sum(CASE lane WHEN 'extractor' THEN 0.5 ELSE 1.0 END / (60 + rank)), 12) AS score, string_agg(DISTINCT lane, ',' ORDER BY lane) AS retrieval FROM lanes GROUP BY ALL),
best AS (SELECT lane, path, min(rank) AS rank FROM lanes GROUP BY lane, path),
votes AS (SELECT lane AS family, path, round(CASE lane WHEN 'extractor' THEN 0.5 ELSE 1.0 END / (60 + rank), 12) AS votes FROM best),
placed AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY votes DESC, path) AS place FROM votes),
paths_scored AS (SELECT path, round(sum(CASE family WHEN 'extractor' THEN 0.5 ELSE 1.0 END / (10 + place)), 12) AS path_score FROM placed GROUP BY path),
shown AS (SELECT * FROM (SELECT *, max((kind <> 'file')::INT) OVER (PARTITION BY path) AS o FROM records_scored) WHERE o = 0 OR kind <> 'file'),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, start_line, record_id) AS n FROM shown) JOIN paths_scored USING (path) WHERE n = 1),
head AS (SELECT path AS head FROM firsts ORDER BY score DESC, path, start_line, record_id LIMIT 1),
fused AS (SELECT path, record_id, score, path_score, CAST(row_number() OVER (ORDER BY (path <> head)::INT, path_score DESC, path) AS INTEGER) AS position FROM firsts, head)"""


def _lanes(spark, sf):
    c = table(spark, sf, "conversations")
    t = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"), F.concat((F.col("conv_id") % 7).cast("string"), F.lit("/conv/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").cast("int").alias("start_line"), F.when(F.col("turn") == 0, "file").otherwise("text-chunk").alias("kind"), F.length("text").alias("a"), F.size(F.regexp_extract_all("text", F.lit("([^ ]+)"), F.lit(1))).alias("b"))
    each = [(0, "lexical", t, (F.desc("a"), F.asc("record_id"))), (1, "semantic", t.where("record_id % 2 = 0"), (F.desc("b"), F.asc("record_id"))), (2, "extractor", t.where("record_id % 3 = 0"), (F.asc("a"), F.asc("record_id")))]
    out = None
    for n, name, rows, order in each:
        lane = lanes.top(rows, 100, *order).select(F.lit(n).alias("lane_id"), F.lit(name).alias("lane"), "record_id", "path", "start_line", "kind", "rank")
        out = lane if out is None else out.unionByName(lane)
    return out


@query(f"WITH {_LANES_SQL} SELECT record_id, path, score, retrieval FROM records_scored")
def rrf_lane_scores(spark, sf):
    return fusion.lane_scores(_lanes(spark, sf)).select("record_id", "path", "score", "retrieval")


@query(f"WITH {_LANES_SQL} SELECT path, path_score FROM paths_scored")
def rrf_family_fusion(spark, sf):
    return fusion.path_scores(_lanes(spark, sf))


@query(f"WITH {_LANES_SQL} SELECT * FROM fused")
def precision_head(spark, sf):
    return fusion.fuse(_lanes(spark, sf)).select("path", "record_id", "score", "path_score", "position")


@query(f"""
WITH {_LANES_SQL}, r AS (SELECT *, split_part(path, '/', 1) AS root FROM fused),
f AS (SELECT max(root) FILTER (position = 1) AS a, max(root) FILTER (position = 2) AS b FROM r), p AS (SELECT min(position) AS p FROM r, f WHERE position >= 3 AND root <> a)
SELECT path, CAST(CASE WHEN a <> b OR p IS NULL THEN position WHEN position = p THEN 3 WHEN position >= 3 AND position < p THEN position + 1 ELSE position END AS INTEGER) AS position FROM r, f, p""")
def root_diversity(spark, sf):
    return fusion.root_diversity(fusion.fuse(_lanes(spark, sf)).select("path", "position")).select("path", "position")


#: Import records between documents: of each document, of the next with its language, by a relative target.
_IMPORTS_SQL = f"""
files AS (SELECT doc_id, {PATH} AS path, source FROM documents),
records AS (
  SELECT doc_id AS record_id, path, CASE WHEN doc_id % 2 = 0 THEN 'x-import' ELSE 'x-export' END AS kind,
    CASE doc_id % 4 WHEN 0 THEN './' || lpad((doc_id + 20)::VARCHAR, 8, '0') || '.txt?v=1' WHEN 1 THEN '../src1/./x/../' || lpad((doc_id + 1)::VARCHAR, 8, '0') WHEN 2 THEN 'react' ELSE '../' || source || '/' || lpad((doc_id - 20)::VARCHAR, 8, '0') || '.js#a' END AS title
  FROM files),
edges AS (SELECT path AS source_path, replace(kind, 'x-', '') AS relation, title AS target, record_id FROM records)"""


def _imports(spark, sf):
    f = document_files(table(spark, sf, "documents")).withColumn("source", F.split("path", "/")[1])
    number = lambda k: F.lpad((F.col("doc_id") + k).cast("string"), 8, "0")
    m = F.col("doc_id") % 4
    title = F.when(m == 0, F.concat(F.lit("./"), number(20), F.lit(".txt?v=1"))).when(m == 1, F.concat(F.lit("../src1/./x/../"), number(1))).when(m == 2, "react").otherwise(F.concat(F.lit("../"), "source", F.lit("/"), number(-20), F.lit(".js#a")))
    return f, f.select(F.col("doc_id").alias("record_id"), "path", F.when(F.col("doc_id") % 2 == 0, "x-import").otherwise("x-export").alias("kind"), title.alias("title"), F.lit("plugin:x").alias("source"), F.lit("{}").alias("metadata"))


@query(f"WITH {_IMPORTS_SQL} SELECT * FROM edges")
def graph_edges_build(spark, sf):
    return graph.edges(_imports(spark, sf)[1])


_RESOLVED_SQL = f"""{_IMPORTS_SQL},
bases AS (
  SELECT e.*, CASE WHEN target LIKE './%' THEN regexp_replace(source_path, '[^/]*$', '') || regexp_replace(substr(target, 3), '[?#].*$', '')
    WHEN target LIKE '../src1/%' THEN split_part(source_path, '/', 1) || '/src1/' || regexp_replace(target, '^.*/', '')
    WHEN target LIKE '../%' THEN split_part(source_path, '/', 1) || '/' || regexp_replace(substr(target, 4), '[?#].*$', '') END AS base
  FROM edges e),
asked AS (SELECT source_path, target, unnest(CASE WHEN base IS NULL THEN [] ELSE [base, regexp_replace(base, '\\.[^./]*$', '') || '.txt', base || '/index.txt'] END) AS path, unnest(CASE WHEN base IS NULL THEN [] ELSE [0, 1, 2] END) AS k FROM bases),
hit AS (SELECT source_path, target, arg_min(path, k) AS target_path FROM asked JOIN files USING (path) GROUP BY ALL),
resolved AS (SELECT edges.*, target_path FROM edges LEFT JOIN hit USING (source_path, target))"""


def _resolved(spark, sf):
    files, records = _imports(spark, sf)
    return graph.resolve(graph.edges(records), files)


@query(f"WITH {_RESOLVED_SQL} SELECT source_path, relation, target, target_path, record_id FROM resolved")
def graph_target_resolution(spark, sf):
    return _resolved(spark, sf).select("source_path", "relation", "target", "target_path", "record_id")


@query(f"""
WITH {_RESOLVED_SQL}, seeds AS (SELECT path AS seed, row_number() OVER (ORDER BY path) AS rank FROM files WHERE doc_id % 40 = 0 QUALIFY rank <= 20),
real AS (SELECT * FROM resolved WHERE target_path IS NOT NULL AND target_path <> source_path),
hops AS (SELECT source_path AS path, 0.6 / (60 + rank) AS s, record_id FROM real JOIN seeds ON target_path = seed UNION ALL SELECT target_path, 0.6 / (60 + rank), NULL FROM real JOIN seeds ON source_path = seed),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s DESC, record_id NULLS LAST) AS n FROM hops WHERE path NOT IN (SELECT seed FROM seeds))
SELECT path, round(s, 12) AS score, record_id FROM o WHERE n = 1""")
def graph_one_hop(spark, sf):
    files = _imports(spark, sf)[0].where("doc_id % 40 = 0")
    return graph.one_hop(_resolved(spark, sf), lanes.top(files, 20, F.asc("path")).select("path", "rank"))


_VERSIONS = f"""
old AS (SELECT {PATH} AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT {PATH} AS path, CASE WHEN doc_id % 10 = 3 THEN sha256(text || '!') ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 10 <> 1),
states AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'modified' END AS state FROM old o FULL JOIN new n ON o.path = n.path)"""


def _versions(spark, sf):
    f = document_files(table(spark, sf, "documents"))
    old = f.where("doc_id % 10 <> 0").select("path", F.sha2("content", 256).alias("content_hash"))
    new = f.where("doc_id % 10 <> 1").select("path", F.when(F.col("doc_id") % 10 == 3, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.sha2("content", 256)).alias("content_hash"))
    return old, new


@query(f"WITH {_VERSIONS} SELECT * FROM states")
def index_diff(spark, sf):
    return snapshot.diff(*_versions(spark, sf))


@query(f"WITH {_VERSIONS} SELECT path, content_hash FROM new")
def snapshot_upsert(spark, sf):
    old, new = _versions(spark, sf)
    states = snapshot.diff(old, new)
    changed = new.join(states.where("state IN ('new', 'modified')").select("path"), "path", "left_semi")
    return snapshot.upsert(old, changed, states.where("state = 'deleted'"))


@query(f"WITH {_VERSIONS} SELECT count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state = 'unchanged') AS unchanged FROM states")
def drift_status(spark, sf):
    states = snapshot.diff(*_versions(spark, sf))
    return states.agg(*(F.sum((F.col("state") == s).cast("long")).alias(s) for s in ("new", "modified", "deleted", "unchanged")))


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
b AS (SELECT doc_id, i, line, octet_length(encode(line)) AS size, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
e AS (SELECT a.doc_id, a.i, any_value(a.n) AS n, any_value(a.size) AS size, max(z.i) AS last FROM b a JOIN b z ON z.doc_id = a.doc_id AND z.i BETWEEN a.i AND a.i + 159 AND z.upto - a.upto + a.size <= 8192 GROUP BY a.doc_id, a.i
  UNION ALL SELECT doc_id, i, n, size, i FROM b WHERE size > 8192),
w(doc_id, i) AS (SELECT DISTINCT doc_id, CAST(1 AS BIGINT) FROM l UNION SELECT w.doc_id, CASE WHEN e.size > 8192 THEN e.i + 1 WHEN e.last - 20 + 1 > e.i THEN e.last - 20 + 1 ELSE e.last + 1 END FROM w JOIN e USING (doc_id, i) WHERE e.last < e.n)
SELECT {PATH} AS path, CAST(i AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line, sha256(trim(array_to_string(list_slice(string_split(d.text, chr(10)), i, last), chr(10)), chr(10) || chr(9) || chr(13) || ' ')) AS sha256 FROM w JOIN e USING (doc_id, i) JOIN documents d USING (doc_id) WHERE e.size <= 8192 AND trim(array_to_string(list_slice(string_split(d.text, chr(10)), i, last), chr(10)), chr(10) || ' ') <> ''""")
def chunk_windows(spark, sf):
    records = chunking.chunk_records(document_files(table(spark, sf, "documents")))
    return records.where("kind <> 'file' AND metadata IS NULL").select("path", "start_line", "end_line", F.sha2("text", 256).alias("sha256"))


@query()
def chunk_line_pieces(spark, sf):
    """What chunk_windows leaves out, whose SQL doesn't express the splitter: the pieces of lines over CHUNK_BYTES."""
    records = chunking.chunk_records(document_files(table(spark, sf, "documents"))).where("kind <> 'file' AND metadata IS NOT NULL")
    piece = F.row_number().over(Window.partitionBy("path", "start_line").orderBy("ordinal"))
    return records.select("path", F.col("start_line").alias("line"), piece.alias("piece"), F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
s AS (SELECT doc_id, line, i, unnest(range(greatest((i - 19) // 20, 0), i // 20 + 1)) AS w FROM l)
SELECT doc_id, w AS window_no, min(i) + 1 AS start_line, max(i) + 1 AS end_line, sum(length(line)) AS chars FROM s WHERE i BETWEEN w * 20 AND w * 20 + 23 GROUP BY doc_id, w""")
def chunk_fixed(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    w = F.explode(F.sequence(F.greatest(F.expr("(i - 19) div 20"), F.lit(0)), F.expr("i div 20"))).alias("window_no")
    s = lines.select("doc_id", F.col("i").cast("long").alias("i"), "line", w).where("i BETWEEN window_no * 20 AND window_no * 20 + 23")
    return s.groupBy("doc_id", "window_no").agg((F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
h AS (SELECT doc_id, i, line FROM l WHERE regexp_matches(line, '^[A-ZÉÈ][^ ]* [a-z]')), n AS (SELECT doc_id, max(i) AS n FROM l GROUP BY doc_id)
SELECT doc_id, i AS start_line, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, n) AS end_line, line AS title FROM h JOIN n USING (doc_id)""")
def markdown_sections(spark, sf):
    """Sections of heading lines (here: lines that start a sentence), each to before the next."""
    lines = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n"), F.posexplode(F.split("text", "\n", -1)).alias("i", "title"))
    heads = lines.where(F.col("title").rlike("^[A-ZÉÈ][^ ]* [a-z]")).withColumn("start_line", (F.col("i") + 1).cast("long"))
    nxt = F.lead("start_line").over(Window.partitionBy("doc_id").orderBy("start_line"))
    return heads.select("doc_id", "start_line", F.coalesce(nxt - 1, F.col("n")).alias("end_line"), "title")


EVIDENCE = [["license", "licensed"], ["version"], ["token"]]


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
b AS (SELECT doc_id, i, regexp_extract_all(lower(line || ' ' || regexp_replace(regexp_replace(line, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '([\p{{L}}\p{{N}}])(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+') AS w FROM l),
g AS (SELECT doc_id, i, {", ".join(f"list_has_any(w, {group!r})::INT AS g{k}" for k, group in enumerate(EVIDENCE))} FROM b),
s AS (SELECT doc_id, i, {" + ".join(f"max(g{k}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)" for k in range(3))} AS n FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM s)
SELECT doc_id, CAST(n AS INTEGER) AS evidence_terms, CAST(CASE WHEN n > 0 THEN i ELSE -1 END AS INTEGER) AS evidence_line FROM o WHERE r = 1""")
def evidence_window(spark, sf):
    return citation.evidence(table(spark, sf, "documents").select("doc_id", "text"), EVIDENCE).select("doc_id", "evidence_terms", "evidence_line")


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(substr(t, 1, 240), '^\s+|\s+$', '', 'g') || '…' END AS excerpt FROM t""")
def excerpt_budget(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text"), T.excerpt_limit(10)).alias("excerpt"))


#: Cases: languages; results: the documents of a case by length; truth: its labelled good documents of source src1.
_CASES = f"""
results AS (SELECT lang AS case_id, {PATH} AS path, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 60),
truth AS (SELECT lang AS case_id, {PATH} AS path FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
sizes AS (SELECT case_id, count(*) AS n FROM truth GROUP BY case_id),
got AS (SELECT r.*, t.path IS NOT NULL AS hit FROM results r LEFT JOIN truth t USING (case_id, path) WHERE rank <= 20),
metrics AS (SELECT case_id, round(count(*) FILTER (hit AND rank <= 10) / n, 9) AS recall_at_10, round(coalesce(1.0 / min(rank) FILTER (hit), 0.0), 9) AS mrr, round(avg((NOT hit)::INT), 9) AS noise_at_20 FROM sizes JOIN got USING (case_id) GROUP BY case_id, n)"""


def _metrics(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", F.concat("lang", F.lit("/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))
    results = d.select(F.col("lang").alias("case_id"), "path", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank")).where("rank <= 60")
    truth = d.join(table(spark, sf, "labels").where("quality = 1"), "doc_id").select(F.col("lang").alias("case_id"), "path")
    return evaluate.case_metrics(results, truth)


@query(f"WITH {_CASES} SELECT * FROM metrics")
def eval_recall_mrr_noise(spark, sf):
    return _metrics(spark, sf)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def eval_percentiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(evaluate.percentile("value", 0.5).alias("p50"), evaluate.percentile("value", 0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {_CASES} SELECT CASE WHEN case_id = 'en' THEN 'large' ELSE 'small' END AS class, 'lexical' AS mode, round(avg(recall_at_10), 9) AS recall_at_10, round(avg(mrr), 9) AS mrr, count(*) AS cases FROM metrics GROUP BY 1")
def ablation_by_class(spark, sf):
    return evaluate.by_class(_metrics(spark, sf).withColumn("class", F.when(F.col("case_id") == "en", "large").otherwise("small")).withColumn("mode", F.lit("lexical")))


@query("SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM pages) AS records, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM conversations) AS diagnostics")
def counts_summary(spark, sf):
    out = None
    for name, alias in (("documents", "files"), ("pages", "records"), ("embeddings", "vectors"), ("conversations", "diagnostics")):
        one = table(spark, sf, name).agg(F.count("*").alias(alias))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


@query()
def hybrid_search(spark, sf):
    """A planned query end to end: lexical lanes with phrase and path lanes, fused, cited."""
    from .search import search_records

    records = _records(spark, sf).withColumn("end_line", F.size(F.split("text", "\n", -1)))
    return search_records(records, "license token src3", limit=10)
