"""The queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id as languages
from . import mixing, quality
from .ann_forest import nearest
from .common import table
from .decontaminate import benchmark_matches
from .license_scan import TEMPLATES, license_scan, template_words
from .ngram_join import ngram_jaccard_join
from .secret_scan import secret_scan
from .substring_dedup import substring_dedup
from .url_filters import dated_list, url_filter, url_parts


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), keep_blocks=False).drop("blocks")


def op1_license_scan_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates over several lines too; the SQL of op1_license_scan looks at single lines."""
    return license_scan(table(spark, sf_dir, "documents"), keep_blocks=False, wrapped=True).drop("blocks")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=13, keep_text=False).drop("kept_text")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of documents, with posteriors by domain in columns, and what the fit leaves: the largest
    difference between a domain's share of tokens reached and wanted."""
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs, table(spark, sf_dir, "labels"), list(mixing.TARGETS))
    out, fitted = mixing.mix_to_targets(docs.select("doc_id", "text"), model, mixing.TARGETS)
    return out.select("doc_id", "n_tokens", *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(mixing.TARGETS)), "rate", F.lit(fitted.residual).alias("residual"), F.lit(fitted.converged).alias("converged"))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    model = languages.train(learn)
    return languages.language_id(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.quality_scores(docs.select("doc_id", "text", "source", "lang"), model, keep_text=False)
    return out.select("doc_id", "p_text", "host_rate", "path_rate", "score", "keep")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched on a day that follows from page_id, against a list made by rule from their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("fetch_date"))
    hosts = pages.select(url_parts(F.coalesce("url", F.lit("")))[0].alias("host")).where("host <> ''").distinct()
    return url_filter(pages, dated_list(hosts))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op1_license_scan_wrapped, op2_secret_scan, op3_substring_dedup, op4_ngram_jaccard_join, op5_mixing, op6_language_id, op7_decontamination, op8_ann_forest, op9_quality, op10_url_filters)
}


def _license_sql(threshold: float = 0.9) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    templates = ", ".join(f"('{label}', {sorted(set(template_words(t)))!r})" for label, t in TEMPLATES.items())
    return rf"""
WITH templates(label, words) AS (VALUES {templates}),
phrases(label, words) AS (VALUES ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']), ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM low),
places AS (
  SELECT doc_id, p.label, i - 1 AS place
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) d JOIN phrases p ON w[i] = p.words[1] AND list_slice(w, i, i + len(p.words) - 1) = p.words),
base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM low)),
found AS (
  SELECT doc_id, t.label, max(len(list_intersect(t.words, w)) / len(t.words)) AS share
  FROM lines l JOIN templates t ON len(w) >= ceil({threshold} * len(t.words)) AND len(list_intersect(t.words, w)) >= ceil({threshold} * len(t.words) - 1e-9)
  GROUP BY doc_id, t.label),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM places) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
FROM words LEFT JOIN base b USING (doc_id) LEFT JOIN labelled l USING (doc_id) LEFT JOIN best USING (doc_id)
"""


#: Every window of 13 words and the least doc_id in which it starts.
SUBSTRING_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
first AS (SELECT g, min(doc_id) AS d FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (g) WHERE d < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""

NGRAM_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (s)
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT reach.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY reach.doc_id
"""

URL_SQL = r"""
WITH captures AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetch_date
  FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
keys AS (
  SELECT host AS key FROM hosts UNION SELECT host || '/en' FROM hosts UNION SELECT host || '/de' FROM hosts
  UNION SELECT CASE WHEN len(string_split(host, '.')) > 2 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END FROM hosts),
listed AS (
  SELECT key, DATE '2024-01-01' + CAST(('0x' || substr(md5(key), 4, 2)) AS INTEGER) AS day, CAST(('0x' || substr(md5(key), 3, 1)) AS INTEGER) AS what,
    CAST(('0x' || substr(md5(key), 6, 1)) AS INTEGER) AS more, CAST(('0x' || substr(md5(key), 7, 2)) AS INTEGER) AS later
  FROM keys WHERE CAST(('0x' || substr(md5(key), 1, 2)) AS INTEGER) < 96),
entries AS (
  SELECT key, CASE WHEN what < 10 THEN 'block' ELSE 'allow' END AS action, day AS date FROM listed
  UNION ALL SELECT key, 'remove', day + later + 1 FROM listed WHERE more < 8
  UNION ALL SELECT key, 'block', day + later + 31 FROM listed WHERE more < 3),
daily AS (SELECT key, date, max(action) AS action FROM entries GROUP BY key, date),
asked AS (
  SELECT page_id, fetch_date, 0 AS depth, host || '/' || segment AS key FROM captures WHERE host <> '' AND segment <> ''
  UNION ALL
  SELECT page_id, fetch_date, k, array_to_string(list_slice(labels, k, len(labels)), '.')
  FROM (SELECT page_id, fetch_date, labels, unnest(range(1, greatest(len(labels), 2))) AS k FROM (SELECT page_id, fetch_date, string_split(host, '.') AS labels FROM captures WHERE host <> ''))),
active AS (
  SELECT page_id, depth, d.action, d.key, d.date FROM asked a ASOF JOIN daily d ON a.key = d.key AND a.fetch_date >= d.date WHERE d.action <> 'remove'),
best AS (SELECT page_id, arg_min(action, depth) AS action, arg_min(key, depth) AS key, arg_min(date, depth) AS date FROM active GROUP BY page_id)
SELECT page_id, host, fetch_date, coalesce(action, 'none') AS verdict, key AS matched_key, date AS entry_date FROM captures LEFT JOIN best USING (page_id)
"""

SQL: dict[str, str] = {"op1_license_scan": _license_sql(), "op3_substring_dedup": SUBSTRING_SQL, "op4_ngram_jaccard_join": NGRAM_SQL, "op10_url_filters": URL_SQL}
