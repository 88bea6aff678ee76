"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence comes from a softmax over its text (good, low, toxic), fitted on a
bounded sample of labelled documents.  Sites add theirs: the expected number of bad documents
per host and per path within the host, over all other documents, gives posteriors that shrink
toward the level above (path to host, host to the corpus) by a strength that the spread of the
sites between themselves tells (method of moments).  A document's own evidence is taken out of its
site's sums, so that it counts once.  The document's log odds move by how far its path's log odds
stand from the corpus's.  Texts are read and judged once; the sums are grouped aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classifier import Classifier
from .common import bounded_sample, checkpoint, column, free, lean, plainly, sample_texts, spread_join, with_fields, written
from .textkit import runs

LABELS = ["good", "low", "toxic"]
MAX_STRENGTH = 1e4
MAX_BROADCAST_SITES = 50_000
#: Toxic words come in many forms, each rare: more words per label and a weaker penalty than the classifier's defaults.
WORDS, PENALTY = 200, 1e-4


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> Classifier | None:
    """Fits on at most ``sample`` labelled documents, by a hash of doc_id, and as ``sample_texts`` bounds
    them; None without labels of two kinds.  Of labels that repeat a doc_id the worst counts."""
    labels = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("y"))
    first = bounded_sample(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y")), sample, "doc_id")
    docs = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = sample_texts(docs.join(F.broadcast(first), "doc_id"), sample)
    if len({r["y"] for r in rows}) < 2:
        return None
    return Classifier(LABELS, WORDS, PENALTY).fit([r["text"] for r in rows], np.array([r["y"] for r in rows]))


def _evidence(model: Classifier | None, name: str, text: str | None):
    """``text`` names the column of texts if it goes on, else None."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            p = [model.predict(texts.slice(i, j - i)) for i, j, _, _ in runs(texts)] if model is not None else []
            bad = 1 - np.vstack(p)[:, 0] if p else np.full(batch.num_rows, 0.0)
            kept = [c for c in batch.schema.names if c != "text" or text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bad, pa.float64())], names=[*kept, name])

    return run


def with_evidence(docs: DataFrame, model: Classifier | None, name: str = "p_text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``name``, the posterior of a text to be low or toxic; 0 without a model."""
    kept = docs if keep_text else docs.drop("text")
    return docs.mapInArrow(lean(_evidence(model, name, "text" if keep_text else None)), with_fields(kept.schema, f"`{name}` double"))


def _strength(n: Column, rate: Column, mean: Column) -> Column:
    """Prior strength by moments: binomial noise against the spread of the rates."""
    noise = F.sum(mean * (1 - mean))
    spread = F.sum(n * (rate - mean) * (rate - mean))
    excess = F.greatest(spread - noise, F.lit(0.0))
    size = F.sum(n) - F.sum(n * n) / F.sum(n)
    return F.least(F.coalesce(F.when(excess > 0, F.greatest(size / excess * F.max(mean * (1 - mean)) - 1, F.lit(1.0))), F.lit(MAX_STRENGTH)), F.lit(MAX_STRENGTH))


def site_sums(evidence: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Sums by site (host, path, n, bad, host_n, host_bad) of evidence(host, path, bad), and of the corpus:
    its rate and the strengths with which hosts and paths shrink.

    Grouped sums only; those per path are kept, as several levels read them."""
    paths = checkpoint(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("bad").alias("bad")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad"))
    total = hosts.agg(((F.sum("host_bad") + 0.5) / (F.sum("host_n") + 1)).alias("r")).first()["r"]
    base = 0.5 if total is None else total
    host_k = hosts.agg(_strength(F.col("host_n"), F.col("host_bad") / F.col("host_n"), F.lit(base)).alias("k")).first()["k"]
    both = paths.join(hosts, "host")
    host_rate = (F.col("host_bad") + host_k * base) / (F.col("host_n") + host_k)
    path_k = both.agg(_strength(F.col("n"), F.col("bad") / F.col("n"), host_rate).alias("k")).first()["k"]
    return checkpoint(both), {"base": base, "host_k": host_k, "path_k": path_k}


def site_rates(corpus: dict[str, float], n: Column, bad: Column, host_n: Column, host_bad: Column) -> tuple[Column, Column]:
    """(host_rate, path_rate) from sums, shrunk toward the corpus and the host."""
    host_rate = (host_bad + corpus["host_k"] * corpus["base"]) / (host_n + corpus["host_k"])
    return host_rate, (bad + corpus["path_k"] * host_rate) / (n + corpus["path_k"])


def _logit(x: Column) -> Column:
    x = F.greatest(F.least(x, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(x / (1 - x))


OUTPUTS = ("p_text", "host_rate", "path_rate", "score", "keep")


def _scored(docs: DataFrame, model: Classifier | None, host: str, path: str, reject: float, keep_text: bool) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with more columns, and the names that they have, free of those of ``docs``."""
    name: dict[str, str] = {}
    for wanted in (*OUTPUTS, "host", "path", "n", "bad", "host_n", "host_bad"):
        name[wanted] = free([*docs.columns, *name.values()], wanted)
    site = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    placed = docs.withColumns({name["host"]: site(host), name["path"]: site(path)})
    told = written(with_evidence(placed, model, name["p_text"], keep_text))
    sums, corpus = site_sums(told.select(column(name["host"]).alias("host"), column(name["path"]).alias("path"), column(name["p_text"]).alias("bad")))
    sites = sums.toDF(*(name[c] for c in sums.columns))
    keys = [name["host"], name["path"]]
    if sites.count() <= MAX_BROADCAST_SITES:
        joined = told.join(F.broadcast(sites), keys)
    else:  # the site of most documents isn't one task's
        joined = spread_join(told, sites, told.count(), keys, name["n"])
    own, (n, bad, host_n, host_bad) = column(name["p_text"]), (column(name[c]) for c in ("n", "bad", "host_n", "host_bad"))
    host_rate, path_rate = site_rates(corpus, n - 1, F.greatest(bad - own, F.lit(0.0)), host_n - 1, F.greatest(host_bad - own, F.lit(0.0)))
    score = 1 / (1 + F.exp(-(_logit(own) + _logit(path_rate) - _logit(F.lit(corpus["base"])))))
    out = joined.withColumns({name["host_rate"]: host_rate, name["path_rate"]: path_rate, name["score"]: score})
    return out.withColumn(name["keep"], column(name["score"]) <= reject), name


def quality_scores(docs: DataFrame, model: Classifier | None, host: str = "source", path: str = "lang", reject: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with all its columns and p_text, host_rate, path_rate, score and keep.

    score is the posterior of a document to be bad; keep is false where it is over ``reject``.
    ``host`` and ``path`` name columns; nulls are a site of their own.  Null and empty texts are
    judged as texts without words.  Without a model every document is kept.  Rows that repeat
    count as often as they stand there.  Where ``docs`` has a column of an output's name, in any
    case, the output stands in its place.  An empty table gives an empty result.  ``keep_text`` false
    leaves the texts out.
    """
    plain = plainly(docs)
    out, name = _scored(plain, model, host, path, reject, keep_text)
    kept = [(c, p) for c, p in zip(docs.columns, plain.columns, strict=True) if c.lower() not in OUTPUTS and (keep_text or c != "text")]
    return out.select(*(F.col(p) for _, p in kept), *(F.col(name[c]) for c in OUTPUTS)).toDF(*(c for c, _ in kept), *OUTPUTS)


def quality_filter(docs: DataFrame, model: Classifier | None, host: str = "source", path: str = "lang", reject: float = 0.5) -> DataFrame:
    """The documents that are kept, with their columns as they are, whatever their names."""
    plain = plainly(docs)
    out, name = _scored(plain, model, host, path, reject, True)
    return out.where(F.col(name["keep"])).select(*plain.columns).toDF(*docs.columns)
