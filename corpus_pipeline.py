"""A corpus pipeline: five stages of skarn.llm, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.llm import mixing, quality
from skarn.llm.common import checkpoint, column, free, shared_folder, sieve, table
from skarn.llm.decontaminate import decontaminate
from skarn.llm.ngram_join import ngram_jaccard_join
from skarn.llm.secret_scan import secret_scan_in_place


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.quality_filter(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least doc_id.

    Rows without doc_id stay.  Rows that repeat a doc_id are one document and leave one row: that of
    the least text, a null text last; of equal texts, that of the least other columns."""
    found = ngram_jaccard_join(docs, k=5, percent=80)
    rows, gone = free(docs.columns, "rows"), free(docs.columns, "gone")
    told = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias(rows), F.max(F.col("doc_id") != F.col("component_id")).alias(gone))
    special = checkpoint(told.where(column(gone) | (column(rows) > 1)))
    # Only documents that may go or repeat are shuffled.
    asked = sieve(special.select(F.xxhash64("doc_id")), special.count())(F.xxhash64(F.col("doc_id").cast("long")))
    asked = F.col("doc_id").isNotNull() & asked
    out = docs.where(asked).join(special, "doc_id", "left").where(~F.coalesce(column(gone), F.lit(False)))
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.to_json(F.struct(*map(column, docs.columns))))
    repeated = out.where(column(rows) > 1).withColumn(rows, F.row_number().over(order))
    one = out.where(column(rows).isNull()).unionByName(repeated.where(column(rows) == 1))
    return docs.where(~asked).unionByName(one.select(*map(column, docs.columns)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars to match."""
    return secret_scan_in_place(docs, mask="<SECRET>")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, their posteriors by domain and the rate at which each is to be drawn."""
    model = mixing.train(docs, table(spark, sf_dir, "labels"), list(mixing.TARGETS))
    return mixing.mix_to_targets(docs, model, mixing.TARGETS, keep_text=True)[0]


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: No SQL: three stages rest on trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
