"""Tables and corpora as files and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_path():
    return F.concat("lang", F.lit("/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))


def document_files(docs: DataFrame) -> DataFrame:
    """files(doc_id, path, kind, content) of a documents table."""
    return docs.select("doc_id", document_path().alias("path"), F.col("lang").alias("kind"), F.col("text").alias("content"))


def document_records(docs: DataFrame) -> DataFrame:
    """One record per document, with the document's id."""
    return docs.select(F.col("doc_id").alias("record_id"), document_path().alias("path"), F.lit("text-chunk").alias("kind"), F.concat("lang", F.lit(" "), "source").alias("title"), "text", F.lit(1).alias("start_line"), "source")


def read_files(spark: SparkSession, root: str, ignore: list[str] | None = None, most: int = 4 << 20) -> DataFrame:
    """files(path, size, mtime_ns, kind, content, content_hash, reason) of a directory tree, read by Spark.

    Where a file is skipped, reason says why and content is null; dotenv files are redacted
    before anything else sees them.  The reader passes over the contents of files that are too large."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + T.quote(root.rstrip("/")) + "/", "")
    told = lambda rows, raw: rows.select(rel.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), raw.alias("raw"))
    files = told(base.where(F.col("length") <= most), F.col("content")).unionByName(told(base.where(F.col("length") > most), F.lit(None).cast("binary")))
    files = files.where(~T.ignored(F.col("path"), ignore or []))
    return checked(files, most)


def checked(files: DataFrame, most: int) -> DataFrame:
    """files(path, size, mtime_ns, raw) with raw judged and, where it passes, decoded and redacted."""
    reason = T.skip_reason(F.col("path"), F.col("size"), F.lit(True), F.col("raw"), most)
    content = F.when(reason.isNull(), F.when(T.is_env(F.col("path")), T.redact_env(F.col("raw").cast("string"))).otherwise(F.col("raw").cast("string")))
    return files.select("path", "size", "mtime_ns", T.kind(F.col("path")).alias("kind"), content.alias("content"), T.content_hash(content).alias("content_hash"), reason.alias("reason"))
