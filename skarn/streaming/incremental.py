"""Incremental indexing as a stream: new files since the last run become records of the next version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunking import chunk_records
from ..operators.snapshot import Store, apply_batch


def index_new_files(spark: SparkSession, files: DataFrame, store: Store, checkpoint: str) -> None:
    """Runs a stream of files(path, content) until nothing is left, each batch a new version.

    The stream's checkpoint remembers what was read.  Of a path's rows in one batch the greatest
    content by its hash counts, and a batch that is run again, whose number the last version
    tells, is passed over, so the result doesn't change."""

    def apply(batch: DataFrame, number: int) -> None:
        now = store.version()
        if now is not None and now.get("batch", -1) >= number:
            return
        hashed = batch.withColumn("content_hash", T.content_hash(F.col("content")))
        order = Window.partitionBy("path").orderBy(F.desc_nulls_last("content_hash"))
        latest = hashed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        new = latest.select("path", T.kind(F.col("path")).alias("kind"), "content_hash")
        apply_batch(store, new, chunk_records(latest), batch=number)

    files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
