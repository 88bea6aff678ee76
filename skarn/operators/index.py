"""The inverted index: compact rows of records and postings by term, read instead of the texts.

``records`` holds what lanes order by (no text), ``postings`` the frequency and the places of a term
in each column of a record, sorted by term so that a query's terms prune what is read.  Both are
made once per version of the records; without them the same counts come from one scan.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T

#: Columns of a record that lanes read.
SLIM = ["record_id", "path", "start_line", "kind", "source"]


def lexical_records(records: DataFrame) -> DataFrame:
    """Records that don't opt out of the token index."""
    return records.where(T.flag(F.col("metadata"), "lexical", True)) if "metadata" in records.columns else records


def slim(records: DataFrame) -> DataFrame:
    """The records with what lanes need in place of their texts: ``tokens`` counts those of all columns."""
    length = reduce(add, (F.size(T.tokens(F.coalesce(F.col(c), F.lit("")))) for c in model.COLUMN_WEIGHTS))
    return records.select(*SLIM, length.alias("tokens"))


def postings(records: DataFrame) -> DataFrame:
    """(term, record_id, column, places): a row for each term of a column of a record, in one shuffle."""
    each = [records.select("record_id", F.lit(c).alias("column"), F.posexplode(T.tokens(F.coalesce(F.col(c), F.lit("")))).alias("place", "term")) for c in model.COLUMN_WEIGHTS]
    return reduce(DataFrame.unionByName, each).groupBy("term", "record_id", "column").agg(F.sort_array(F.collect_list("place")).alias("places"))


def write_index(records: DataFrame, folder: str) -> None:
    """Writes both tables; postings in ranges of terms, each sorted, so that filters on terms skip files and row groups."""
    known = lexical_records(records)
    slim(known).write.mode("overwrite").parquet(f"{folder}/records")
    postings(known).repartitionByRange("term", "record_id").sortWithinPartitions("term", "record_id").write.mode("overwrite").parquet(f"{folder}/postings")


class Index:
    """An index that ``write_index`` wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.records = spark.read.parquet(f"{folder}/records")
        self.postings = spark.read.parquet(f"{folder}/postings")

    def counts(self, units: list[list[str]]) -> DataFrame:
        """Records with f0, f1, ...: the weighted frequencies of units, each a term or a phrase; 0 where there are none.

        Only the units' terms are read."""
        terms = sorted({t for u in units for t in u})
        found = self.postings.where(F.col("term").isin(terms)).groupBy("record_id", "column").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
        weight = reduce(lambda c, w: c.when(F.col("column") == w[0], w[1]), model.COLUMN_WEIGHTS.items(), F.when(F.lit(False), 0.0))
        each = found.groupBy("record_id").agg(*(F.sum(weight * _places(F.col("at"), u)).alias(f"f{k}") for k, u in enumerate(units)))
        return self.records.join(each, "record_id", "left").fillna(0.0, [f"f{k}" for k in range(len(units))])


def _places(at: Column, unit: list[str]) -> Column:
    """How often a unit's terms stand one after the other, from their places."""
    empty = F.array().cast("array<int>")
    back = lambda k: lambda place: place - k
    starts = [F.transform(F.coalesce(at[t], empty), back(k)) for k, t in enumerate(unit)]
    return F.size(reduce(F.array_intersect, starts)).cast("double")


def scan_counts(records: DataFrame, units: list[list[str]]) -> DataFrame:
    """The same from the texts, in one scan; ``records`` keeps further columns that a scan is to judge."""
    from .lanes import _count, _let

    counted = records
    for c in model.COLUMN_WEIGHTS:
        tokens = T.tokens(F.coalesce(F.col(c), F.lit("")))
        counted = counted.withColumn(f"_c_{c}", _let(tokens, lambda t: F.array(F.size(t), *(_count(t, u) for u in units))))
    f = {f"f{k}": reduce(add, (F.col(f"_c_{c}")[k + 1] * F.lit(float(w)) for c, w in model.COLUMN_WEIGHTS.items())) for k in range(len(units))}
    length = reduce(add, (F.col(f"_c_{c}")[0] for c in model.COLUMN_WEIGHTS))
    return counted.withColumns({"tokens": length, **f}).drop(*(f"_c_{c}" for c in model.COLUMN_WEIGHTS))
