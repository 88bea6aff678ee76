"""URL filters by a temporal list join, in DataFrame operations.

Dated list entries (key, action, date) become validity intervals: an entry holds from its date
until the key's next entry.  Every capture asks for its keys (host and path's first segment, host,
parent domains) at its fetch date: an as-of join.  A key's intervals are one row, an array in the
order of time, so that a question meets one row and takes the interval of its date from it.
Captures of one host, segment and date ask once, however many they are; keys and captures that
are most of all rows are spread over tasks.  The most specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, spread_join

ACTIONS = ("block", "allow", "remove")


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (key, action, since, until) from (key, action, date); until is open where null.

    Null keys, dates and unknown actions are left out.  Of several entries of a key and date the
    last by name counts (remove over block over allow)."""
    known = entries.where(F.col("key").isNotNull() & F.col("date").isNotNull() & F.col("action").isin(*ACTIONS))
    daily = known.groupBy("key", F.col("date").alias("since")).agg(F.max("action").alias("action"))
    return daily.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))


def url_parts(url):
    """Columns (host, segment) of a URL column: lower-case host without user and port, first path segment."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    return host, segment


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """A row per row of ``captures``: page_id, host, fetch_date, verdict, matched_key, entry_date.

    ``captures`` has page_id, url and fetch_date; other columns are ignored.  verdict is block,
    allow or none.  A url that is null or has no host, and a null date, get none; so do all captures
    where the list is empty.  Rows that repeat stay.  An empty table gives an empty result.
    """
    host, segment = url_parts(F.coalesce("url", F.lit("")))
    asked = captures.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), segment.alias("segment"), F.col("fetch_date").cast("date").alias("fetch_date"))
    able = (F.col("host") != "") & F.col("fetch_date").isNotNull()
    once = asked.where(able).groupBy("host", "segment", "fetch_date").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("key")))
    exact = F.when(F.col("segment") != "", F.array(F.struct(F.lit(0).alias("depth"), F.concat("host", F.lit("/"), "segment").alias("key")))).otherwise(F.array().cast("array<struct<depth:int,key:string>>"))
    alone = F.array(F.struct(F.lit(1).alias("depth"), F.col("host").alias("key")))
    keys = once.withColumn("k", F.explode(F.concat(exact, F.when(F.size(labels) > 1, parents).otherwise(alone)))).select("host", "segment", "fetch_date", "k.depth", "k.key")
    keys = checkpoint(keys)
    line = intervals(entries).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("since", "until", "action"))).alias("line"))
    line = line.join(keys.groupBy("key").agg(F.count("*").alias("n")), "key")
    held = F.get(F.filter("line", lambda x: (x["since"] <= F.col("fetch_date")) & (x["until"].isNull() | (F.col("fetch_date") < x["until"]))), F.lit(0))
    active = spread_join(keys, line, keys.count(), ["key"]).withColumn("i", held).where("i.action <> 'remove'")
    best = active.groupBy("host", "segment", "fetch_date").agg(F.min_by(F.struct("i.action", "key", "i.since"), "depth").alias("b"))
    told = once.join(best, ["host", "segment", "fetch_date"], "left")
    out = spread_join(asked.where(able), told, asked.where(able).count(), ["host", "segment", "fetch_date"]).unionByName(asked.where(~F.coalesce(able, F.lit(False))), allowMissingColumns=True)
    return out.select("page_id", "host", "fetch_date", F.coalesce("b.action", F.lit("none")).alias("verdict"), F.col("b.key").alias("matched_key"), F.col("b.since").alias("entry_date"))


def dated_list(hosts: DataFrame) -> DataFrame:
    """A list (key, action, date) by a fixed rule over hosts, for tables that come without one.

    Two hexadecimal digits of the key's MD5 say whether it is listed and the next say when; hosts,
    their parent domains and their ``en`` and ``de`` sections are keys."""
    parent = F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host"))
    keys = hosts.select(F.explode(F.array("host", parent, F.concat("host", F.lit("/en")), F.concat("host", F.lit("/de")))).alias("key")).distinct()
    digits = lambda a, n: F.conv(F.substring(F.md5(F.col("key")), a, n), 16, 10).cast("int")
    day = lambda a: F.date_add(F.lit("2024-01-01").cast("date"), digits(a, 2))
    listed = keys.where(digits(1, 2) < 96)
    first = listed.select("key", F.when(digits(3, 1) < 10, "block").otherwise("allow").alias("action"), day(4).alias("date"))
    later = listed.where(digits(6, 1) < 8).select("key", F.lit("remove").alias("action"), F.date_add(day(4), digits(7, 2) + 1).alias("date"))
    again = listed.where(digits(6, 1) < 3).select("key", F.lit("block").alias("action"), F.date_add(day(4), digits(7, 2) + 31).alias("date"))
    return first.unionByName(later).unionByName(again)
