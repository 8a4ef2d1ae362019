"""URL filters: dated list entries become validity intervals, and captures meet those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days in a time bucket; an interval is posted under each bucket that it touches.
BUCKET_DAYS = 32
#: Captures of a host and bucket that one task joins; larger ones, at most one for as many captures, are broadcast.
SPLIT = 100_000


def host(url: Column) -> Column:
    """The lower-case host of an http(s) URL without user, port and final dot; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def host_suffixes(h: Column) -> Column:
    """A host and its parent domains down to two labels: a.b.example.org, b.example.org, example.org."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (pattern, action, at) as validity intervals (pattern, category, since, until), until exclusive.

    `add` opens an interval in its category and replaces the one before; `remove` closes it.
    Among entries of one pattern and time, removals come first and the last category in
    order holds. until is null while the last entry stands. Entries with a null pattern or
    time, or another action, say nothing. Repeated entries change nothing.
    """
    valid = entries.filter("pattern is not null and at is not null and action in ('add', 'remove')")
    one = valid.groupBy(F.lower("pattern").alias("pattern"), "at").agg(F.max(F.struct((F.col("action") == "add").alias("on"), F.col("category"))).alias("e"))
    nxt = F.lead("at").over(W.partitionBy("pattern").orderBy("at"))
    return one.select("pattern", "e.on", "e.category", F.col("at").alias("since"), nxt.alias("until")).filter("on").drop("on")


def filter_captures(captures: DataFrame, entries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Every capture (id, url, fetched) with the verdict of the list as it stood at fetch time.

    Returns id, url, fetched, blocked, pattern, category: pattern is the most specific host or
    parent domain (most labels, then code-point order) with an interval that holds at fetched,
    null where none does. A null url, one without a host or a null fetched is never blocked.
    Repeated captures each get a row; without entries nothing is blocked.

    The as-of join is an equality on (pattern, time bucket) plus the interval's bounds.
    Bucketing by time splits a host that holds a large share of all captures and bounds the
    entries that one capture meets. Intervals are posted only within the captures' own range
    of fetch times, two numbers that the driver reads beforehand.
    """
    bucket = lambda t: F.floor(F.unix_timestamp(t) / (86_400 * bucket_days))
    caps = captures.select("id", "url", F.col("fetched").cast("timestamp").alias("fetched"))
    first, last = caps.agg(F.min(bucket(F.col("fetched"))), F.max(bucket(F.col("fetched")))).first()
    keyed = caps.withColumn("__host", host(F.col("url"))).withColumn("__bucket", bucket(F.col("fetched")))
    # (host, bucket) pairs are looked up in the list, not each capture's every suffix; those with very many captures are dealt over tasks
    pairs = keyed.filter("__host is not null and __bucket is not null").groupBy("__host", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    parts = F.greatest(F.ceil(F.col("__n") / SPLIT), F.lit(1)).cast("long")
    large = pairs.filter(F.col("__n") > SPLIT).select("__host", "__bucket", parts.alias("__parts"))
    keyed = keyed.join(F.broadcast(large), ["__host", "__bucket"], "left").withColumn("__part", F.pmod(F.xxhash64("id", "url", "fetched"), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    asked = pairs.withColumn("pattern", F.explode(host_suffixes(F.col("__host"))))
    since = F.greatest(bucket(F.col("since")), F.lit(first).cast("long"))
    until = F.least(F.coalesce(bucket(F.col("until")), F.lit(last)), F.lit(last)).cast("long")
    listed = intervals(entries).withColumn("__bucket", F.explode(F.when(since <= until, F.sequence(since, until))))
    active = asked.join(listed, ["pattern", "__bucket"]).groupBy("__host", "__bucket", "__n").agg(
        F.sort_array(F.collect_list(F.struct((-F.size(F.split("pattern", r"\."))).alias("__labels"), "pattern", "category", "since", "until"))).alias("__active"))
    holds = F.filter("__active", lambda e: (e["since"] <= F.col("fetched")) & (e["until"].isNull() | (F.col("fetched") < e["until"])))
    active = active.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    judged = keyed.join(active, ["__host", "__bucket", "__part"], "left").withColumn("__hit", F.get(holds, F.lit(0)))
    return judged.select("id", "url", "fetched", F.col("__hit").isNotNull().alias("blocked"), F.col("__hit.pattern").alias("pattern"), F.col("__hit.category").alias("category"))
