"""Ordered selection: blocks of file numbers, tail splits, thinning, quotas; all deterministic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Numbers of an ordering column that go into one bucket.
SPAN = 1 << 18


def name_number(stem: Column) -> tuple[Column, Column]:
    """Prefix and trailing number of a stem; without digits the whole stem and -1."""
    digits = F.regexp_extract(stem, r"(\d+)$", 1)
    return F.regexp_replace(stem, r"\d+$", ""), F.when(digits == "", -1).otherwise(digits.cast("long"))


def in_blocks(numbered: DataFrame, key: Sequence[str], number: str, gap: int = 30, ties: Sequence[str] = ()) -> DataFrame:
    """numbered with block, the running number of a row's island among those of its key: steps of numbers inside are at most gap.

    Negative numbers stand alone; rows of one number go by ties. Numbers are looked at in
    buckets of SPAN; each bucket gets the last number before it and how many blocks have
    begun there, so that a key which holds a whole table spreads over tasks.
    """
    dealt = numbered.withColumn("__bucket", F.floor(F.col(number) / SPAN))
    before = W.partitionBy(*key).orderBy("__bucket")
    inside = W.partitionBy(*key, "__bucket").orderBy(number, *ties)

    def joined(rows: DataFrame, ends: DataFrame) -> DataFrame:
        names = [f"__of{i}" for i in range(len(key) + 1)]
        ends = ends.select(*(F.col(c).alias(m) for c, m in zip((*key, "__bucket"), names)), *(c for c in ends.columns if c not in (*key, "__bucket")))
        return rows.join(ends, [F.col(c).eqNullSafe(F.col(m)) for c, m in zip((*key, "__bucket"), names)]).drop(*names)

    last = dealt.groupBy(*key, "__bucket").agg(F.max(number).alias("__top")).select(*key, "__bucket", F.lag("__top").over(before).alias("__prev"))
    step = F.col(number) - F.coalesce(F.lag(number).over(inside), "__prev")
    flagged = joined(dealt, last).withColumn("__new", F.when(step.isNull() | (step > gap) | (F.col(number) < 0), 1).otherwise(0)).drop("__prev")
    begun = flagged.groupBy(*key, "__bucket").agg(F.sum("__new").alias("__own")).select(*key, "__bucket", F.coalesce(F.sum("__own").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    running = joined(flagged, begun).withColumn("block", F.col("__start") + F.sum("__new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return running.drop("__bucket", "__new", "__start")


def blocks(numbered: DataFrame, key: Sequence[str], number: str, gap: int = 30) -> DataFrame:
    """Gaps and islands: key, block (running number), first, last and n of every island of in_blocks()."""
    return in_blocks(numbered, key, number, gap).groupBy(*key, "block").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """df with __rank, the place of a row among those of its key from 0 in order, and __n, how many these are.

    A key may hold most of a table: its rows are numbered inside buckets, and each bucket
    starts behind those before it, of which there is a count each. bucket has to grow with
    the order; by default the first column of order is a number and SPAN of them go together.
    """
    cut = F.floor(F.col(order[0]) / SPAN) if bucket is None else bucket
    dealt = df.withColumn("__bucket", cut)
    counts = dealt.groupBy(*key, "__bucket").agg(F.count(F.lit(1)).alias("__own"))
    of = W.partitionBy(*key)
    before = of.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    start, n = F.coalesce(F.sum("__own").over(before), F.lit(0)), F.sum("__own").over(of)
    names = [f"__of{i}" for i in range(len(key) + 1)]
    starts = counts.select(*(F.col(c).alias(m) for c, m in zip((*key, "__bucket"), names)), start.alias("__start"), n.alias("__n"))
    same = [F.col(c).eqNullSafe(F.col(m)) for c, m in zip((*key, "__bucket"), names)]
    joined = dealt.join(starts, same).drop(*names)
    inside = F.row_number().over(W.partitionBy(*key, "__bucket").orderBy(*order)) - 1
    return joined.withColumn("__rank", F.col("__start") + inside).drop("__bucket", "__start")


def tail_split(df: DataFrame, key: Sequence[str], order: Sequence[str], ratio: float) -> DataFrame:
    """df with split: of each key, in order, the last int(n * ratio) rows are val, the others train."""
    val = F.col("__rank") >= F.col("__n") - F.floor(F.col("__n") * ratio)
    return numbered(df, key, order).withColumn("split", F.when(val, "val").otherwise("train")).drop("__rank", "__n")


def thinned(df: DataFrame, key: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """At most `most` rows of each key, evenly spread: rows floor(i * n / most) in order; all where there are no more."""
    # row r is taken when some i has floor(i * n / most) = r, that is when the next multiple lies below r + 1
    i = F.ceil(F.col("__rank") * most / F.col("__n"))
    hit = (i < most) & (F.floor(i * F.col("__n") / most) == F.col("__rank"))
    return numbered(df, key, order).filter((F.col("__n") <= most) | hit).drop("__rank", "__n")


def strided(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Every max(1, size // n)-th row of each key in order, n at most."""
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / n))
    return numbered(df, key, order).filter((F.col("__rank") % step == 0) & (F.col("__rank") / step < n)).drop("__rank", "__n")


def draw(seed: int | str, *keys: str) -> Column:
    """A reproducible order for sampling: md5 of seed and keys, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def _drawn_bucket(of: Column) -> Column:
    """The first three digits of a draw: 4,096 buckets in its order."""
    return F.conv(F.substring(of, 1, 3), 16, 10).cast("int")


def pool_quota(df: DataFrame, pool: str, key: str, predicate: Column, total: int, pools: int, scan: int = 600, seed: int = 0) -> DataFrame:
    """max(1, total // pools) rows of each pool: in drawn order, among the first `scan`, those with predicate."""
    drawn = df.withColumn("__draw", draw(seed, pool, key))
    scanned = numbered(drawn, [pool], ["__draw"], _drawn_bucket(F.col("__draw"))).filter(F.col("__rank") < scan).filter(predicate)
    return scanned.withColumn("pick", F.row_number().over(W.partitionBy(pool).orderBy("__rank"))).filter(F.col("pick") <= max(1, total // pools)).drop("__rank", "__n", "__draw")


def positives_with_background(df: DataFrame, split: str, key: str, positive: Column, n: int, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Of each split, in drawn order, n positives and int(share * positives) of the negatives met before the last of them.

    Positives and negatives are numbered apart, each in buckets of the draw; the n-th
    positive's draw tells which negatives lie before it.
    """
    drawn = df.withColumns({"positive": positive, "__draw": draw(seed, split, key)})
    ranked = numbered(drawn, [split, "positive"], ["__draw"], _drawn_bucket(F.col("__draw")))
    picked = ranked.filter(F.col("positive") & (F.col("__rank") < n))
    totals = drawn.groupBy(F.col(split).alias("__split")).agg(F.count_if("positive").alias("__total"))
    last = picked.groupBy(F.col(split).alias("__of")).agg(F.max(F.when(F.col("__rank") == n - 1, F.col("__draw"))).alias("__last"))
    ends = totals.join(last, F.col("__split") == F.col("__of"), "left").select("__split", F.floor(F.least(F.col("__total"), F.lit(n)) * share).alias("__most"), "__last")
    before = ranked.filter(~F.col("positive")).join(ends, F.col(split) == F.col("__split"))
    negatives = before.filter((F.col("__rank") < F.col("__most")) & (F.col("__last").isNull() | (F.col("__draw") < F.col("__last"))))
    return picked.unionByName(negatives.select(picked.columns)).drop("__rank", "__n", "__draw")
