"""Exact deduplication: 128-bit content hash, bytes compared inside the groups that share one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import cut, without_white


#: Rows of a group that one task joins; the larger groups, at most one for as many rows of the table, are broadcast.
SPLIT = 100_000


def content_hash(norm: Column) -> Column:
    """The first 128 bits, as binary, by which texts are grouped."""
    return F.unhex(F.md5(norm))


def _keyed(docs: DataFrame, key: Callable[[Column], Column], *more: Column) -> DataFrame:
    norm = without_white(F.col("text"))
    return docs.select(
        *more, F.col("doc_id").alias("__id"), key(norm).alias("__h"), F.sha2(norm, 256).alias("__sha"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("__cp"), norm.alias("__norm"),
    )


def classes(docs: DataFrame, key: Callable[[Column], Column] = content_hash) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): each row's keys and number, and one row per set of equal texts with the row that stays.

    Rows of a few bytes are grouped by hash and, within it, by SHA-256; a group of copies
    meets as one row a task, since the grouping combines before its shuffle. Texts whose
    hash occurs twice are then read again and their bytes compared: should two different
    texts share both hashes, the job stops.
    """
    rows = cut(_keyed(docs, key).drop("__norm").withColumn("__row", F.monotonically_increasing_id()))
    keep = F.max(F.struct(F.col("__cp"), (-F.col("__id")).alias("__neg"), (-F.col("__row")).alias("__first"))).alias("__keep")
    groups = rows.groupBy("__h", "__sha").agg(F.count(F.lit(1)).alias("__n"), keep)
    # a table, so that the join of texts with it can be split where a hash is common
    twice = cut(groups.groupBy("__h").agg(F.sum("__n").alias("__all")).filter("__all > 1").select("__h"))
    same = _keyed(docs, key).join(twice, "__h", "left_semi").groupBy("__h", "__sha", "__norm").agg(F.count(F.lit(1)).alias("__rows"))
    texts = same.groupBy("__h", "__sha").agg(F.count(F.lit(1)).alias("__texts"))
    checked = groups.join(texts, ["__h", "__sha"], "left").withColumn(
        "__n", F.when(F.col("__texts") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("long")).otherwise(F.col("__n")))
    return rows, cut(checked.select("__h", "__sha", "__n", F.col("__keep.__cp").alias("__keep_cp"), (-F.col("__keep.__neg")).alias("__keep_id"), (-F.col("__keep.__first")).alias("__keep_row")))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with their group's columns. Of groups over SPLIT rows, of which there are few, the rows are dealt over as many tasks as they need."""
    parts = F.greatest(F.ceil(F.col("__n") / SPLIT), F.lit(1)).cast("long")
    large = groups.filter(F.col("__n") > SPLIT).select("__h", "__sha", parts.alias("__parts"))
    dealt = rows.join(F.broadcast(large), ["__h", "__sha"], "left").withColumn("__part", F.pmod(F.xxhash64("__row"), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    return dealt.join(groups.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), ["__h", "__sha", "__part"])


def exact_duplicates(docs: DataFrame, key: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space; of equal texts the row with the
    most code points in its original text stays, then the smallest doc_id, and one of rows
    that repeat it. A null text counts as empty; empty texts are equal to each other. A null
    doc_id is passed on and loses to any other; keep_id is null only in a group without any
    doc_id. Every row counts in group_size and one row of each group is kept. Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    rows, groups = classes(docs, key)
    return _with_groups(rows, groups).select(
        F.col("__id").alias("doc_id"), F.col("__keep_id").alias("keep_id"), F.col("__n").alias("group_size"),
        (F.col("__row") == F.col("__keep_row")).alias("kept"), F.col("__sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, key: Callable[[Column], Column] = content_hash) -> DataFrame:
    """docs with one row of each set of equal texts, all columns as they were.

    The row that stays is that of exact_duplicates(); of rows that repeat its doc_id, one.
    """
    rows, groups = classes(docs, key)
    keep = groups.join(
        rows.groupBy("__h", "__sha", "__cp", F.col("__id")).agg(F.count(F.lit(1)).alias("__reps")),
        (groups["__h"] == rows["__h"]) & (groups["__sha"] == rows["__sha"]) & groups["__keep_id"].eqNullSafe(rows["__id"]) & (groups["__keep_cp"] == rows["__cp"]),
    ).select(groups["__h"], groups["__sha"], "__keep_id", "__keep_cp", "__reps")
    keep = cut(keep)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    full = _keyed(docs, key, *(docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names))).drop("__norm")
    held = full.join(keep, ["__h", "__sha"]).filter("__id <=> __keep_id and __cp = __keep_cp")
    out = held.filter("__reps = 1").unionByName(held.filter("__reps > 1").dropDuplicates(["__h", "__sha"]))
    return out.select(*names).toDF(*docs.columns)
