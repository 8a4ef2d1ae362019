"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.llm.common import cut

#: (region, rack, shard, weight) of each leaf.
Leaf = tuple[str, str, int, float]
ROWS_PER_BUCKET, MIN_BUCKETS = 65_536, 16


def base_tree(shards: int = 8, racks_per_region: int = 2, shards_per_rack: int = 2) -> list[Leaf]:
    """Shards of weight 1, filled rack by rack and region by region."""
    return [(f"r{s // shards_per_rack // racks_per_region}", f"k{s // shards_per_rack}", s, 1.0) for s in range(shards)]


def grown(tree: Sequence[Leaf], more: int = 1) -> list[Leaf]:
    """tree with more shards, each in a region of its own, so that no other subtree's weight changes."""
    top = max((s for _, _, s, _ in tree), default=-1) + 1
    return [*tree, *((f"g{s}", f"g{s}", s, 1.0) for s in range(top, top + more))]


def place(key: Column, tree: Sequence[Leaf], seed: int = 42) -> Column:
    """The shard of key: three weighted hash draws, down region, rack and shard.

    At each level every child draws -ln(u) / weight, u from a hash of seed, key and the
    child's path, and the least draw wins: children win in proportion to the weights below
    them. A child's draw depends on nothing but itself, so where no weight changes no row
    moves, and a subtree whose weight grows only takes rows. The tree is a literal of the
    plan, as large as the cluster's list of shards; a row looks at its own path's children.
    """
    below: dict[str, dict[str, float]] = {}
    shard: dict[str, int] = {}
    for region, rack, s, weight in tree:
        if weight <= 0:
            raise ValueError("weights are positive")
        path = f"{region}/{rack}/{s}"
        shard[path] = s
        for up, down in (("", region), (region, f"{region}/{rack}"), (f"{region}/{rack}", path)):
            below.setdefault(up, {}).setdefault(down, 0.0)
            below[up][down] += weight
    child = lambda d, w: F.struct(F.lit(d).alias("path"), F.lit(w).alias("weight"))
    children = F.create_map(*(x for up, downs in sorted(below.items()) for x in (F.lit(up), F.array(*(child(d, w) for d, w in sorted(downs.items()))))))
    text = F.coalesce(key.cast("string"), F.lit(""))

    def draw(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), text, c["path"])), 1, 12), 16, 10).cast("double")
        return F.struct((-F.ln((bits + 0.5) / float(2**48)) / c["weight"]).alias("draw"), c["path"].alias("path"))

    at: Column = F.lit("")
    for _ in range(3):
        at = F.array_min(F.transform(F.element_at(children, at), draw))["path"]
    return F.substring_index(at, "/", -1).cast("int")


def shard_documents(docs: DataFrame, tree: Sequence[Leaf] | None = None, seed: int = 42) -> DataFrame:
    """Places all documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: doc_id and the tree decide alone, so equal doc_ids share a shard whatever their
    texts. grown_shard is the place once one more shard is there. slot numbers a shard's rows
    from 0 without gaps, in order of hash bucket, doc_id, checksum and size: rows are numbered
    inside buckets of a bounded size and moved on by the counts of the buckets before, so no
    task holds a whole shard. Size is the UTF-8 length plus 1. A null text is empty and a null
    doc_id the empty key; repeated rows get slots of their own; an empty table gives no rows.
    Columns other than doc_id and text are ignored, whatever their names.
    """
    tree = base_tree() if tree is None else tree
    text = F.coalesce("text", F.lit(""))
    buckets = max(MIN_BUCKETS, -(-docs.count() // (ROWS_PER_BUCKET * len(tree))))
    placed = cut(docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        place(F.col("doc_id"), tree, seed).alias("shard"), place(F.col("doc_id"), grown(tree), seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(buckets)).alias("__bucket"),
    ))
    counts = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(W.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.join(starts, ["shard", "__bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + inside).cast("long").alias("slot"), "grown_shard")
