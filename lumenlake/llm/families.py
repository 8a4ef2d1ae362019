"""Exact links inside families of candidate sets: pivots first, then only what pivots cannot settle, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import cut

#: Sets and elements that one block of a family holds, and columns of the incidence matrix at a time.
BLOCK, BLOCK_ELEMENTS, COLUMNS = 512, 4_000_000, 4096
#: Rounds of pivots before what is left of a family is compared whole.
ROUNDS = 2


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        at = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, at = [], k, i
        if at < len(keys):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that it reaches over the links (a, b)."""
    top = np.arange(n)
    while True:
        low = top.copy()
        np.minimum.at(low, a, top[b])
        np.minimum.at(low, b, top[a])
        low = low[low]
        if (low == top).all():
            return top
        top = low


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections, by incidence matrices over the elements that occur twice."""
    elements, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.cumsum(count > 1) - 1
    kept = count[index] > 1
    row, column = row[kept], common[index[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for k in range(0, int((count > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [k, k + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - k] = 1
        out += m @ m.T
    return out


def _dealt_into(block: int, elements: int) -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / elements)).cast("long").alias("blocks")


def _blocks(members: DataFrame, block: int, elements: int) -> DataFrame:
    """members (family, node, n, ...) with blocks, how many their family is dealt into, and own, the block of the row."""
    sizes = members.groupBy("family").agg(_dealt_into(block, elements))
    return members.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))


def _upto(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))


def _starred(members: DataFrame, sets: DataFrame, block: int, elements: int) -> DataFrame:
    """(family, node, n, pivot, m, both): each member's intersection with its family's pivot of m elements, which a hash draws.

    A family's members lie in blocks, each with a copy of the pivot's set in front, and a task
    takes them one after another, so it holds a pivot and a batch however large families are.
    """
    draw = F.struct(F.xxhash64("node", F.lit(5)).alias("draw"), F.col("node"), F.col("n"))
    # a table, so that the join with it can be split where a family is large
    pivots = cut(members.groupBy("family").agg(F.min(draw).alias("p"), F.count(F.lit(1)).alias("size"), _dealt_into(block, elements)).filter("size > 1").select("family", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"), "blocks"))
    dealt = members.join(pivots, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    heads = dealt.filter("node = pivot").withColumn("own", _upto("blocks"))
    rows = dealt.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)))
    rows = rows.join(sets.select("node", "held"), "node").withColumn("group", F.concat_ws("|", F.hex("family"), "own"))
    node, family = members.schema["node"].dataType.simpleString(), members.schema["family"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            keep, both = [], []
            held = batch.column("held").to_numpy(zero_copy_only=False)
            for i, (key, head) in enumerate(zip(batch.column("group").to_pylist(), batch.column("head").to_pylist())):
                if key != group:
                    group, pivot = key, np.sort(held[i])
                if not head:
                    at = np.minimum(np.searchsorted(pivot, held[i]), len(pivot) - 1)
                    keep.append(i)
                    both.append(int((pivot[at] == held[i]).sum()))
            some = batch.select(["family", "node", "n", "pivot", "m"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(both, pa.int64())], names=["family", "node", "n", "pivot", "m", "both"])

    ordered = rows.select("group", "head", "family", "node", "n", "pivot", "m", "held").repartition("group").sortWithinPartitions("group", F.desc("head"))
    return ordered.mapInArrow(run, f"family {family}, node {node}, n long, pivot {node}, m long, both long")


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that span the links of each group; with sides, only links from one side to the other count."""
    node = rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "group"):
            held = [np.asarray(x, dtype=np.int64) for x in table["held"].combine_chunks().to_numpy(zero_copy_only=False)]
            side = table["side"].combine_chunks().to_numpy(zero_copy_only=False)
            if len(held) < 2:
                continue
            size = np.array([len(x) for x in held], dtype=np.float32)
            both = _shared(held)
            near = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
            if side.any():
                near &= side[:, None] != side[None, :]
            a, b = np.nonzero(near)
            top = spanning(a, b, len(held))
            moved = np.flatnonzero(top != np.arange(len(held)))
            if len(moved):
                nodes = table["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(top[moved]))], names=["a", "b"])

    return rows.select("group", "node", "side", "held").repartition("group").sortWithinPartitions("group").mapInArrow(run, f"a {node}, b {node}")


def _crossed(star: DataFrame, sets: DataFrame, percent: int, block: int, elements: int) -> DataFrame:
    """Links between what is linked to a pivot and what isn't.

    Jaccard distance is a metric: a set at distance d from the pivot can be within the
    threshold t of one at distance e only where d - e <= t. So of the unlinked only those
    within 2 t of the pivot can have such links, and only with sets at d - t or farther.
    """
    t = 1 - percent / 100
    away = star.filter((F.col("apart") <= 2 * t + 1e-9) & ~F.col("linked"))
    least = away.groupBy("family").agg(F.min("apart").alias("least"))
    near = star.filter("linked").join(least, "family").filter(F.col("apart") >= F.col("least") - t - 1e-9).drop("least")
    a, b = _blocks(away, block, elements), _blocks(near, block, elements)
    na, nb = a.select("family", F.col("blocks").alias("across")).distinct(), b.select("family", F.col("blocks").alias("across")).distinct()
    left = a.join(nb, "family").withColumn("other", _upto("across")).select("node", F.concat_ws("|", F.hex("family"), "own", "other").alias("group"), F.lit(1).alias("side"))
    right = b.join(na, "family").withColumn("other", _upto("across")).select("node", F.concat_ws("|", F.hex("family"), "other", "own").alias("group"), F.lit(2).alias("side"))
    return _linked(left.unionByName(right).join(sets.select("node", "held"), "node"), percent)


def family_links(families: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, elements: int = BLOCK_ELEMENTS, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) that span all links inside families.

    families: (node, family), every node in one family; sets: (node, n, held), held the n
    distinct elements of a node's set as longs, n > 0. Two nodes of a family are linked when
    100 * intersection >= percent * union. Nodes without a set, a null node or family and
    families of one have no links; repeated rows add nothing; no families give no edges.

    Every member meets its family's pivot first, which settles a tight family at one
    comparison a member. What the pivot is not linked to meets those linked ones that the
    triangle inequality allows, and goes to the next round's pivot; after the last round it
    is compared whole. No pair is left out but those that can't be links. Comparisons run in
    blocks bounded in rows and elements, so large families spread over tasks; a task counts
    intersections by matrix products and gives edges that span what it links, never pairs.
    """
    members = families.filter("node is not null and family is not null").distinct().join(sets.select("node", "n"), "node")
    edges: list[DataFrame] = []
    for _ in range(rounds):
        star = cut(_starred(members, sets, block, elements).withColumn("union", F.expr("n + m - both")).select(
            "family", "node", "n", "pivot", (1 - F.col("both") / F.col("union")).alias("apart"), (100 * F.col("both") >= percent * F.col("union")).alias("linked")))
        edges.append(star.filter("linked and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        members = star.filter("not linked").select("node", "family", "n")
        if not members.limit(1).count():
            break
        edges.append(_crossed(star, sets, percent, block, elements))
    else:
        dealt = _blocks(members, block, elements)
        met = dealt.withColumn("other", _upto("blocks"))
        group = F.concat_ws("|", F.hex("family"), F.least("own", "other"), F.greatest("own", "other"))
        side = F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0)
        edges.append(_linked(met.select("node", group.alias("group"), side.alias("side")).join(sets.select("node", "held"), "node"), percent))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out
