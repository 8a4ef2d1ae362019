"""MinHash near-duplicates by an inverted join on signature coordinates, links confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import cut
from lumenlake.llm.components import components
from lumenlake.llm.families import family_links
from lumenlake.llm.shingles import shingle_set, signature

#: Coordinates of a signature, and how many must agree: at a similarity of 0.8 fewer do with a probability under 2e-5.
COORDINATES, MATCHES = 64, 36


def _signed(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """id, n (set size), h (128-bit hash of the set), sig (coordinates; null for an empty set), low (the coordinates' low bytes in longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h, sigs, lows = [], [], [], []
            for text in batch.column(1).to_pylist():
                held = shingle_set(text, words)
                n.append(len(held))
                h.append(hashlib.blake2b(held.tobytes(), digest_size=16).digest())
                sig = signature(held, coordinates) if len(held) else None
                sigs.append(None if sig is None else sig.astype(np.int64))
                lows.append(None if sig is None else sig.astype(np.uint8).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.int64()))], names=["id", "n", "h", "sig", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, n long, h binary, sig array<long>, low array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in held], pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["node", "n", "held"])

    return docs.mapInArrow(run, "node long, n long, held array<long>").filter("n > 0")


def _agreeing(coordinates: int) -> Column:
    """How many low bytes of x and y agree: never fewer than coordinates that do."""
    total = F.lit(0)
    for k in range(coordinates // 8):
        xor = F.col(f"x.low{k}").bitwiseXOR(F.col(f"y.low{k}"))
        for j in range(8):
            total = total + F.when(F.shiftrightunsigned(xor, 8 * j).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0)
    return total


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, kept, one row per row of docs.

    Two documents are linked when their sets of distinct shingles of words words share at
    least percent of their union; component_id is the smallest doc_id reachable over links.

    1. Documents with one and the same set become a class under its smallest doc_id; a group
       of copies, however large, costs one row a task and is a single node from there on.
    2. Each class is posted under its (coordinate, value) pairs. What occurs once can't match,
       so classes with fewer than `matches` shared pairs go. Of the others only the prefix of
       rarest pairs is posted: two signatures that agree `matches` times share one of them,
       and frequent pairs are skipped.
    3. In each posting list all members meet one pivot; those that agree with it in `matches`
       coordinates join its family, which gathers groups of near copies without their pairs.
       Members of different families then meet pairwise, and pairs that agree are kept.
    4. Links are confirmed on full sets: inside a family by its pivots and then in blocks of
       bounded size, which give spanning edges, and the pairs between families.

    Empty and null texts have no shingles and link with nothing. A null doc_id links with
    nothing, has a null component_id and is kept. Rows that repeat a doc_id are one node.
    An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    signed = cut(_signed(docs, words, coordinates))
    usable = signed.filter("n > 0 and id is not null")
    classes = cut(usable.groupBy("h").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low")))
    token = F.explode(F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v)))
    posted = classes.select("rep", token.alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    by_class = posted.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    prefix = by_class.filter(F.size("tokens") >= matches).select("rep", F.slice("tokens", F.lit(1), F.size("tokens") - matches + 1).alias("tokens"))
    lows = classes.select("rep", "n", *(F.col("low")[k].alias(f"low{k}") for k in range(coordinates // 8)))
    postings = cut(prefix.join(lows, "rep").withColumn("token", F.explode("tokens.token")).drop("tokens"))

    alike = (_agreeing(coordinates) >= matches) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    held = F.struct(F.xxhash64("token", "rep").alias("draw"), *(c for c in postings.columns if c != "token"))
    pivots = postings.groupBy("token").agg(F.min(held).alias("pivot")).select("token", "pivot.*").drop("draw")
    met = postings.alias("x").join(pivots.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") != F.col("y.rep")) & alike)
    families = cut(components(met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))).toDF("node", "family"))

    labelled = postings.join(families.toDF("rep", "family"), "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    mixed = labelled.groupBy("token").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).filter("lo <> hi").select("token")
    rest = cut(labelled.join(mixed, "token", "left_semi"))
    across = rest.alias("x").join(rest.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.family") != F.col("y.family")) & alike)
    pairs = cut(across.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())

    asked = families.select(F.col("node").alias("id")).union(pairs.select(F.explode(F.array("a", "b")))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(asked, "id", "left_semi")
    sets = cut(_sets(texts, words).dropDuplicates(["node"]))
    first = cut(family_links(families, sets, percent))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("sb")), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    second = cut(both.filter(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b"))

    roots = components(first.unionByName(second))
    final = classes.select("h", "rep").join(roots.toDF("rep", "root"), "rep", "left").select("h", F.coalesce("root", "rep").alias("root"))
    named = signed.select("id", "n", "h").join(final, "h", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("root"))).otherwise(F.col("id"))
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs less all documents but the smallest doc_id of each component, all columns as they were.

    Null and empty texts and null doc_ids are kept. Of rows that repeat a doc_id all stay or
    none does. An empty table stays empty; docs may have any other columns.
    """
    gone = near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
