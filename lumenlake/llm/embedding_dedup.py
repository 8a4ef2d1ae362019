"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, exact cosines within buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import cut
from lumenlake.llm.components import components

#: Tables, projections that make a table's key, and the width of a projection's cells. Unit vectors with cosine
#: 0.98 are 0.2 apart and share a table's key with probability 0.25, so all 40 tables miss them with 1 in 80,000.
TABLES, PROJECTIONS, WIDTH, SEED = 40, 8, 1.0, 11
#: Vectors of a bucket that one task compares with as many.
BLOCK = 1024


@cache
def _projections(dim: int, tables: int, projections: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    n = tables * projections
    return rng.standard_normal((dim, n)), rng.random(n), rng.integers(0, 2**63, (tables, projections), dtype=np.int64) | 1


def bucket_keys(unit: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Keys (int32) of unit vectors in each table: their quantised random projections, hashed."""
    a, b, odd = _projections(unit.shape[1], tables, projections, seed)
    cells = np.floor(unit @ a / width + b).astype(np.int64).reshape(len(unit), tables, projections)
    return ((cells * odd).sum(axis=2) >> 31).astype(np.int32)


def _usable(v: list | None) -> np.ndarray | None:
    if not v or any(x is None for x in v):
        return None
    x = np.array(v, dtype=np.float64) + 0.0
    return x if np.isfinite(x).all() and x.any() else None


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1. A power of two comes off first, so that no square over- or underflows."""
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])
    return m / np.linalg.norm(m, axis=1)[:, None]


def _keyed(vectors: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    """id, label, h (128-bit hash of the vector; null where it links with nothing), keys, v (as wide as in vectors)."""
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    width_of = "float" if single else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [_usable(v) for v in batch.column(2).to_pylist()]
            keys: list = [None] * len(xs)
            for dim in {len(x) for x in xs if x is not None}:
                rows = [i for i, x in enumerate(xs) if x is not None and len(x) == dim]
                m = np.array([xs[i] for i in rows])
                for i, k in zip(rows, bucket_keys(_unit(m), tables, projections, width)):
                    keys[i] = k
            h = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in xs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h, pa.binary()), pa.array(keys, pa.list_(pa.int32())), pa.array([None if x is None else x.astype(np.float32 if single else np.float64) for x in xs], pa.list_(pa.float32() if single else pa.float64()))], names=["id", "label", "h", "keys", "v"])

    cols = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return cols.mapInArrow(run, f"id long, label string, h binary, keys array<int>, v array<{width_of}>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with one group key, of batches sorted by it."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not len(batch):
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("group", "t", "rep", "m", "left", "keys", "v")}
        now["dim"] = np.array(pa.compute.list_value_length(batch.column("v")))
        if held is not None:
            now = {n: np.concatenate([held[n], now[n]]) for n in now}
        ends = np.flatnonzero(now["group"][1:] != now["group"][:-1]) + 1
        for a, b in zip([0, *ends[:-1]], ends):
            yield {n: x[a:b] for n, x in now.items()}
        held = {n: x[ends[-1] if len(ends) else 0 :] for n, x in now.items()}
    if held is not None:
        yield held


def _linked(threshold: float):
    """Of each block pair: how many links it adds to a vector, and edges that span what it links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, links, tops = [], [], []
        for g in _blocks(batches):
            for dim in np.unique(g["dim"]):
                of = g["dim"] == dim
                if of.sum() < 2:
                    continue
                x = _unit(np.stack(g["v"][of]).astype(np.float64))
                rep, m, left, t = g["rep"][of], g["m"][of], g["left"][of], g["t"][0]
                near = x @ x.T >= threshold
                # blocks i and j of a bucket meet in the pair (i, j); pairs inside i belong to (i, i)
                if left.any() and not left.all():
                    near &= left[:, None] != left[None, :]
                near &= rep[:, None] != rep[None, :]
                a, b = np.nonzero(np.triu(near, 1))
                if t and len(a):
                    keys = np.stack(g["keys"][of])
                    new = np.concatenate([~(keys[a[k : k + 65536]] == keys[b[k : k + 65536]]).any(axis=1) for k in range(0, len(a), 65536)] or [np.zeros(0, dtype=bool)])
                    a, b = a[new], b[new]
                if not len(a):
                    continue
                count = np.bincount(a, m[b], len(rep)) + np.bincount(b, m[a], len(rep))
                top = np.arange(len(rep))
                while True:
                    low = top.copy()
                    np.minimum.at(low, a, top[b])
                    np.minimum.at(low, b, top[a])
                    low = low[low]
                    if (low == top).all():
                        break
                    top = low
                hit = count > 0
                reps.append(rep[hit])
                links.append(count[hit].astype(np.int64))
                tops.append(rep[top[hit]])
            if sum(map(len, reps)) > 50_000:
                yield pa.RecordBatch.from_pydict({"rep": np.concatenate(reps), "links": np.concatenate(links), "top": np.concatenate(tops)})
                reps, links, tops = [], [], []
        if reps:
            yield pa.RecordBatch.from_pydict({"rep": np.concatenate(reps), "links": np.concatenate(links), "top": np.concatenate(tops)})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """Links between vectors of equal, non-null label and length whose cosine in double precision is at least threshold.

    Returns one row per row of vectors: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Equal vectors of a label become one class first, which counts for as many. Classes are
    posted under label, table and key; every bucket with more than one class is compared
    whole, in pairs of blocks of bounded size, however large it is. A pair that meets in
    several tables counts in the first of them alone, and a bucket that has the members of
    one in a table before is not compared again. Blocks give counts and spanning edges,
    never pairs. No pair under threshold is linked; the tables miss a pair at threshold with
    the probability that TABLES states, closer pairs with less.

    A vector that is null, empty, zero, or holds null or non-finite components links with
    nothing, nor does one without label or vec_id. Rows that repeat a vec_id are vectors of
    their own under one node. An empty table gives an empty result; other columns are ignored.
    """
    keyed = cut(_keyed(vectors, tables, projections, width))
    usable = keyed.filter("h is not null and label is not null and id is not null")
    classes = cut(usable.groupBy("label", "h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("keys").alias("keys"), F.first("v").alias("v")))
    posted = classes.select("label", "h", "rep", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "t", "key"]
    # of buckets with the same members only the first table's is compared: its pairs meet nowhere before, and again in the others
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64(F.lit(SEED), "h")).alias("y")]
    full = posted.groupBy(*bucket).agg(*members).filter("n > 1")
    full = full.groupBy("label", "n", "x", "y").agg(F.min(F.struct("t", "key")).alias("b")).select("label", "b.t", "b.key", "n")
    member = posted.join(full, bucket).withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("rep", "h"), F.col("blocks")))
    met = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = met.select("label", "h", "t", (F.col("own") <= F.col("other")).alias("left"), F.concat_ws("|", *bucket, F.least("own", "other"), F.greatest("own", "other")).alias("group"))
    # only the keys of the tables before are needed, to tell whether a pair met in one of them
    rows = pair.join(classes, ["label", "h"]).select("group", "t", "rep", "m", "left", F.slice("keys", F.lit(1), F.col("t")).alias("keys"), "v")
    found = cut(rows.repartition("group").sortWithinPartitions("group").mapInArrow(_linked(threshold), "rep long, links long, top long"))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select("rep", "top")).toDF("rep", "root")
    named = classes.select("label", "h", "rep", "m").join(links, "rep", "left").join(roots, "rep", "left")
    named = named.select("label", "h", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    out = keyed.select("id", "label", "h").join(named, ["label", "h"], "left")
    joined = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias("vec_id"), F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), joined.alias("component_id"), F.coalesce(F.col("id") == joined, F.lit(True)).alias("kept"))
