"""Resampling documents towards a target distribution by hashed word features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import by_place, cut

#: Distances from a span's end that the position table covers, a power of two; bytes of text looked at together.
TABLE, BYTES = 64, 1 << 20
#: Rows of the result that one task numbers, about.
NUMBERED = 1_000_000
POLYNOMIAL = 0xEDB88320


@cache
def _position_table() -> np.ndarray:
    """[d, b]: what byte b at distance d from the end gives to a CRC-32 without its constants."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    out = np.empty((TABLE, 256), np.uint32)
    out[0] = step
    for d in range(1, TABLE):
        out[d] = (out[d - 1] >> 8) ^ step[out[d - 1] & 0xFF]
    return out


@cache
def _shift(level: int) -> np.ndarray:
    """[k, b]: a CRC state whose byte k is b, moved on by TABLE << level zero bytes."""
    table = _position_table()
    if level == 0:
        # A state's byte k acts like a byte of the message k places after it.
        return np.stack([table[TABLE - 1 - k] for k in range(4)])
    return _moved(_shift(level - 1), level - 1)


def _moved(state: np.ndarray, level: int) -> np.ndarray:
    by = _shift(level)
    return by[0][state & 0xFF] ^ by[1][state >> 8 & 0xFF] ^ by[2][state >> 16 & 0xFF] ^ by[3][state >> 24]


@cache
def _length_constants() -> np.ndarray:
    """The state that a CRC-32 begins with, moved on by 0 to TABLE - 1 zero bytes."""
    step, state, out = _position_table()[0], 0xFFFFFFFF, []
    for _ in range(TABLE):
        out.append(state)
        state = state >> 8 ^ int(step[state & 0xFF])
    return np.array(out, np.uint32)


def _constants(lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of lengths zero bytes: the first state moved on by length, and inverted."""
    state, blocks, level = _length_constants()[lengths % TABLE], lengths // TABLE, 0
    while blocks.any():
        odd = blocks & 1 == 1
        state[odd] = _moved(state[odd], level)
        blocks, level = blocks >> 1, level + 1
    return state ^ np.uint32(0xFFFFFFFF)


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each span of data (uint8), spans not empty, in order and apart.

    Each byte's contribution, by its distance from the end of its block of TABLE bytes, is
    looked up, and contributions are XORed over blocks by reduceat. Blocks of long spans are
    folded in pairs, the left one moved on by the right one's length, until one is left; the
    constant of the span's length is XORed last. Memory is BYTES at a time.
    """
    out = np.empty(len(starts), np.uint32)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BYTES, side="right")))
        out[at:to] = _linear(data, starts[at:to], ends[at:to])
        at = to
    return out ^ _constants(ends - starts)


def _linear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    # A span's first block is its incomplete one, so that all others end at multiples of TABLE from its end.
    lengths = ends - starts
    blocks = -(-lengths // TABLE)
    many = np.flatnonzero(blocks > 1)
    if not len(many):
        return _blocks(data, starts, ends)
    first = np.cumsum(blocks) - blocks
    back = np.repeat(blocks, blocks) - 1 - (np.arange(int(blocks.sum())) - np.repeat(first, blocks))  # blocks after it
    block_end = np.repeat(ends, blocks) - back * TABLE
    block_start = np.maximum(np.repeat(starts, blocks), block_end - TABLE)
    values = np.empty(len(back), np.uint32)
    at = 0
    while at < len(back):  # one span may be longer than BYTES
        to = max(at + 1, int(np.searchsorted(block_end, block_start[at] + BYTES, side="right")))
        values[at:to] = _blocks(data, block_start[at:to], block_end[at:to])
        at = to
    owner, level = np.repeat(np.arange(len(starts)), blocks), 0
    while len(values) > len(starts):
        left = back & 1 == 1
        values[left] = _moved(values[left], level)
        back >>= 1
        head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (back[1:] != back[:-1])])
        values, owner, back, level = np.bitwise_xor.reduceat(values, head), owner[head], back[head], level + 1
    return values


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Contributions of spans of TABLE bytes at most, XORed span by span."""
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    distance = np.repeat(first + lengths - 1, lengths) - np.arange(int(lengths.sum()))
    place = np.repeat(ends - 1, lengths) - distance
    return np.bitwise_xor.reduceat(_position_table().reshape(-1)[distance * 256 + data[place]], first)


@cache
def _word_bytes() -> np.ndarray:
    """For each byte, itself in lower case if it belongs to words, else 0: digits, letters and all beyond ASCII do."""
    out = np.zeros(256, np.uint8)
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        out[b] = b
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def features(data: np.ndarray, bounds: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to n consecutive words of the texts data[bounds[i]:bounds[i + 1]], text by text; how many each text has, and its words."""
    data = _word_bytes()[data]
    is_word = data != 0
    before, after = np.r_[False, is_word[:-1]], np.r_[is_word[1:], False]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    text = np.searchsorted(bounds, starts, side="right") - 1
    words = np.bincount(text, minlength=len(bounds) - 1)
    if not len(starts):
        return np.empty(0, np.int64), words, words
    hashes, texts = [crc32_of_spans(data, starts, ends)], [text]
    if n > 1:
        # Words side by side, a space behind each, so that runs of them are spans too.
        lengths = ends - starts
        own = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined[np.repeat(own, lengths) + inside] = data[np.repeat(starts, lengths) + inside]
        for k in range(2, n + 1):
            whole = np.flatnonzero(text[: max(0, len(text) - k + 1)] == text[k - 1 :])
            for shift in range(k):  # every kth run, so that spans are apart
                those = whole[whole % k == shift]
                if len(those):
                    hashes.append(crc32_of_spans(joined, own[those], (own + lengths)[those + k - 1]))
                    texts.append(text[those])
    text = np.concatenate(texts)
    return np.concatenate(hashes)[np.argsort(text, kind="stable")] % buckets, np.bincount(text, minlength=len(bounds) - 1), words


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of a column of texts of BYTES each, but for one long text: rows from, to, their bytes and bounds."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BYTES, side="right")) - 1)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def hashed(df: DataFrame, kept: list[str], n: int, buckets: int) -> DataFrame:
    """kept columns of df with n_features, n_words and buckets (binary: those of its text's features, 2 or 4 bytes each)."""
    new = [T.StructField("n_features", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("buckets", T.BinaryType())]
    schema = T.StructType([*df.select(*(f"`{c}`" for c in kept)).schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in _texts(batch.column(0)):
                found, counts, words = features(data, bounds, n, buckets)
                found, ends = found.astype(_kind(buckets)), np.cumsum(counts)
                raw = [found[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(counts, pa.int64()), pa.array(words, pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns[1:], *columns], names=[f.name for f in schema])

    return by_place(df, ["text", *kept]).mapInArrow(run, schema)


def _bucket_counts(coded: DataFrame, buckets: int) -> np.ndarray:
    """How many features lie in each bucket. Each task counts its own first; what reaches the driver has one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                found = np.frombuffer(raw.as_buffer(), _kind(buckets))
                for at in range(0, len(found), BYTES):
                    np.add.at(counts, found[at : at + BYTES], 1)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(counts[there], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in coded.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket, in doubles."""
    buckets = len(source)
    up = (target + 1.0) * (float(source.sum()) + buckets)
    down = (source + 1.0) * (float(target.sum()) + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _weighed(coded: DataFrame, kept: list[str], gain: np.ndarray) -> DataFrame:
    """coded less buckets, with weight: the floored mean gain of each row's features."""
    schema = T.StructType([*coded.select(*(f"`{c}`" for c in kept)).schema.fields, T.StructField("weight", T.LongType())])
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[x].sum()) // len(x) if len(x := np.frombuffer(raw.as_buffer(), kind)) else 0 for raw in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(weights, pa.int64())], names=[f.name for f in schema])

    return by_place(coded, ["buckets", *kept]).mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u a uniform draw from the hash of seed and doc_id: Gumbel noise, the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (long) of every row: a draw of docs that resembles target.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Features
    are runs of 1 to n words, in the bucket of their CRC-32. A bucket's gain is the log of
    its share in target over its share in docs, both smoothed by one; a document's weight is
    its mean gain, its score that plus Gumbel noise of its doc_id. Of the N documents of
    least_words or more, the floor(percent N / 100) of the highest scores are drawn, ties to
    the smaller doc_id (null last), and ranked from 1; rank is null for the others.

    Null and empty texts have no features and weight 0. A null doc_id draws noise of its own.
    Rows that repeat a doc_id are documents of their own, with ranks of their own. An empty
    table gives no rows; an empty target gives gains against an even distribution. Other
    columns are ignored.

    Texts are read once: buckets are written as a table of 2 or 4 bytes a feature. The driver
    gets one number a bucket, a score and a range of rows; rows are numbered range by range.
    """
    spark = docs.sparkSession
    coded = cut(hashed(docs.select("doc_id", "text"), ["doc_id"], n, buckets))
    gain = gains(_bucket_counts(coded, buckets), _bucket_counts(hashed(target.select("text"), [], n, buckets), buckets))
    weighed = _weighed(coded, ["doc_id", "n_features", "n_words"], gain)
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = scored.where(F.col("n_words") >= least_words)
    count = fit.count() * percent // 100
    # Scores are whole numbers within the range of gains and noise: a row for each is a small table.
    above = sorted(((r.score, r.n) for r in fit.groupBy("score").agg(F.count("*").alias("n")).toLocalIterator()), reverse=True)
    least, total = None, 0
    for score, k in above:
        if total >= count:
            break
        least, total = score, total + k
    columns = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select(*columns, unranked)
    fits = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    # Rows that are alike are told apart by their place in the written table, which doesn't change.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("place").asc()]
    placed = scored.where(fits).select(*columns, F.monotonically_increasing_id().alias("place"))
    tasks = max(total // NUMBERED + 1, spark.sparkContext.defaultParallelism)
    ranged = cut(_numbered(placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("place")))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).toLocalIterator()
    starts, before = [], 0
    for part, k in sorted((r.part, r.n) for r in parts):
        starts.append((part, before))
        before += k
    drawn = ranged.join(spark.createDataFrame(starts, "part int, before long"), "part").withColumn("rank", F.col("before") + F.col("at"))
    drawn = drawn.select(*columns, F.when(F.col("rank") <= count, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~fits).select(*columns, unranked))


def _numbered(sorted_rows: DataFrame) -> DataFrame:
    """Rows with their partition and their place in it, from 1."""
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = np.arange(n + 1, n + 1 + len(batch))
            n += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(at)], names=[f.name for f in schema])

    return sorted_rows.mapInArrow(run, schema)
