"""Ranked lexical search: short posting lists summed term at a time, long ones skipped through document at a time."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import by_place, cut

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits by which documents tell terms that no item has; a segment of the index takes so many bytes of text, and so many documents, at most (or one text).
BITS, SEGMENT_BYTES, SEGMENT_DOCS = 1 << 20, 1 << 24, 1 << 16
#: Items searched together; lists of up to this share of a segment's documents are short; documents looked at together.
ITEMS, SHORT, WIDTH = 256, 1 / 16, 2048
#: Groups of segments whose best documents meet first.
FIRST = 256
#: Bytes as terms have them: A-Z lower-cased, all that no term holds a space.
BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))


class _Vocabulary(dict):
    """Numbers of the terms that an item may have, by order of appearance; -1 for others."""

    def __init__(self, bits: np.ndarray) -> None:
        super().__init__()
        self.bits, self.terms = bits, []

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self.terms) if self.bits[zlib.crc32(term) % BITS] else -1
        if n >= 0:
            self.terms.append(term)
        return n


class _Segment:
    """Postings of some documents, in memory."""

    def __init__(self, bits: np.ndarray) -> None:
        self.vocabulary = _Vocabulary(bits)
        self.ids: list = []
        self.sizes: list[int] = []
        self.found: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: object, raw: bytes) -> None:
        self.bytes += len(raw)
        if words := raw.translate(BYTES).split():
            counts = Counter(words)
            found = np.fromiter(map(self.vocabulary.__getitem__, counts), np.int32, len(counts))
            own = found >= 0
            self.ids.append(doc_id)
            self.sizes.append(len(words))
            self.found.append(found[own])
            self.counts.append(np.fromiter(counts.values(), np.uint32, len(counts))[own])

    def rows(self, segment: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for the documents, by ascending doc_id (null last), and one for each term's list."""
        if not self.ids:
            return
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        sizes = np.array(self.sizes, np.uint32)[order]
        none = pa.array([b""], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment]), pa.array([""]), pa.array([len(order)]), pa.array([int(sizes.sum(dtype=np.int64))]), none, pa.array([sizes.tobytes()], pa.binary()), pa.array([[self.ids[i] for i in order]], schema.field("ids").type)], schema=schema)
        term = np.concatenate([self.found[i] for i in order])
        doc = np.repeat(np.arange(len(order), dtype=np.uint32), [len(self.found[i]) for i in order])
        by = np.argsort(term, kind="stable")
        lengths = np.bincount(term, minlength=len(self.vocabulary.terms))
        offsets = pa.py_buffer(np.r_[0, np.cumsum(lengths * 4)].astype(np.int32).tobytes())
        lists = [pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, pa.py_buffer(x[by].tobytes())]) for x in (doc, np.concatenate([self.counts[i] for i in order]))]
        if len(lengths):
            names = pa.array([t.decode() for t in self.vocabulary.terms], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lengths), segment)), names, pa.array(lengths.astype(np.int64)), pa.nulls(len(lengths), pa.int64()), *lists, pa.nulls(len(lengths), schema.field("ids").type)], schema=schema)


def build_index(docs: DataFrame, item_terms: DataFrame) -> DataFrame:
    """An index of docs by segments: rows segment, term, n, total, docs, counts and ids.

    Each segment is a stretch of documents that have a term, numbered by ascending doc_id.
    Its row with an empty term has ids and, in counts, how many terms each has (total: all
    of them); a row for each term has the numbers of its documents and its occurrences there
    (binary, unsigned 32-bit). Terms that no item has are left out by a table of BITS bits
    of their CRC-32, as far as it tells them; what it lets through is harmless.
    """
    bits = np.zeros(BITS, bool)
    for r in item_terms.select((F.crc32("term") % BITS).alias("bit")).distinct().toLocalIterator():
        bits[r.bit] = True
    given = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType().add("segment", "long").add("term", "string").add("n", "long").add("total", "long").add("docs", "binary").add("counts", "binary").add("ids", T.ArrayType(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, at, held = to_arrow_schema(schema), TaskContext.get().partitionId() << 32, _Segment(given.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if held.ids and (held.bytes + len(raw) > SEGMENT_BYTES or len(held.ids) >= SEGMENT_DOCS):
                    yield from held.rows(at, to)
                    at, held = at + 1, _Segment(given.value)
                held.add(doc_id, raw)
        yield from held.rows(at, to)

    return by_place(docs, ["doc_id", "text"]).mapInArrow(run, schema)


class _List:
    """A term's (or the accumulators') documents and scores, with the greatest score in each stretch of WIDTH documents."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, windows: int) -> None:
        self.docs, self.scores = docs, scores
        self.at = np.searchsorted(docs, np.arange(windows + 1) * WIDTH)
        self.most = np.zeros(windows, np.int64)
        if there := np.flatnonzero(np.diff(self.at)).tolist():
            self.most[there] = np.maximum.reduceat(scores, self.at[there])


def best(lists: list[_List], n: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (of 0 to n - 1) of the top greatest sums of scores above 0, and these, greatest first, ties to the lesser document.

    Lists that are short are summed, document by document, into accumulators, which then are
    one more list with bounds. Documents are passed in order, WIDTH at a time: where the
    bounds of all lists can't beat the top-th sum so far, they are skipped; elsewhere lists
    whose bounds together can't beat it are only looked up at documents that the others give.
    """
    windows = -(-n // WIDTH)
    short = [x for x in lists if len(x.docs) <= n * SHORT]
    through = [x for x in lists if len(x.docs) > n * SHORT]
    if short:
        docs = np.concatenate([x.docs for x in short])
        order = np.argsort(docs, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(docs[order]) != 0])
        through.append(_List(docs[order][head], np.add.reduceat(np.concatenate([x.scores for x in short])[order], head), windows))
    bounds = sum(x.most for x in through)
    docs, sums, least = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for w in np.flatnonzero(bounds > 0).tolist():
        if bounds[w] <= least:
            continue
        here = sorted((x for x in through if x.most[w] > 0), key=lambda x: x.most[w])
        rest = np.cumsum([x.most[w] for x in here])
        looked_up = int(np.searchsorted(rest, least, side="right")) if least else 0
        scores = np.zeros(WIDTH, np.int64)
        for x in here[looked_up:]:
            scores[x.docs[x.at[w] : x.at[w + 1]] - w * WIDTH] += x.scores[x.at[w] : x.at[w + 1]]
        found = np.flatnonzero(scores)
        for k in range(looked_up - 1, -1, -1):
            found = found[scores[found] + rest[k] > least]
            if not len(found):
                break
            x, own = here[k], here[k].docs[here[k].at[w] : here[k].at[w + 1]] - w * WIDTH
            place = np.minimum(np.searchsorted(own, found), len(own) - 1)
            hit = own[place] == found
            scores[found[hit]] += x.scores[x.at[w] + place[hit]]
        found = found[scores[found] > least]
        if len(found):
            docs, sums = np.r_[docs, found + w * WIDTH], np.r_[sums, scores[found]]
            order = np.lexsort((docs, -sums))[:top]
            docs, sums = docs[order], sums[order]
            least = int(sums[-1]) if len(sums) == top else 0
    return docs, sums


def _search(rows: pa.Table, top: int, n_docs: int, n_terms: int, item_type: pa.DataType, id_type: pa.DataType) -> pa.Table:
    """The best documents of one segment for each item of one block."""
    rows = rows.to_pydict()
    head = rows["term"].index("")
    ids, sizes = rows["ids"][head], np.frombuffer(rows["counts"][head], np.uint32).astype(np.int64)
    m = 10 + 90 * sizes * n_docs // n_terms
    windows = -(-len(sizes) // WIDTH)
    of: dict[object, list[_List]] = {}
    for term, weight, docs, counts, items in zip(rows["term"], rows["weight"], rows["docs"], rows["counts"], rows["items"], strict=True):
        if term and weight:
            docs, counts = np.frombuffer(docs, np.uint32).astype(np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)
            own = _List(docs, weight * (1_000_000_000 * counts // (1000 * counts + 8 * m[docs])), windows)
            for item in items:
                of.setdefault(item["item_id"], []).append(own)
    out: tuple[list, list, list] = ([], [], [])
    for item, lists in of.items():
        docs, sums = best(lists, len(sizes), top)
        out[0].extend([item] * len(docs))
        out[1].extend(ids[d] for d in docs.tolist())
        out[2].extend(sums.tolist())
    segment = pa.array([rows["segment"][0]] * len(out[0]), pa.int64())
    return pa.table({"item_id": pa.array(out[0], item_type), "doc_id": pa.array(out[1], id_type), "score": pa.array(out[2], pa.int64()), "segment": segment})


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score (long): the top documents of each item with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. With N
    documents that have a term, L terms in all, n in a document and df documents with a
    term, a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a document's score
    sums w ((10**9 tf) div (1000 tf + 8 (10 + (90 n N) div L))) over the item's terms.

    Null and empty texts have no terms: such documents count nowhere, such items have no
    rows. Rows that share an item_id are one item with all their terms, once each. Rows that
    repeat a doc_id are documents of their own; of equal scores the lesser doc_id comes
    first, null last. Empty tables give no rows. Other columns are ignored.

    The index is written once, in segments that bound a task's memory. Items go in blocks of
    about ITEMS; each block meets each segment's lists for its terms in one group, and each
    segment gives top documents an item, which meet in two steps.
    """
    terms = cut(items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct())
    index = cut(build_index(docs.select("doc_id", "text"), terms))
    n_docs, n_terms = index.where(F.col("term") == "").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    blocks = max(1, -(-terms.select("item_id").distinct().count() // ITEMS))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1)))
    weights = index.where(F.col("term") != "").groupBy("term").agg(F.sum("n").alias("df")).select("term", weight.alias("weight"))
    asked = terms.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"), "term").agg(F.collect_list(F.struct("item_id")).alias("items"))
    asked = asked.join(weights, "term").select("term", "block", "weight", "items")
    # Every block also meets the row of a segment's documents.
    heads = terms.sparkSession.range(blocks).select(F.lit("").alias("term"), F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("weight"), F.array().cast(asked.schema["items"].dataType).alias("items"))
    met = index.join(asked.unionByName(heads), "term").select("segment", "block", "term", "weight", "docs", "counts", "ids", "items")
    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType()), T.StructField("segment", T.LongType())])

    def run(rows: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        return _search(rows, top, n_docs, n_terms, to.field("item_id").type, to.field("doc_id").type)

    found = met.groupBy("segment", "block").applyInArrow(run, schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", F.pmod(F.xxhash64("segment"), F.lit(FIRST))).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
