"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded selection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.llm.common import cut, n_words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Words of a block.
BLOCK_WORDS = 32
#: Rows that a shard has on average, and the fewest shards.
ROWS_PER_SHARD, MIN_SHARDS = 65_536, 64


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources (__none, __src, source_size) with rank and target.

    Sources in code-point order, null last, take the weights in turn and share the total of
    all sizes by them; no target exceeds max_repeats times its source's size, and what is
    over goes to the others by weight until none is above. That fixpoint has the closed form
    target = min(cap, weight * level): with sources ordered by cap / weight, level is what is
    left behind the capped ones, divided by the weights that are left. One row per source
    goes through a single window; documents don't.
    """
    by_rank = W.orderBy("__none", "__src")
    turn = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("rank", F.row_number().over(by_rank)).withColumn("__w", turn[(F.col("rank") - 1) % len(weights)])
    capped = ranked.withColumn("__cap", F.col("source_size") * max_repeats)
    order = W.orderBy(F.col("__cap") / F.col("__w"), "rank")
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - before
    level = capped.withColumn("__level", left / F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing)))
    fits = F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.col("__level"))
    top = F.max(fits).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__w") * top, F.col("__cap").cast("double")))
    return level.withColumn("target", target).drop("__w", "__cap", "__level")


def sainte_lague(cells: DataFrame, group: Sequence[str], weight: str, seats: str, order: Sequence[str]) -> DataFrame:
    """cells with a column quota: seats of its group, dealt out by the highest quotients weight / (2 k + 1).

    Rounding every exact share gives each cell its seats up to a few; the threshold quotient
    then moves by what all the roundings make up, at most 1.5 seats a cell, of which a cell
    gets its share. So only that neighbourhood of seats competes, a few rows a cell however
    many seats there are. Equal quotients go by order. A group without weight gets none.
    """
    g = W.partitionBy(*group)
    share = F.coalesce(F.try_divide(F.col(weight).cast("double"), F.sum(weight).over(g)), F.lit(0.0))
    near = cells.withColumn("__share", share).withColumn("__near", (F.ceil(F.col("__share") * F.count(F.lit(1)).over(g) * 1.5) + 2).cast("long"))
    exact = F.floor(F.col("__share") * F.col(seats) + 0.5).cast("long")
    near = near.withColumn("__sure", F.greatest(F.lit(0).cast("long"), exact - F.col("__near")))
    near = near.withColumn("__left", F.col(seats) - F.sum("__sure").over(g)).withColumn("__seat", F.explode(F.sequence(F.col("__sure"), exact + F.col("__near"))))
    quotient = F.col(weight).cast("double") / (2 * F.col("__seat") + 1)
    won = near.withColumn("__won", (F.row_number().over(g.orderBy(quotient.desc(), *order, "__seat")) <= F.col("__left")) & (F.col(weight) > 0))
    return won.groupBy(*cells.columns).agg((F.max("__sure") + F.sum(F.col("__won").cast("long"))).alias("quota"))


class Apportioned(NamedTuple):
    """docs: rows with __none, __src, __shard, size, __draw and what is carried; cells: what a source's part of a shard holds and gets."""

    docs: DataFrame
    cells: DataFrame


CELL = ["__none", "__src", "__shard"]


def _drawn(seed: int, *what: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *what))


def _apportioned(docs: DataFrame, weights: Sequence[float], max_repeats: int, block_words: int, seed: int, carry: Sequence[Column]) -> Apportioned:
    """Blocks for sources by Sainte-Lague on their targets, then for each source's shards by the blocks that they hold.

    A cell of w words holds round(w / block_words) blocks, one at least, the last of which is
    up to half a block shorter or longer, so that the blocks of a source have block_words on
    average. Null doc_ids are told apart by their texts.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    shards = max(MIN_SHARDS, -(-docs.count() // ROWS_PER_SHARD))
    sized = cut(docs.select(
        "doc_id", "source", F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__src"), n_words(F.col("text")).alias("size"),
        (F.conv(F.substring(_drawn(seed, name), 1, 8), 16, 10).cast("long") % shards).alias("__shard"), _drawn(seed + 1, name).alias("__draw"), *carry,
    ))
    key = CELL[:2]
    cells = sized.groupBy(*CELL).agg(F.sum("size").alias("__words"))
    cells = cut(cells.withColumn("__held", F.when(F.col("__words") > 0, F.greatest(F.lit(1), F.floor((F.col("__words") + block_words // 2) / block_words))).otherwise(0).cast("long")))
    sources = cells.groupBy(*key).agg(F.sum("__words").alias("source_size"), F.sum("__held").alias("__own"))
    targets = source_targets(sources, weights, max_repeats).withColumn("__blocks", F.coalesce(F.try_divide(F.col("target") * F.col("__own"), F.col("source_size").cast("double")), F.lit(0.0)))
    total = F.sum("__own").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    by_source = sainte_lague(targets.withColumn("__one", F.lit(0)).withColumn("__seats", total), ["__one"], "__blocks", "__seats", ["rank"])
    by_source = cut(by_source.select(*key, "source_size", "target", F.col("quota").alias("__given")))
    by_cell = sainte_lague(cells.join(by_source, key), key, "__held", "__given", ["__shard"])
    return Apportioned(sized, cut(by_cell.withColumn("__quota", F.least(F.col("quota"), F.col("__held") * max_repeats)).select(*CELL, "source_size", "target", "__words", "__held", "__quota")))


def _placed(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """Documents in the seeded order of their cell, with the cell's columns and __from, the words before them."""
    run = W.partitionBy(*CELL).orderBy("__draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return sized.join(cells, CELL).withColumn("__from", F.coalesce(F.sum("size").over(run), F.lit(0)))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 42, *, carry: Sequence[Column] = ()) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    Blocks of block_words words go to sources by Sainte-Lague on their targets, then within a
    source to its shards (by hash of doc_id) by Sainte-Lague on the blocks that these hold. A
    shard's documents, in seeded hash order, are cut into blocks; all are taken as often as
    its quota goes round, and of the rest those with the least seeded draws once more. taken
    counts repeats and is at most max_repeats times size; a source's taken words are off its
    target by about a block, and the unequal last blocks of its shards. Null and empty texts
    have size 0 and nothing taken; null doc_ids and repeated rows are documents of their own;
    an empty table gives an empty result. Columns other than doc_id, source and text are
    ignored, whatever their names; expressions in carry pass through.
    """
    dealt = _apportioned(docs, weights, max_repeats, block_words, seed, carry)
    number = lambda c: c.cast("string")
    drawn = lambda b: _drawn(seed + 2, F.col("__src"), number(F.col("__none").cast("int")), number(F.col("__shard")), number(b))
    held = F.col("__held")
    rest = F.coalesce(F.try_mod(F.col("__quota"), held), F.lit(0)).cast("long")
    # the draw of the last block that is taken once more; blocks are numbered by cell, a few rows a thousand words
    blocks = dealt.cells.filter(rest > 0).select(*CELL, rest.alias("__rest"), F.explode(F.sequence(F.lit(0).cast("long"), held - 1)).alias("__b")).withColumn("__d", drawn(F.col("__b")))
    last = blocks.withColumn("__nth", F.row_number().over(W.partitionBy(*CELL).orderBy("__d", "__b"))).filter("__nth = __rest").select(*CELL, F.col("__d").alias("__last"))
    placed = _placed(dealt.docs, dealt.cells.join(last, CELL, "left"))
    block_of = lambda word: F.least(F.floor(word / block_words), held - 1).cast("long")
    start, stop = F.col("__from"), F.col("__from") + F.col("size")
    inside = lambda b: F.least(stop, F.when(b == held - 1, F.col("__words")).otherwise((b + 1) * block_words)) - F.greatest(start, b * block_words)
    own = F.when(F.col("size") > 0, F.sequence(block_of(start), block_of(stop - 1))).otherwise(F.array().cast("array<long>"))
    more = F.aggregate(own, F.lit(0).cast("long"), lambda acc, b: acc + F.when(drawn(b) <= F.col("__last"), inside(b)).otherwise(0).cast("long"))
    taken = F.coalesce(F.floor(F.try_divide("__quota", "__held")), F.lit(0)) * F.col("size") + F.coalesce(more, F.lit(0))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(c for c in dealt.docs.columns if c.startswith("__carried")))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 42) -> DataFrame:
    """docs in the mix's proportions: a row for each time that a whole document is taken, up to max_repeats times.

    Quotas are those of mix(). A shard fills its own with whole documents in seeded order,
    from the start again when all are used, and stops inside one at most. Of a source's such
    documents, the largest first, each is taken once more or not as what is owed to the
    source is nearer to the whole or to nothing, and what that leaves over or short goes on
    to the next; so a source is off its quota by half its largest such document at most. One
    row a shard, no more, meets in a source's list. A document of which nothing is taken, and
    one without words, has no row. Null doc_ids and repeated rows are documents of their own;
    an empty table stays empty. Columns are those of docs, unchanged, whatever their names.
    """
    names = [f"__carried{i}" for i in range(len(docs.columns))]
    dealt = _apportioned(docs, weights, max_repeats, block_words, seed, [docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names)])
    take = F.round(F.try_divide(F.col("__quota") * F.col("__words"), F.col("__held").cast("double"))).cast("long")
    placed = _placed(dealt.docs, dealt.cells.withColumn("__take", F.coalesce(take, F.lit(0).cast("long")))).filter("size > 0")
    rounds = F.floor(F.col("__take") / F.col("__words")).cast("long")
    over = F.col("__take") - rounds * F.col("__words") - F.col("__from")
    placed = cut(placed.select(*names, *CELL, "size", rounds.alias("__rounds"), F.greatest(F.lit(0), F.least(F.col("size"), over)).cast("long").alias("__part")))
    partial = placed.filter("__part > 0 and __part < size")
    parts = partial.groupBy("__none", "__src").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "__shard", F.col("__part").alias("part")))).alias("__parts"))
    start = F.struct(F.lit(0).cast("long").alias("owed"), F.array().cast("array<long>").alias("up"))

    def step(acc: Column, p: Column) -> Column:
        owed = acc["owed"] + p["part"]
        up = 2 * owed >= -p["less"]
        return F.struct(F.when(up, owed + p["less"]).otherwise(owed).alias("owed"), F.when(up, F.array_append(acc["up"], p["__shard"])).otherwise(acc["up"]).alias("up"))

    up = parts.select("__none", "__src", F.explode(F.aggregate("__parts", start, step, lambda acc: acc["up"])).alias("__shard")).withColumn("__up", F.lit(1))
    once = F.when(F.col("__part") == F.col("size"), 1).when(F.col("__part") > 0, F.coalesce("__up", F.lit(0))).otherwise(0)
    copies = placed.join(up, CELL, "left").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), (F.col("__rounds") + once).cast("int"))))
    return copies.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
