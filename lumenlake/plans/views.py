"""The annotation, prediction, frame, pixel and file views that queries run on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1920, 1080


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _xy() -> tuple:
    return (F.col("l_partkey") * 37) % 2000 - 40, (F.col("l_suppkey") * 53) % 1120 - 20


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with box_no, their number in the order. Boxes and predictions that both come from these are numbered and joined after one shuffle."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *order).withColumn("box_no", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations: lines of an order are boxes of an image; some leave the frame, some are degenerate."""
    x, y = _xy()
    key = F.col("l_orderkey")
    category = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 4).when(F.col("l_linestatus") == "F", 2).otherwise(3)
    return lines(spark, sf_dir).select(
        key.alias("image_id"), "box_no",
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), x.alias("x"), y.alias("y"),
        (F.col("l_quantity") * 6 - 5).alias("bw"), (F.col("l_quantity") * 9 - 8).alias("bh"), category.alias("category_id"),
        (F.col("l_linenumber") == 7).alias("ignore_flag"), F.when(key % 6 == 5, "none").otherwise((34 + key % 6).cast("string")).alias("recording"))


def preds(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """Detector output: jittered boxes with a confidence; lines of high tax are displaced. Columns of lines() that are named are kept."""
    x, y = _xy()
    shift = F.when(F.col("l_tax") >= 0.07, 700).otherwise((F.col("l_linenumber") - 4) * 4)
    x1, y1 = x + shift, y + (F.col("l_linenumber") % 3) * 3
    conf = ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 31) % 1000) / 1000.0
    return (lines(spark, sf_dir) if kept else table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("image_id"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity") * 6 - 5).alias("x2"), (y1 + F.col("l_quantity") * 9 - 8).alias("y2"),
        conf.alias("conf"), F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("cls"), *kept)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame sequences: a user's events in order; a null detection is a frame that the detector skipped."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("frame_id"), F.col("user_id").alias("recording"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"),
        "ts", F.least("value", F.lit(255.0)).alias("mean_luma"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("detection"))


def levels(vectors: DataFrame, *kept: str) -> DataFrame:
    """Pixel rows (vec_id, y, x, l) of vectors, and columns that are kept: each is a luma plane of 8 by 8."""
    e = vectors.select(*kept, "vec_id", F.posexplode("embedding").alias("pos", "v"))
    level = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("v").cast("double") + 0.3) * 425.0).cast("double")))
    return e.select(*kept, "vec_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), level.alias("l"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma planes as pixel rows: each vector is a plane of 8 by 8."""
    return levels(table(spark, sf_dir, "embeddings")).withColumnRenamed("vec_id", "frame_id")


def mosaic_of() -> Column:
    """The number of the larger plane that a vector is part of."""
    return F.floor(F.col("vec_id") / 16)


def tiled(px: DataFrame, frame: Column | str) -> DataFrame:
    """Pixel rows of levels() by their places in larger planes, which frame names: 16 vectors in a row of ids side by side, four by four, are one of 32 by 32."""
    tile = F.col("vec_id") % 16
    return px.select(frame, (F.floor(tile / 4) * 8 + F.col("y")).cast("int").alias("y"), (tile % 4 * 8 + F.col("x")).cast("int").alias("x"), "l", "vec_id")


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger luma planes as pixel rows."""
    return tiled(levels(table(spark, sf_dir, "embeddings")), mosaic_of().alias("frame_id"))


def nights(px: DataFrame, number: str = "frame_id") -> DataFrame:
    """Planes as by night: every third, by their number, a fifth as bright, every third half, others four fifths; lamps stay."""
    return px.withColumn("l", F.when(F.col("l") >= 235, F.col("l")).otherwise(F.floor(F.col("l") * (2 + F.col(number) % 3 * 3) / 10).cast("double")))


def coloured(px: DataFrame) -> DataFrame:
    """Planes in colour: blue is the level, green and red are lower, by patterns of their own."""
    l, y, x = F.col("l"), F.col("y"), F.col("x")
    return px.withColumns({"b": l, "g": F.floor(l * 8 / 10).cast("double") + (x * 13 + y * 7) % 20, "r": F.floor(l * 6 / 10).cast("double") + (x * 5 + y * 17) % 40})


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma planes whole: frame_id and luma, 64 levels row by row."""
    e = table(spark, sf_dir, "embeddings")
    level = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((v.cast("double") + 0.3) * 425.0).cast("double")))
    return e.select(F.col("vec_id").alias("frame_id"), F.col("label").alias("recording"), F.transform("embedding", level).alias("luma"))


#: The same views for DuckDB, as common table expressions.
BOXES = """v_boxes as (
select l_orderkey as image_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as box_no,
    1920 as width, 1080 as height, (l_partkey * 37) % 2000 - 40 as x, (l_suppkey * 53) % 1120 - 20 as y, l_quantity * 6 - 5 as bw, l_quantity * 9 - 8 as bh,
    case when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 4 when l_linestatus = 'F' then 2 else 3 end as category_id, l_linenumber = 7 as ignore_flag,
    case when l_orderkey % 6 = 5 then 'none' else cast(34 + l_orderkey % 6 as varchar) end as recording from lineitem),
v_clamped as (select *, greatest(x, 0) as x1, greatest(y, 0) as y1, least(x + bw, width) as x2, least(y + bh, height) as y2 from v_boxes),
v_kinds as (select image_id, recording, bool_or(category_id = 1 and not ignore_flag and x2 - x1 > 1 and y2 - y1 > 1) as has_ped,
    bool_or(not (category_id = 1 and not ignore_flag) and (category_id = 4 or ignore_flag)) as has_ignore,
    bool_or(not (category_id = 1 and not ignore_flag) and not (category_id = 4 or ignore_flag) and category_id in (2, 3)) as has_rider from v_clamped group by image_id, recording)"""
PREDS = """v_preds as (
select l_orderkey as image_id, (l_partkey * 37) % 2000 - 40 + case when l_tax >= 0.07 then 700 else (l_linenumber - 4) * 4 end as x1, (l_suppkey * 53) % 1120 - 20 + (l_linenumber % 3) * 3 as y1,
    l_quantity * 6 - 5 as bw, l_quantity * 9 - 8 as bh, ((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 1000) / 1000.0 as conf, case when l_returnflag = 'A' then 1 else 2 end as cls from lineitem)"""
FRAMES = """v_frames as (
select event_id as frame_id, user_id as recording, row_number() over (partition by user_id order by ts, event_id) as seq, ts, least(value, 255.0) as mean_luma,
    case when event_type in ('click', 'view') then event_type end as detection from events)"""
PIXELS = """v_pixels as (
select vec_id as frame_id, label as recording, cast(floor(pos / 8) as int) as y, pos % 8 as x, least(255.0, greatest(0.0, floor((cast(v as double) + 0.3) * 425.0))) as l
from (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings))"""
MOSAICS = """v_mosaics as (
select frame_id // 16 as frame_id, cast((frame_id % 16) // 4 * 8 + y as int) as y, cast((frame_id % 16) % 4 * 8 + x as int) as x, l, frame_id as vec_id from v_pixels)"""
NIGHTS = """v_nights as (
select frame_id, y, x, case when l >= 235 then l else floor(l * (2 + frame_id % 3 * 3) / 10) end as l from {source})"""
COLOURED = """v_coloured as (
select *, l as b, floor(l * 8 / 10) + (x * 13 + y * 7) % 20 as g, floor(l * 6 / 10) + (x * 5 + y * 17) % 40 as r from {source})"""
