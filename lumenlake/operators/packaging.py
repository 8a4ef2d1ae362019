"""A training set from labelled images: even thinning, a tail split, target sizes, and labels of images that could be made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import geometry as G
from lumenlake.operators import selection as SEL


def emitted(images: DataFrame, boxes: DataFrame, files: DataFrame, order: str, prefix: str, ratio: float = 0.2, most: int = 0, longest: int = 640) -> DataFrame:
    """(split, image, stem, width, height, boxes, text): a row for each image that is written.

    images: image and the column it is ordered by (whole numbers); boxes: image, cls, cx, cy,
    w, h; files: image, width, height, made (whether resizing it went well). In order, at
    most `most` images are kept, evenly spread (0: all), and the last int(n * ratio) go to
    val. Only then do images without a file, or whose file couldn't be made, drop out, so a
    split doesn't depend on luck. width and height are those of the resized image; text has
    a line for each box in order of class and place, six decimals each, empty for background.
    Images are numbered in buckets, so one set may hold the whole table.
    """
    named = images.withColumn("__set", F.lit(0))
    picked = SEL.thinned(named, ["__set"], [order], most) if most else named
    split = SEL.tail_split(picked, ["__set"], [order], ratio).drop("__set")
    width, height = G.longest_side(F.col("width"), F.col("height"), longest)
    made = split.join(files.where("made").select("image", width.alias("width"), height.alias("height")), "image")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h")
    texts = boxes.groupBy("image").agg(F.count(F.lit(1)).alias("boxes"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    out = made.join(texts, "image", "left").na.fill(0, ["boxes"]).na.fill("", ["text"])
    return out.select("split", "image", F.concat(F.lit(f"{prefix}_"), F.col("image").cast("string")).alias("stem"), "width", "height", "boxes", "text")


def emit_summary(rows: DataFrame) -> DataFrame:
    """Images and boxes of each split of emitted()."""
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum("boxes").alias("boxes"))
