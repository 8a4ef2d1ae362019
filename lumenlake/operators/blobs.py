"""Blobs of lit pixels: runs along rows are nodes, touching runs of neighbouring rows edges, blobs their components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import stats as S
from lumenlake.sources.shared import cut

LAMP, DARK, CRUSHED = 235, 80, 3
#: Bands with fewer images say nothing; below this median share of lamp pixels, in percent, there is no source; a larger median blob is no lamp.
LEAST_IMAGES, LAMP_PRESENT, LARGE = 5, 0.02, 0.5


def runs(px: DataFrame) -> DataFrame:
    """(frame_id, y, x0, x1): the longest runs of neighbouring pixels along rows; px holds lit pixels only."""
    row = W.partitionBy("frame_id", "y").orderBy("x")
    return px.select("frame_id", "y", "x", (F.col("x") - F.row_number().over(row)).alias("__run")).groupBy("frame_id", "y", "__run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__run")


def touching(nodes: DataFrame, diagonal: bool = True) -> DataFrame:
    """(frame_id, a, b): runs, by y and x0, and those of the next row that they touch, at a corner too if diagonal."""
    reach = 1 if diagonal else 0
    a = nodes.select("frame_id", (F.col("y") + 1).alias("y"), F.struct("y", "x0").alias("a"), (F.col("x0") - reach).alias("lo"), (F.col("x1") + reach).alias("hi"))
    b = nodes.select("frame_id", "y", F.struct("y", "x0").alias("b"), "x0", "x1")
    return a.join(b, ["frame_id", "y"]).where((F.col("x0") <= F.col("hi")) & (F.col("x1") >= F.col("lo"))).select("frame_id", "a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(frame_id, node, root): the least node that a node of edges (frame_id, a, b) is linked with.

    Each round, nodes hook to their least neighbour, follow hooks to their ends by doubling,
    and edges between different ends are what is left; this at least halves the linked
    nodes. Rounds are tables in the shared folder.
    """
    both = edges.select("frame_id", "a", "b").union(edges.select("frame_id", F.col("b").alias("a"), F.col("a").alias("b")))
    left, found = cut(both.where("a <> b").distinct()), None
    while True:
        hooks = cut(left.groupBy("frame_id", "a").agg(F.min("b").alias("b")).select("frame_id", F.col("a").alias("node"), F.least("a", "b").alias("root"), F.lit(True).alias("moved")))
        while not hooks.where("moved").isEmpty():
            ends = hooks.select("frame_id", F.col("node").alias("root"), F.col("root").alias("end"))
            hooks = cut(hooks.join(ends, ["frame_id", "root"]).select("frame_id", "node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")))
        hooks = hooks.drop("moved")
        if found is None:
            found = hooks
        else:
            later = hooks.select("frame_id", F.col("node").alias("root"), F.col("root").alias("end"))
            found = cut(found.join(later, ["frame_id", "root"], "left").select("frame_id", "node", F.coalesce("end", "root").alias("root")))
        end = lambda c: hooks.select("frame_id", F.col("node").alias(c), F.col("root").alias(f"{c}_end"))
        left = cut(left.join(end("a"), ["frame_id", "a"]).join(end("b"), ["frame_id", "b"]).where("a_end <> b_end").select("frame_id", F.col("a_end").alias("a"), F.col("b_end").alias("b")).distinct())
        if left.isEmpty():
            return found


def blobs(px: DataFrame, diagonal: bool = True) -> DataFrame:
    """(frame_id, y, x, area, top, bottom, left, right): every blob of lit pixels px (frame_id, y, x), by its first pixel in reading order.

    Repeated pixels count once; empty input gives no rows. Pixels with a null place are in no blob.
    """
    nodes = cut(runs(px.select("frame_id", "y", "x").where("y is not null and x is not null").distinct()))
    root = components(touching(nodes, diagonal)).select("frame_id", F.col("node.y").alias("y"), F.col("node.x0").alias("x0"), "root")
    own = nodes.join(root, ["frame_id", "y", "x0"], "left").withColumn("root", F.coalesce("root", F.struct("y", "x0")))
    return own.groupBy("frame_id", "root").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x0").alias("left"), F.max("x1").alias("right")).select(
        "frame_id", "root.y", F.col("root.x0").alias("x"), "area", "top", "bottom", "left", "right")


def luma_probe(px: DataFrame) -> DataFrame:
    """One row a frame: mean level, shares of dark, crushed and lamp pixels and of the largest blob of lamps (percent), and its number of blobs.

    A frame without a lamp pixel has no blobs and a largest one of 0.
    """
    level = F.col("l")
    per = px.groupBy("frame_id").agg(F.avg(level).alias("mean"), *((100 * S.share(c)).alias(n) for n, c in (("dark", level <= DARK), ("crush", level < CRUSHED), ("lamp", level >= LAMP))), F.count(F.lit(1)).alias("__n"))
    found = blobs(px.where(level >= LAMP)).groupBy("frame_id").agg(F.max("area").alias("__big"), F.count(F.lit(1)).alias("blobs"))
    joined = per.join(found, "frame_id", "left")
    return joined.select("frame_id", "mean", "dark", "crush", "lamp", F.coalesce(100 * F.col("__big") / F.col("__n"), F.lit(0.0)).alias("big"), F.coalesce("blobs", F.lit(0)).alias("blobs"))


def source_verdicts(probe: DataFrame) -> DataFrame:
    """Per dark band of a luma_probe(): medians of its images, and what lights them; bands with few images are left out."""
    band = probe.withColumn("band", S.luma_band(F.col("mean"))).where("band <> 'day'")
    medians = band.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *(F.percentile(c, 0.5).alias(c) for c in ("lamp", "big", "blobs"))).where(F.col("n") >= LEAST_IMAGES)
    verdict = F.when(F.col("lamp") < LAMP_PRESENT, "no saturated source").when(F.col("big") > LARGE, "sky or reflection").otherwise("point lights")
    return medians.withColumn("verdict", verdict)
