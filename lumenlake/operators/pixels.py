"""Pixel rows: histograms, weighted tone curves, neighbourhoods, masks and glare, all as aggregations and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAMP, SATURATED = 235, 250
DARK_LOW, DARK_HIGH = 3, 80


def histogram(px: DataFrame, key: str) -> DataFrame:
    """Counts of all 256 levels of each key, levels without a pixel included."""
    counts = px.groupBy(key, F.col("l").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(255))).alias("level"))
    return levels.join(counts, [key, "level"], "left").na.fill(0, ["n"])


def weighted_curve(hist: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """Adaptive gamma of each key: key, level, cdf, curve.

    Shares are pressed by pmax * ((p - pmin) / (pmax - pmin)) ** alpha and summed up; a level
    goes to 255 * (level / 255) ** (1 - cdf), cut to a whole number. A flat histogram keeps
    its levels.
    """
    whole = W.partitionBy(key)
    p = hist.withColumn("p", F.col("n") / F.sum("n").over(whole))
    span = p.withColumns({"lo": F.min("p").over(whole), "hi": F.max("p").over(whole)})
    flat = F.col("hi") - F.col("lo") < 1e-8
    w = span.withColumn("w", F.when(flat, 1.0).otherwise(F.col("hi") * F.pow((F.col("p") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(alpha))))
    cdf = F.sum("w").over(whole.orderBy("level").rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(whole)
    curve = 255 * F.pow(F.col("level") / 255, 1 - F.col("cdf"))
    return w.withColumn("cdf", cdf).select(key, "level", F.round("cdf", 5).alias("cdf"), F.when(flat, F.col("level")).otherwise(F.floor(F.round(F.least(F.greatest(curve, F.lit(0.0)), F.lit(255.0)), 6))).cast("int").alias("curve"))


def local_std(px: DataFrame, half: int, height: int, width: int) -> DataFrame:
    """px with sd, the standard deviation of a square of 2 * half + 1 around a pixel; interior pixels only.

    Two window passes, along rows and then columns, as a separable box filter.
    """
    across = W.partitionBy("frame_id", "y").orderBy("x").rowsBetween(-half, half)
    down = W.partitionBy("frame_id", "x").orderBy("y").rowsBetween(-half, half)
    row = px.withColumns({"s1": F.sum("l").over(across), "s2": F.sum(F.col("l") * F.col("l")).over(across)})
    n = (2 * half + 1) ** 2
    both = row.withColumns({"m1": F.sum("s1").over(down) / n, "m2": F.sum("s2").over(down) / n}).drop("s1", "s2")
    inside = F.col("x").between(half, width - 1 - half) & F.col("y").between(half, height - 1 - half)
    return both.filter(inside).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - F.col("m1") * F.col("m1")))).drop("m1", "m2")


def around(px: DataFrame, key: Sequence[str], value: str, name: str) -> DataFrame:
    """px with {name}_sd, {name}_response and {name}_laplace: the deviation of value in the square of 3 by 3, and what two kernels answer there.

    The response is to [1, -2, 1] along rows and then columns. Borders mirror their inner
    neighbour. Two window passes, over rows and columns of a frame.
    """
    across, down = W.partitionBy(*key, "y").orderBy("x"), W.partitionBy(*key, "x").orderBy("y")

    def sides(c: Column, w: W) -> Column:
        left, right = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce(left, right) + F.coalesce(right, left)

    v = F.col(value)
    row = px.withColumns({"__s": sides(v, across), "__q": sides(v * v, across)})
    row = row.withColumns({"__d": F.col("__s") - 2 * v, "__m": F.col("__s") + v, "__m2": F.col("__q") + v * v})
    both = row.withColumns({"__mean": (sides(F.col("__m"), down) + F.col("__m")) / 9, "__mean2": (sides(F.col("__m2"), down) + F.col("__m2")) / 9,
                            f"{name}_response": sides(F.col("__d"), down) - 2 * F.col("__d"), f"{name}_laplace": F.col("__s") + sides(v, down) - 4 * v})
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("__mean2") - F.col("__mean") * F.col("__mean")))
    return both.withColumn(f"{name}_sd", sd).withColumn(f"{name}_mean", F.col("__mean")).drop("__s", "__q", "__d", "__m", "__m2", "__mean", "__mean2")


def dark_mask(px: DataFrame, least: int) -> DataFrame:
    """px with dark: between 3 and 80, both included; in a frame with fewer than `least` such pixels, at most the 60th percentile."""
    band, frame = F.col("l").between(DARK_LOW, DARK_HIGH), W.partitionBy("frame_id")
    return px.withColumns({"__band": F.count_if(band).over(frame), "__p60": F.percentile("l", 0.6).over(frame)}).withColumn("dark", F.when(F.col("__band") >= least, band).otherwise(F.col("l") <= F.col("__p60"))).drop("__band", "__p60")


def glare(px: DataFrame, least: int) -> DataFrame:
    """Per frame: 99th percentile, share at saturation, and the median of lamp pixels where there are enough of them."""
    lamp = F.col("l") >= LAMP
    return px.groupBy("frame_id").agg(
        F.percentile("l", 0.99).alias("p99"), (100 * F.avg((F.col("l") >= SATURATED).cast("int"))).alias("saturated"),
        F.when(F.count_if(lamp) >= least, F.percentile(F.when(lamp, F.col("l")), 0.5)).alias("core"))


def tone_curve(px: DataFrame, out: Column, bins: int = 52, least_pixels: int = 2, least_frames: int = 3) -> DataFrame:
    """Median output per bin of input level: medians within frames that have enough pixels there, then over enough frames."""
    b = F.floor(F.col("l") * bins / 256).cast("int").alias("bin")
    per = px.withColumn("out", out).groupBy("frame_id", b).agg(F.count(F.lit(1)).alias("n"), F.percentile("out", 0.5).alias("m")).filter(F.col("n") >= least_pixels)
    return per.groupBy("bin").agg(F.count(F.lit(1)).alias("frames"), F.percentile("m", 0.5).alias("level")).filter(F.col("frames") >= least_frames)


def gamma_to_mean(histogram: Column, target: Column, low: float = 0.05, high: float = 6.0, steps: int = 30) -> Column:
    """The gamma that gives a frame the mean level `target`, by bisection: the mean falls as gamma rises.

    histogram: structs of level l and count n of a frame, 256 at most however large it is.
    """
    total = F.aggregate(histogram, F.lit(0.0), lambda s, h: s + h["n"])

    def mean(g: Column) -> Column:
        return F.aggregate(histogram, F.lit(0.0), lambda s, h: s + F.pow(h["l"] / 255, g) * 255 * h["n"]) / total

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        g = (s["lo"] + s["hi"]) / 2
        dark = mean(g) < target
        return F.struct(F.when(dark, s["lo"]).otherwise(g).alias("lo"), F.when(dark, g).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
