"""Image arms that are level maps, as columns of pixel rows, and what they do to glare, contrast and noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators import pixels as P

#: Arms: the input itself, adaptive gamma by the frame's own weighted histogram, and one gamma for all.
ARMS = ("none", "A2", "gamma")
GAMMA = 0.45


def adaptive_levels(px: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(frame_id, l, curve): where adaptive gamma puts each level that a frame has.

    Levels without a pixel have no weight and need no row; a frame that has all 256 presses
    from its rarest one, any other from none.
    """
    whole = W.partitionBy("frame_id")
    share = px.groupBy("frame_id", "l").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(whole))
    span = share.withColumns({"hi": F.max("p").over(whole), "lo": F.when(F.count(F.lit(1)).over(whole) == 256, F.min("p").over(whole)).otherwise(0.0)})
    flat = F.col("hi") - F.col("lo") < 1e-8
    w = span.withColumn("w", F.when(flat, 1.0).otherwise(F.col("hi") * F.pow((F.col("p") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(alpha))))
    cdf = F.sum("w").over(whole.orderBy("l").rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(whole)
    curve = F.floor(F.round(255 * F.pow(F.col("l") / 255, 1 - cdf), 6)).cast("double")
    return w.select("frame_id", "l", F.when(flat, F.col("l")).otherwise(curve).alias("curve"))


def applied(px: DataFrame) -> DataFrame:
    """px (frame_id, y, x, l) once for each arm, with o, the level that it gives."""
    mapped = px.join(adaptive_levels(px), ["frame_id", "l"])
    levels = {"none": F.col("l"), "A2": F.col("curve"), "gamma": F.floor(255 * F.pow(F.col("l") / 255, F.lit(GAMMA))).cast("double")}
    arms = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), levels[a].alias("o")) for a in ARMS)))
    return mapped.withColumn("a", arms).select("frame_id", "y", "x", "l", "a.arm", "a.o")


def measured(px: DataFrame, least: int, height: int, width: int, lamps: int = 3) -> DataFrame:
    """One row a frame and arm: what every arm makes of the same pixels, those of the input's masks.

    Lamps are pixels of 235 or more and have a median where there are at least `lamps`.
    Contrast is the mean local deviation on dark pixels, over the input's; gain the ratio of
    mean levels; noise the response to a kernel that planes and edges leave out.
    """
    dark = P.dark_mask(px, least).select("frame_id", "y", "x", "dark")
    near = P.around(P.around(applied(px), ["frame_id", "arm"], "l", "i"), ["frame_id", "arm"], "o", "o")
    lit = F.col("l") >= P.LAMP
    scale = math.sqrt(math.pi / 2) / (6 * (width - 2) * (height - 2))
    one = near.join(dark, ["frame_id", "y", "x"]).groupBy("frame_id", "arm").agg(
        F.avg("l").alias("mean_in"), F.avg("o").alias("mean_out"), (100 * F.avg((F.col("o") >= P.SATURATED).cast("int"))).alias("saturated"),
        F.when(F.count_if(lit) >= lamps, F.percentile(F.when(lit, F.col("l")), 0.5)).alias("core_in"), F.when(F.count_if(lit) >= lamps, F.percentile(F.when(lit, F.col("o")), 0.5)).alias("core_out"),
        F.avg(F.when(F.col("dark"), F.col("i_sd"))).alias("local_in"), F.avg(F.when(F.col("dark"), F.col("o_sd"))).alias("local_out"),
        (F.sum(F.abs("i_response")) * scale).alias("noise_in"), (F.sum(F.abs("o_response")) * scale).alias("noise_out"), F.avg((F.col("l") - F.col("o")) ** 2).alias("error"))
    gain = (F.col("mean_out") + 1e-6) / (F.col("mean_in") + 1e-6)
    return one.withColumns({
        "gain": gain, "contrast": F.col("local_out") / (F.col("local_in") + 1e-6), "amplified": (F.col("noise_out") + 1e-6) / (F.col("noise_in") + 1e-6) / gain,
        "psnr": F.when(F.col("error") > 0, 10 * F.log10(F.lit(255.0**2) / F.col("error")))})


METRICS = ("mean_in", "mean_out", "saturated", "core_in", "core_out", "contrast", "gain", "noise_in", "noise_out", "amplified", "psnr")


def arm_summary(metrics: DataFrame) -> DataFrame:
    """Means per arm, each over the frames that have a value; contrast over gain is the ratio of their means, not the mean of ratios."""
    ratio: Column = F.avg("contrast") / F.avg("gain")
    return metrics.groupBy("arm").agg(F.count(F.lit(1)).alias("frames"), *(F.round(F.avg(m), 3).alias(m) for m in METRICS), F.round(ratio, 3).alias("contrast_over_gain"))
