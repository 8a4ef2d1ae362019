"""Frame sequences: held detections, flicker, static and moving pixels, exponential smoothing, motion-adaptive denoising."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators import selection

STATIC, MOVING = 6, 20


def smoothing(cutoff: float = 0.5, rate: float = 16.0) -> float:
    """The weight of a new value in a first-order low-pass filter."""
    return 1 - math.exp(-2 * math.pi * cutoff / rate)


def held(frames: DataFrame, value: str, every: int = 1) -> Column:
    """value of the last frame that has one, of frames at multiples of `every` only."""
    looked = F.when((F.col("seq") - 1) % every == 0, F.col(value))
    return F.last(looked, ignorenulls=True).over(W.partitionBy("recording").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))


def flicker(frames: DataFrame, value: str = "mean_luma") -> DataFrame:
    """Population standard deviation of the differences between neighbouring frames, per recording."""
    diff = F.col(value) - F.lag(value).over(W.partitionBy("recording").orderBy("seq"))
    return frames.withColumn("d", diff).groupBy("recording").agg(F.stddev_pop("d").alias("sigma"), F.count("d").alias("pairs"))


def pixel_pairs(px: DataFrame) -> DataFrame:
    """px (recording, frame_id, y, x, l) with prev, the same pixel in the recording's frame before."""
    return px.withColumn("prev", F.lag("l").over(W.partitionBy("recording", "y", "x").orderBy("frame_id"))).filter("prev is not null")


def temporal_noise(px: DataFrame, least: int) -> DataFrame:
    """Per recording: sigma of differences on static pixels over the square root of 2, and the shares of static and moving ones.

    A pair with fewer than `least` static or moving pixels falls back to its 5 % stillest or most moved.
    """
    pairs = pixel_pairs(px).withColumn("d", F.abs(F.col("l") - F.col("prev")))
    per = pairs.groupBy("recording", "frame_id").agg(
        F.count_if(F.col("d") < STATIC).alias("ns"), F.count_if(F.col("d") >= MOVING).alias("nm"), F.percentile("d", [0.05, 0.95]).alias("q"))
    both = pairs.join(per, ["recording", "frame_id"])
    still = F.when(F.col("ns") >= least, F.col("d") < STATIC).otherwise(F.col("d") <= F.col("q")[0])
    moved = F.when(F.col("nm") >= least, F.col("d") >= MOVING).otherwise(F.col("d") >= F.col("q")[1])
    return both.groupBy("recording").agg(
        (F.stddev_pop(F.when(still, F.col("l") - F.col("prev"))) / math.sqrt(2)).alias("sigma"), F.avg(still.cast("int")).alias("static_share"), F.avg(moved.cast("int")).alias("moving_share"))


def smoothed(frames: DataFrame, value: str, alpha: float, block: int = 512) -> DataFrame:
    """frames with ema: alpha * value + (1 - alpha) * the ema before, starting at the first value.

    A recording is cut into blocks of frames, each summed on its own with a window; what a
    block passes on to the next is folded over a recording's blocks, one row each. So a long
    recording is no long sequential task.
    """
    keep = 1 - alpha
    df = frames.withColumns({"__b": F.floor((F.col("seq") - 1) / block), "__i": (F.col("seq") - 1) % block})
    part = F.when(F.col("seq") == 1, F.col(value)).otherwise(alpha * F.col(value))
    run = W.partitionBy("recording", "__b").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    own = df.withColumn("__own", F.sum(part * F.pow(F.lit(keep), -F.col("__i"))).over(run) * F.pow(F.lit(keep), F.col("__i")))
    ends = own.groupBy("recording", "__b").agg(F.max_by("__own", "__i").alias("__end"), (F.max("__i") + 1).alias("__len"))
    chain = ends.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("__b", "__end", "__len"))).alias("bs"))
    begin = F.struct(F.array().cast("array<double>").alias("at"), F.lit(0.0).alias("s"))
    step = lambda a, b: F.struct(F.concat(a["at"], F.array(a["s"])).alias("at"), (a["s"] * F.pow(F.lit(keep), b["__len"]) + b["__end"]).alias("s"))
    carried = chain.select("recording", F.posexplode(F.aggregate("bs", begin, step, lambda a: a["at"])).alias("__b", "__carry"))
    return own.join(carried, ["recording", "__b"]).withColumn("ema", F.col("__own") + F.col("__carry") * F.pow(F.lit(keep), F.col("__i") + 1)).drop("__b", "__i", "__own", "__carry")


def transfer_curves(px: DataFrame) -> DataFrame:
    """(recording, frame_id, level, curve): the mean output o of each of 256 input levels l of a frame.

    Levels that a frame lacks lie on the line between their neighbours, or at the outermost
    one's value. Every frame gives 256 rows, however many pixels it has.
    """
    key = ["recording", "frame_id"]
    seen = px.groupBy(*key, F.col("l").cast("int").alias("level")).agg(F.avg("o").alias("mean"))
    levels = seen.select(*key).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(255))))
    w = W.partitionBy(*key).orderBy("level")
    point = F.when(F.col("mean").isNotNull(), F.struct("level", "mean"))
    both = levels.join(seen, [*key, "level"], "left").withColumns({"a": F.last(point, True).over(w.rowsBetween(W.unboundedPreceding, 0)), "b": F.first(point, True).over(w.rowsBetween(0, W.unboundedFollowing))})
    line = F.col("a.mean") + (F.col("b.mean") - F.col("a.mean")) * (F.col("level") - F.col("a.level")) / F.nullif(F.col("b.level") - F.col("a.level"), F.lit(0))
    return both.select(*key, "level", F.coalesce(line, "a.mean", "b.mean").alias("curve"))


def tone_smoothed(px: DataFrame, alpha: float, every: int = 1, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """px (recording, frame_id, y, x, l, o) with smooth: o times the gain that brings its level to the smoothed curve.

    A recording's transfer curves, of every `every`-th pixel in both directions, pass a
    first-order filter level by level. The gain is the smoothed curve over the frame's own,
    within low and high; a recording's first frame stays as it is.
    """
    curves = transfer_curves(px.filter((F.col("y") % every == 0) & (F.col("x") % every == 0)))
    order = curves.select("recording", "frame_id").distinct().withColumn("seq", F.row_number().over(W.partitionBy("recording").orderBy("frame_id")))
    rows = curves.join(order, ["recording", "frame_id"]).withColumn("of", F.col("recording")).withColumn("recording", F.struct("recording", "level"))
    ema = smoothed(rows, "curve", alpha, block=64)
    ratio = F.least(F.lit(high), F.greatest(F.lit(low), F.col("ema") / F.greatest(F.col("curve"), F.lit(1.0))))
    gains = ema.select(F.col("of").alias("recording"), "frame_id", F.col("level").cast("double").alias("l"), F.when(F.col("seq") == 1, 1.0).otherwise(ratio).alias("gain"))
    return px.join(gains, ["recording", "frame_id", "l"]).withColumn("smooth", F.least(F.lit(255.0), F.rint(F.round(F.col("o") * F.col("gain"), 6)))).drop("gain")


def denoised(planes: DataFrame, width: int, least: float = 0.25, threshold: float = 24.0) -> DataFrame:
    """planes (recording, frame_id, luma) with out: prev + a * (cur - prev) in whole levels, prev being the output before.

    a grows from least to 1 with the motion, which is the difference blurred over squares of
    3 by 3 with mirrored borders, in whole levels. State is one plane a recording: rows
    arrive sorted, and a new recording or another plane size starts afresh. A recording's
    frames depend on each other, so one task walks them; cut long recordings at gaps.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prev = object(), None
        for batch in batches:
            out = []
            for rec, luma in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                cur = np.array(luma, dtype=np.float64).reshape(-1, width)
                if rec == key and prev is not None and prev.shape == cur.shape:
                    d = np.pad(np.abs(cur - prev), 1, mode="reflect")
                    d = np.rint(np.round(sum(d[i : i + cur.shape[0], j : j + width] for i in range(3) for j in range(3)) / 9, 6))
                    a = np.clip(least + (1 - least) * d / threshold, least, 1)
                    cur = np.floor(np.round(np.clip(prev + a * (cur - prev), 0, 255), 6))
                key, prev = rec, cur
                out.append(cur.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=["recording", "frame_id", "luma", "out"])

    kind = planes.schema["recording"].dataType.simpleString()
    ordered = planes.select("recording", "frame_id", F.col("luma").cast("array<double>").alias("luma")).repartition("recording").sortWithinPartitions("recording", "frame_id")
    return ordered.mapInArrow(run, f"recording {kind}, frame_id long, luma array<double>, out array<double>")


def split_at_gaps(frames: DataFrame, at: str, gap: int, order: Sequence[str] = ("frame_id",)) -> DataFrame:
    """frames with recording a struct of recording and run: stretches without a step of `at` (whole numbers) beyond gap, and seq, the place in the run.

    State that is kept by recording then begins anew at gaps, and a recording's runs go to
    different tasks. Frames of one time go by `order`.
    """
    runs = selection.in_blocks(frames.withColumn("recording", F.struct("recording")), ["recording"], at, gap, order)
    named = runs.withColumn("recording", F.struct("recording.recording", F.col("block").cast("int").alias("run"))).drop("block")
    return named.withColumn("seq", F.row_number().over(W.partitionBy("recording").orderBy(at, *order)))


def two_paths(frames: DataFrame, at: str, gap: int, every: int = 3, alpha: float | None = None, order: Sequence[str] = ("frame_id",)) -> DataFrame:
    """(recording, run, frame_id, seq, shown, held): what is shown of each frame, and the detection that is drawn on it.

    The display path smooths mean_luma over a run. The detection path looks at every
    `every`-th raw frame of a run and holds what it found until the next; both meet by
    frame_id, of which each is one row, so that neither waits for the other. Frames of one
    time go by `order`.
    """
    runs = split_at_gaps(frames, at, gap, order)
    shown = smoothed(runs.select("recording", "frame_id", "seq", "mean_luma"), "mean_luma", smoothing() if alpha is None else alpha)
    detected = runs.select("frame_id", held(runs, "detection", every).alias("held"))
    both = shown.join(detected, "frame_id")
    return both.select("recording.recording", "recording.run", "frame_id", "seq", F.col("ema").alias("shown"), "held")
