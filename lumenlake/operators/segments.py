"""Matching of line segments: pairs by overlap, height and angle, and one-to-one matches of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import detection as D

#: Least common stretch along x, in pixels; largest difference of height there, and of angle in degrees.
OVERLAP, ERROR, ANGLE = 30, 10, 15


def _height(prefix: str) -> Column:
    return (F.col(f"{prefix}y1") + F.col(f"{prefix}y2")) / 2


def _angle(prefix: str) -> Column:
    return F.degrees(F.atan2(F.col(f"{prefix}y2") - F.col(f"{prefix}y1"), F.col(f"{prefix}x2") - F.col(f"{prefix}x1")))


def segment_pairs(truth: DataFrame, found: DataFrame, overlap: float = OVERLAP, error: float = ERROR, angle: float = ANGLE) -> DataFrame:
    """(image_id, gt, pred, overlap, y_error, turn) of segments of an image that lie on each other.

    truth: image_id, gt, x1, y1, x2, y2; found: image_id, pred and the same; x1 <= x2. Both
    run together along x for `overlap` at least, their middles differ in height by `error`
    at most and their directions by `angle`. Heights go in buckets of error, so that a
    segment meets those of three buckets only, not its whole image.
    """
    a = truth.select("image_id", "gt", *(F.col(c).alias(f"a_{c}") for c in D.BOX))
    b = found.select("image_id", "pred", *(F.col(c).alias(f"b_{c}") for c in D.BOX))
    a = a.withColumn("__level", F.floor(_height("a_") / error))
    b = b.withColumn("__level", F.explode(F.array(*(F.floor(_height("b_") / error) + i for i in (-1, 0, 1)))))
    common = F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")
    apart = F.abs(_height("a_") - _height("b_"))
    raw = F.abs(_angle("a_") - _angle("b_"))
    turn = F.least(raw, 180 - raw)
    near = a.join(b, ["image_id", "__level"]).where((common >= overlap) & (apart <= error) & (turn <= angle))
    return near.select("image_id", "gt", "pred", common.alias("overlap"), apart.alias("y_error"), turn.alias("turn"))


def segment_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of segment_pairs(): by falling overlap, then pred, height difference and gt."""
    ranked = pairs.select("image_id", "gt", "pred", F.lit(0).alias("cls"), F.col("overlap").cast("double").alias("conf"), (-F.col("y_error")).alias("iou"))
    return D.greedy_matches(ranked).select("image_id", "gt", "pred", F.col("conf").alias("overlap"), (-F.col("iou")).alias("y_error"))
