"""Annotation boxes: normal form, classes, frame kinds, integrity and dataset union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import geometry as G
from lumenlake.functions import stats as S

PEDESTRIAN, BICYCLE, MOTORBIKE, IGNORE = 1, 2, 3, 4
#: Recordings that must never be learnt from.
HELD_OUT_RECORDINGS = ("34", "38")


def with_clamped(boxes: DataFrame) -> DataFrame:
    """boxes (x, y, bw, bh, width, height) with the corners x1, y1, x2, y2 inside the frame."""
    box = G.clamp(G.xyxy(*G.cols(["x", "y", "bw", "bh"])), F.col("width"), F.col("height"))
    return boxes.withColumns(dict(zip(("x1", "y1", "x2", "y2"), box)))


def normalised(boxes: DataFrame, min_pixels: float = 1, digits: int = 6) -> DataFrame:
    """image_id, box_no, cx, cy, w, h as shares of the frame; boxes of at most min_pixels a side go.

    Sources differ in that rule: one drops what is one pixel or less, another what is empty.
    """
    clamped = with_clamped(boxes)
    box = G.cols(["x1", "y1", "x2", "y2"])
    norm = G.to_norm(box, F.col("width"), F.col("height"))
    return clamped.filter(G.larger_than(box, min_pixels)).select("image_id", "box_no", *(S.fixed(v, digits).alias(n) for n, v in zip(("cx", "cy", "w", "h"), norm)))


def union_boxes(segments: DataFrame, pad: float = 0.01) -> DataFrame:
    """One box around all segments (x1, y1, x2, y2) of an image, padded in height and clamped."""
    lo = lambda a, b: F.min(F.least(a, b))
    hi = lambda a, b: F.max(F.greatest(a, b))
    one = segments.groupBy("image_id", "width", "height").agg(lo("x1", "x2").alias("x1"), lo("y1", "y2").alias("y1"), hi("x1", "x2").alias("x2"), hi("y1", "y2").alias("y2"))
    padded = (F.col("x1"), F.col("y1") - pad * F.col("height"), F.col("x2"), F.col("y2") + pad * F.col("height"))
    return one.select("image_id", *(v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), G.clamp_both(padded, F.col("width"), F.col("height")))))


def remapped(boxes: DataFrame, mapping: Mapping[int, int], category: str = "category_id") -> tuple[DataFrame, DataFrame]:
    """(boxes of mapped categories with cls, counts of the categories that have none).

    The mapping is a literal of a handful of classes and so part of the plan.
    """
    table = F.create_map(*(F.lit(v) for kv in mapping.items() for v in kv))
    mapped = boxes.withColumn("cls", F.element_at(table, F.col(category)))
    return mapped.filter("cls is not null"), mapped.filter("cls is null").groupBy(category).agg(F.count(F.lit(1)).alias("dropped"))


def frame_flags(boxes: DataFrame) -> DataFrame:
    """image_id, recording and whether the frame has a usable pedestrian, an ignored region, a rider.

    A pedestrian whose box is degenerate sets no flag at all: the frame counts as background.
    """
    box = G.cols(["x1", "y1", "x2", "y2"])
    ped = (F.col("category_id") == PEDESTRIAN) & ~F.col("ignore_flag")
    ignored = ~ped & ((F.col("category_id") == IGNORE) | F.col("ignore_flag"))
    rider = ~ped & ~ignored & F.col("category_id").isin(BICYCLE, MOTORBIKE)
    return with_clamped(boxes).groupBy("image_id", "recording").agg(
        F.bool_or(ped & G.larger_than(box, 1)).alias("has_ped"), F.bool_or(ignored).alias("has_ignore"), F.bool_or(rider).alias("has_rider"))


def frame_kind() -> Column:
    return F.when(F.col("has_ped"), "pedestrian").when(F.col("has_ignore"), "ignore_only").when(F.col("has_rider"), "rider_only").otherwise("background")


def unlabelled_person() -> Column:
    """A person is there but where isn't known: such frames must not be learnt from."""
    return ~F.col("has_ped") & (F.col("has_ignore") | F.col("has_rider"))


def select_frames(flags: DataFrame, available: DataFrame | None = None, recordings: Sequence[str] = (), drop_unlabelled: bool = False) -> DataFrame:
    """Frames of flags that are available (left-semi on image_id), of the recordings if any are named, less unlabelled persons on request."""
    out = flags if available is None else flags.join(available.select("image_id").distinct(), "image_id", "left_semi")
    if recordings:
        out = out.filter(F.col("recording").isin(*recordings))
    return out.filter(~unlabelled_person()) if drop_unlabelled else out


def guard_recordings(recordings: Sequence[str], held_out: Sequence[str] = HELD_OUT_RECORDINGS) -> None:
    """Stops before anything is read when recordings for learning include held-out ones."""
    if bad := sorted(set(recordings) & set(held_out)):
        raise ValueError(f"recordings {', '.join(bad)} are held out")


def pair_integrity(left: DataFrame, right: DataFrame, key: str, group: str, shown: int = 5) -> DataFrame:
    """Per group: keys on both sides, on one only, the first few of those, and whether all match and any exist.

    One full outer join of distinct keys; the lists are bounded by pre-ranked rows.
    """
    a = left.select(group, key).distinct().withColumn("l", F.lit(True))
    b = right.select(group, key).distinct().withColumn("r", F.lit(True))
    both = a.join(b, [group, key], "full_outer").withColumn("side", F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both"))
    counts = both.groupBy(group).agg(*(F.count_if(F.col("side") == s).alias(n) for s, n in (("both", "paired"), ("left", "left_only"), ("right", "right_only"))))
    first = both.filter("side <> 'both'").withColumn("rn", F.row_number().over(W.partitionBy(group, "side").orderBy(key))).filter(F.col("rn") <= shown)
    of = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col(key).cast("long")))), ",")
    lists = first.groupBy(group).agg(of("left").alias("first_left"), of("right").alias("first_right"))
    out = counts.join(lists, group, "left").na.fill("", ["first_left", "first_right"])
    ok = (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("paired") > 0)
    return out.withColumn("ok", ok)


def deduped(norm: DataFrame) -> DataFrame:
    """Normalised boxes without repeats: two are one when image and all four rounded values agree."""
    return norm.dropDuplicates(["image_id", "cx", "cy", "w", "h"])


def union_sources(*sources: tuple[str, str, DataFrame]) -> DataFrame:
    """(prefix, split, boxes) sources as one dataset; prefixed image names keep sources apart."""
    parts = [df.select(F.concat(F.lit(f"{prefix}_"), F.col("image_id").cast("string")).alias("image"), F.lit(prefix).alias("source"), F.lit(split).alias("split"), "cls") for prefix, split, df in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
