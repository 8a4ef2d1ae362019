"""Boxes as columns: clamping, normal form, overlap, letterbox."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def cols(names: Sequence[str]) -> Box:
    return tuple(F.col(n) for n in names)


def xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def clamp(box: Box, width: Column, height: Column) -> Box:
    """Both corners inside the frame."""
    x1, y1, x2, y2 = box
    zero = F.lit(0)
    return F.greatest(x1, zero), F.greatest(y1, zero), F.least(x2, width), F.least(y2, height)


def clamp_both(box: Box, width: Column, height: Column) -> Box:
    """Each of the four values clamped to [0, size] on its own, as segment unions need it."""
    x1, y1, x2, y2 = box
    inside = lambda v, top: F.greatest(F.lit(0), F.least(v, top))
    return inside(x1, width), inside(y1, height), inside(x2, width), inside(y2, height)


def larger_than(box: Box, least: float) -> Column:
    """Whether width and height both exceed least: 1 drops boxes of one pixel, 0 only empty ones."""
    return (box[2] - box[0] > least) & (box[3] - box[1] > least)


def to_norm(box: Box, width: Column, height: Column) -> Box:
    """Centre and size as shares of the frame."""
    x1, y1, x2, y2 = box
    return (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height


def to_pixels(norm: Box, width: Column, height: Column) -> Box:
    """Corners in whole pixels, cut towards zero."""
    cx, cy, w, h = norm
    return tuple(v.cast("int") for v in ((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height))


def area(box: Box) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0)) * F.greatest(box[3] - box[1], F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union is empty."""
    both = area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))
    return F.coalesce(F.try_divide(both.cast("double"), (area(a) + area(b) - both).cast("double")), F.lit(0.0))


def l1(a: Box, b: Box) -> Column:
    return sum((F.abs(p - q) for p, q in zip(a, b)), F.lit(0.0))


def touches(box: Box, width: Column, height: Column, tolerance: float = 2) -> dict[str, Column]:
    """Which edges of the frame a box touches."""
    left, top, right, bottom = box[0] <= tolerance, box[1] <= tolerance, box[2] >= width - tolerance, box[3] >= height - tolerance
    return {"left": left, "right": right, "top": top, "bottom": bottom, "any": left | right | top | bottom, "left_right": left & right, "top_bottom": top & bottom}


def letterbox(width: Column, height: Column, size: int) -> tuple[Column, Column, Column, Column, Column]:
    """scale, width, height, left, top of a frame fitted into a square of size; sizes round half to even."""
    scale = F.least(size / height, size / width)
    w, h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    return scale, w, h, F.floor((size - w) / 2).cast("int"), F.floor((size - h) / 2).cast("int")


def resized_height(width: Column, height: Column, target: int) -> Column:
    """The height that goes with width target, half to even."""
    return F.bround(height * target / width).cast("int")


def stroke(width: Column, height: Column) -> tuple[Column, Column]:
    """Line and rim thickness of an outline: 4 px at 720 lines, 2 and 1 at least."""
    line = F.greatest(F.lit(2), F.bround(4 * F.least(height, width) / 720).cast("int"))
    return line, F.greatest(F.lit(1), F.floor(line / 2).cast("int"))


def crop_window(cy: Column, cx: Column, size: int, height: Column, width: Column) -> tuple[Column, Column]:
    """Top and left of a window of size around a centre, moved to stay inside the frame."""
    inside = lambda c, top: F.greatest(F.lit(0), F.least(c - size // 2, top - size))
    return inside(cy, height), inside(cx, width)


def fitted(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Width and height scaled down to at most `most` pixels of width; smaller sizes stay, and heights are cut, not rounded."""
    scale = F.lit(float(most)) / width
    return F.when(width > most, F.lit(most)).otherwise(F.floor(width)), F.when(width > most, F.floor(height * scale)).otherwise(F.floor(height))


def longest_side(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Width and height whose longer one is `most` at most: never enlarged, rounded half to even, 1 at least."""
    scale = F.lit(float(most)) / F.greatest(width, height)
    side = lambda v: F.when(scale < 1, F.greatest(F.lit(1), F.bround(v * scale).cast("int"))).otherwise(v.cast("int"))
    return side(width), side(height)
