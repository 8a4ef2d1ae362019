"""Exact quantiles in both definitions, gates and bands as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_quantiles(value: Column | str, shares: Sequence[float]) -> Column:
    """Exact quantiles with linear interpolation over n - 1 gaps, as an array."""
    return F.percentile(value, [float(s) for s in shares])


def exclusive_quantile(sorted_values: Column, share: float) -> Column:
    """Quantile at position share * (n + 1) of a sorted array, interpolated; null for two values or fewer."""
    n = F.size(sorted_values)
    place = share * (n + 1)
    low = F.greatest(F.lit(1), F.least(F.floor(place).cast("int"), n - 1))
    a, b = F.get(sorted_values, low - 1), F.get(sorted_values, low)
    return F.when(n > 2, a + (b - a) * (place - low))


def luma_band(luma: Column, day: float = 90, low: float = 40) -> Column:
    return F.when(luma >= day, "day").when(luma < low, "low_light").otherwise("dusk")


def width_bin(width: Column) -> Column:
    """Bins of box width in pixels."""
    return F.when(width < 4, "<4px").when(width < 8, "4~8px").when(width < 16, "8~16px").otherwise(">16px")


def gate_verdict(ms: Column, rule: str = "band", gate: float = 20.0) -> Column:
    """Four rules around one gate: `band` is undecided within a quarter of it, `double` within twice, `plain` never, `near` within 4 ms."""
    if rule == "band":
        judged = F.when(ms <= 0.75 * gate, "OK").when(ms < 1.25 * gate, "borderline").otherwise("fail")
    elif rule == "double":
        judged = F.when(ms <= gate, "OK").when(ms <= 2 * gate, "borderline").otherwise("fail")
    elif rule == "plain":
        judged = F.when(ms <= gate, "OK").otherwise("fail")
    elif rule == "near":
        judged = F.when(F.abs(ms - gate) <= 4, "borderline").when(ms < gate, "OK").otherwise("fail")
    else:
        raise ValueError(f"no rule {rule}: band, double, plain, near")
    return F.when(ms >= 0.05, judged).otherwise("—")


def share(condition: Column) -> Column:
    """The share of rows for which condition holds."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def fixed(value: Column, digits: int) -> Column:
    """value to so many digits, halves up: plain arithmetic, so that engines agree on ties."""
    unit = float(10**digits)
    return F.floor(value * unit + 0.5) / unit
