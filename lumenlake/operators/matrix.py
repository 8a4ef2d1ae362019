"""Arms as folds of named stages over pixel rows, what each does to a picture on the input's own masks, and matrices of arms by size."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import stats as S
from lumenlake.operators import enhancement as E
from lumenlake.operators import neighbourhoods as N
from lumenlake.operators import pixels as P
from lumenlake.operators import quality as Q
from lumenlake.sources.images import luma

Stage = Callable[[DataFrame], DataFrame]
CHANNELS = ("b", "g", "r")
#: An arm suppresses a lamp that it leaves below this share of its level.
SUPPRESSED = 0.95


def _level(c: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.round(c, 6)).cast("double")))


def gamma(g: float) -> Stage:
    """Every channel to the power of g."""
    return lambda px: px.withColumns({c: _level(255 * F.pow(F.col(c) / 255, F.lit(g))) for c in CHANNELS})


def light(**options: float) -> Stage:
    """Channels over the light on them."""
    return lambda px: E.divided_by_light(px, **options).drop(*CHANNELS).withColumnsRenamed({f"o{c}": c for c in CHANNELS})


def tiles(n: int, clip: float = 2.0, g: float | None = 0.75) -> Stage:
    """Grey levels equalised by tiles; channels follow in proportion."""

    def run(px: DataFrame) -> DataFrame:
        out = E.tile_equalised(px.withColumnRenamed("l", "__l").withColumn("l", _grey()), n, clip, g)
        return out.withColumns({c: _level(F.col(c) * F.col("o") / F.greatest(F.col("l"), F.lit(1.0))) for c in CHANNELS}).drop("l", "o").withColumnRenamed("__l", "l")

    return run


def _grey() -> Column:
    return luma(*(F.col(c) for c in CHANNELS)).cast("double")


class Arms:
    """Named arms, each a list of stages; those that need a sequence are named besides."""

    def __init__(self, stages: Mapping[str, Sequence[Stage]], temporal: Sequence[str] = ()) -> None:
        self.stages, self.temporal = dict(stages), frozenset(temporal)

    def applied(self, px: DataFrame, names: Sequence[str] | None = None, kept: Sequence[str] = ()) -> DataFrame:
        """(frame_id, arm, y, x, kept columns, ob, og, or): px (frame_id, y, x, height, width, b, g, r) through every arm. Pictures are single ones: an arm that needs a sequence is an error."""
        out = None
        for name in self.stages if names is None else names:
            if name in self.temporal:
                raise ValueError(f"arm {name} needs a sequence of frames and says nothing about single ones")
            if name not in self.stages:
                raise KeyError(f"no arm {name}: {', '.join(self.stages)}")
            done = px
            for stage in self.stages[name]:
                done = stage(done)
            rows = done.select("frame_id", F.lit(name).alias("arm"), "y", "x", *kept, *(F.col(c).alias(f"o{c}") for c in CHANNELS))
            out = rows if out is None else out.union(rows)
        if out is None:
            raise ValueError("no arms")
        return out


MEASURES = (
    "glare_before", "glare_after", "sat_before", "sat_after", "glare_core_before", "glare_core_after", "contrast", "gain", "contrast_gain", "ref_gamma",
    "noise_amp", "noise_luma_before", "noise_luma_after", "noise_chroma_before", "noise_chroma_after")


#: What masked() adds to pixels, and their sizes.
MASKED = ("height", "width", "l", "dark", "flat", "hi", "noise_luma_before", "noise_chroma_before")
LAB = ("light", "red", "yellow")


def masked(px: DataFrame, least: int, k: int = Q.SIDE) -> DataFrame:
    """px (frame_id, y, x, height, width, b, g, r) with its grey level l, the masks dark, flat and hi (above the 99th percentile), and its noise on flat pixels."""
    frame = W.partitionBy("frame_id")
    masks = Q.flat_dark(px.withColumn("l", _grey()), least, k).withColumn("hi", F.col("l") >= F.percentile("l", 0.99).over(frame))
    answered = Q.responses(masks, ["frame_id"], {f"__{n}": c for n, c in zip(LAB, Q.lab(*map(F.col, CHANNELS)))})
    noise = [F.avg(F.when(F.col("flat"), F.abs(f"__{n}"))).over(frame) * Q.NOISE_SCALE for n in LAB]
    return answered.withColumns({"noise_luma_before": noise[0], "noise_chroma_before": F.hypot(*noise[1:]) / math.sqrt(2)}).drop(*(f"__{n}" for n in LAB))


def measured(px: DataFrame, arms: Arms, names: Sequence[str], least: int, lamps: int = 30, k: int = Q.SIDE) -> DataFrame:
    """A row for each frame and named arm with MEASURES; px has frame_id, y, x, height, width, b, g, r.

    All masks are the input's: pixels above its 99th percentile, lamps, dark ones, flat dark
    ones. Cores are medians of lamp pixels, null with fewer than `lamps` of them; contrast is
    the local deviation on dark pixels over the input's, contrast_gain over that of the input
    under one gamma to the same mean; noise is that of flat dark pixels, noise_amp the whole
    picture's over the gain. Each step goes by frame: where px is dealt by frame_id, no pixel
    is moved, and none is written down.
    """
    key, lit, dark = ["frame_id", "arm"], F.col("l") >= P.LAMP, F.col("dark")
    both = arms.applied(masked(px, least, k), names, MASKED).withColumn("o", luma(F.col("ob"), F.col("og"), F.col("or")).cast("double"))
    v = {n: F.col(c) for n, c in (("i", "l"), ("o", "o"), ("r", "__ref"))}
    means = N.box_means(Q.against_gamma(both), key, {f"__m{n}": c for n, c in v.items()} | {f"__m{n}2": c * c for n, c in v.items()}, k, F.col("height"), F.col("width"))
    kernels = {"__kl": F.col("l"), "__ko": F.col("o"), **{f"__{n}": c for n, c in zip(LAB, Q.lab(*(F.col(f"o{c}") for c in CHANNELS)))}}
    answered = Q.responses(means, key, kernels)
    flag = lambda c: 100 * F.avg((F.col(c) >= P.SATURATED).cast("int"))
    core = lambda c: F.when(F.count_if(lit) >= lamps, F.percentile(F.when(lit, F.col(c)), 0.5))
    sd = lambda n: F.avg(F.when(dark, F.sqrt(F.greatest(F.lit(0.0), F.col(f"__m{n}2") - F.col(f"__m{n}") * F.col(f"__m{n}")))))
    noise = lambda n: F.avg(F.when(F.col("flat"), F.abs(f"__{n}"))) * Q.NOISE_SCALE
    inner = F.first((F.col("height") - 2) * (F.col("width") - 2) / (F.col("height") * F.col("width")))
    whole = lambda n: F.avg(F.abs(n)) * Q.NOISE_SCALE / inner + 1e-6
    gain = (F.avg("o") + 1e-6) / (F.avg("l") + 1e-6)
    found = {
        "glare_before": F.avg(F.when(F.col("hi"), F.col("l"))), "glare_after": F.avg(F.when(F.col("hi"), F.col("o"))), "sat_before": flag("l"), "sat_after": flag("o"), "glare_core_before": core("l"), "glare_core_after": core("o"),
        "contrast": sd("o") / (sd("i") + 1e-6), "gain": gain, "contrast_gain": sd("o") / (sd("r") + 1e-6), "ref_gamma": F.first("ref_gamma"), "noise_amp": whole("__ko") / whole("__kl") / gain,
        "noise_luma_before": F.first("noise_luma_before"), "noise_luma_after": noise("light"), "noise_chroma_before": F.first("noise_chroma_before"), "noise_chroma_after": F.hypot(noise("red"), noise("yellow")) / math.sqrt(2)}
    return answered.groupBy(*key).agg(*(found[m].alias(m) for m in MEASURES))


def summed(measures: DataFrame, key: Sequence[str]) -> DataFrame:
    """Means of MEASURES over the frames of a key that have them, norm_contrast as the ratio of means, and glare_core_n, how many frames have lamps."""
    return measures.groupBy(*key).agg(
        F.count(F.lit(1)).alias("frames"), F.count("glare_core_before").alias("glare_core_n"), *(F.avg(m).alias(m) for m in MEASURES), (F.avg("contrast") / F.avg("gain")).alias("norm_contrast"))


def axes(matrix: DataFrame, untouched: str = "none") -> DataFrame:
    """matrix (arm, size and what summed() gives) with ok_glare, ok_contrast and ok_noise, the last against the untouched input at the same size."""
    base = matrix.where(F.col("arm") == untouched).groupBy("size").agg(F.max("noise_chroma_before").alias("__base"))
    glare = F.when(F.col("glare_core_n") > 0, F.col("glare_core_after") < F.col("glare_core_before") * SUPPRESSED)
    return matrix.join(base, "size", "left").withColumns({"ok_glare": glare, "ok_contrast": F.col("contrast_gain") > 1, "ok_noise": F.col("noise_chroma_after") <= F.col("__base")}).drop("__base")


def sensitivity(judged: DataFrame) -> DataFrame:
    """Per arm of axes() with ms, its time: how far the core moves with size, and whether the verdicts on glare and on speed turn.

    An arm with lamps at fewer than two sizes has no core_range; a borderline time is no verdict.
    """
    gate = S.gate_verdict(F.col("ms"), "band")
    firm = F.when(gate != "borderline", gate)
    core = F.when(F.col("glare_core_n") > 0, F.col("glare_core_after"))
    return judged.groupBy("arm").agg(
        F.when(F.count(core) >= 2, F.max(core) - F.min(core)).alias("core_range"), (F.max("contrast_gain") - F.min("contrast_gain")).alias("contrast_range"),
        (F.count_distinct("ok_glare") > 1).alias("glare_flips"), (F.count_distinct(firm) > 1).alias("gate_flips"))


def winners(judged: DataFrame, untouched: str = "none") -> DataFrame:
    """(arm, size, ms, contrast_gain, verdict): arms of axes() with ms that hold all three axes and the speed gate, borderline ones named so."""
    verdict = S.gate_verdict(F.col("ms"), "band")
    fit = judged.where((F.col("arm") != untouched) & F.col("ok_glare") & F.col("ok_contrast") & F.col("ok_noise"))
    return fit.select("arm", "size", "ms", "contrast_gain", verdict.alias("verdict")).where("verdict in ('OK', 'borderline')")


def reduced(px: DataFrame, step: Column | int = 2) -> DataFrame:
    """px (frame_id, y, x, b, g, r) at a size smaller by step: means of blocks of step by step, in whole levels."""
    by = F.lit(step) if isinstance(step, int) else step
    return px.groupBy("frame_id", *(F.floor(F.col(c) / by).cast("int").alias(c) for c in ("y", "x"))).agg(*(F.floor(F.avg(c) + 0.5).cast("double").alias(c) for c in CHANNELS))
