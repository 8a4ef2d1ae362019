"""Detector evaluation: greedy matching, threshold sweeps, error taxonomies, average precision, deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import geometry as G

MATCH, NEAR = 0.5, 0.3
CONF = 0.25
SWEEP = (0.25, 0.1, 0.05, 0.01)
BOX = ("x1", "y1", "x2", "y2")


def overlaps(truth: DataFrame, preds: DataFrame, least: float, same_class: bool = True) -> DataFrame:
    """(image_id, gt, pred, gt_cls, cls, conf, iou) of truths and predictions of an image with at least that overlap.

    truth: image_id, gt, cls, corners; preds: image_id, pred, cls, conf, corners. One equi-join
    on the image; the overlap is a join condition, so that other pairs never leave it.
    """
    a, b = truth.alias("a"), preds.alias("b")
    value = G.iou(tuple(F.col(f"a.{c}") for c in BOX), tuple(F.col(f"b.{c}") for c in BOX))
    on = (F.col("a.image_id") == F.col("b.image_id")) & (value >= least)
    if same_class:
        on = on & F.col("b.cls").between(F.col("a.cls"), F.col("a.cls"))  # no further key, so that rows dealt by image stay
    return a.join(b, on).select(F.col("a.image_id").alias("image_id"), "gt", "pred", F.col("a.cls").alias("gt_cls"), F.col("b.cls").alias("cls"), "conf", value.alias("iou"))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches (image_id, gt, pred, cls, conf, iou) of overlaps(): by falling confidence, then pred, overlap and gt.

    A fold over an image's sorted pairs takes each whose two ends are still free. Taking in
    order of confidence makes the matches at any higher threshold a prefix of these.
    """
    pair = F.struct((-F.col("conf")).alias("o"), F.col("pred"), (-F.col("iou")).alias("i"), F.col("gt"), F.col("cls"))
    grouped = pairs.groupBy("image_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    none = F.slice("pairs", F.lit(1), F.lit(0))
    free = lambda got, p: ~F.exists(got, lambda g: (g["pred"] == p["pred"]) | (g["gt"] == p["gt"]))
    taken = F.aggregate("pairs", none, lambda got, p: F.when(free(got, p), F.concat(got, F.array(p))).otherwise(got))
    return grouped.select("image_id", F.explode(taken).alias("m")).select("image_id", "m.gt", "m.pred", "m.cls", (-F.col("m.o")).alias("conf"), (-F.col("m.i")).alias("iou"))


def conf_sweep(truth: DataFrame, preds: DataFrame, matches: DataFrame, images: int, thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """conf, cls, gt, tp, recall, fp, fp_per_image at each threshold, of one matching at the lowest."""
    steps = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("t")
    n = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("gt")).select("*", steps)
    per = lambda df, name: df.groupBy("cls").agg(*(F.count_if(F.col("conf") >= t).alias(f"c{i}") for i, t in enumerate(thresholds))).select(
        "cls", F.explode(F.array(*(F.struct(F.lit(float(t)).alias("t"), F.col(f"c{i}").alias(name)) for i, t in enumerate(thresholds)))).alias("r")).select("cls", "r.*")
    both = n.join(per(matches, "tp"), ["cls", "t"], "left").join(per(preds, "made"), ["cls", "t"], "left").na.fill(0, ["tp", "made"])
    fp = F.col("made") - F.col("tp")
    return both.select(F.col("t").alias("conf"), "cls", "gt", "tp", F.round(F.col("tp") / F.col("gt"), 4).alias("recall"), fp.alias("fp"), F.round(fp / images, 4).alias("fp_per_image"))


def _beside(a: DataFrame, b: DataFrame, number: str, how: str) -> DataFrame:
    """a joined with b (image_id, number, ...) on both. The image alone is the key, by which both lie already after any step here, so that no row moves again."""
    b = b.withColumnsRenamed({"image_id": "__image", number: "__number"})
    joined = a.join(b, (F.col("image_id") == F.col("__image")) & F.col(number).between(F.col("__number"), F.col("__number")), how)
    return joined.drop("__image", "__number")


def missed(truth: DataFrame, preds: DataFrame, matches: DataFrame, conf: float = CONF, pairs: DataFrame | None = None) -> DataFrame:
    """Truths without a match and why: nearmiss, lowconf, merged or blind, in this order.

    nearmiss: the best overlap with a prediction of the class lies in [0.3, 0.5). lowconf: one
    under the threshold overlaps by 0.5. merged: the best overlapping prediction went to
    another truth. blind: none of these. pairs are overlaps() of all truths and predictions of
    a class, where they are at hand.
    """
    won = matches.filter(F.col("conf") >= conf).select("image_id", "gt", "pred")
    # a truth of no image meets nothing; the others are read, and dealt, as predictions are
    nowhere, truth = truth.where("image_id is null"), truth.where("image_id is not null")
    lost = _beside(truth, won.select("image_id", "gt"), "gt", "left_anti")
    met = overlaps(lost, preds, 1e-9) if pairs is None else _beside(pairs, lost.select("image_id", "gt"), "gt", "left_semi")
    near = _beside(met, won.select("image_id", "pred", F.lit(True).alias("taken")), "pred", "left")
    sure = F.col("conf") >= conf
    best = F.max(F.when(sure, F.struct("iou", (-F.col("pred")).alias("o"), F.coalesce("taken", F.lit(False)).alias("taken"))))
    seen = near.groupBy("image_id", "gt").agg(best.alias("best"), F.max(F.when(~sure, F.col("iou"))).alias("low"))
    iou = F.coalesce(F.col("best.iou"), F.lit(0.0))
    reason = F.when((iou >= NEAR) & (iou < MATCH), "nearmiss").when(F.col("low") >= MATCH, "lowconf").when(F.col("best.taken"), "merged").otherwise("blind")
    return _beside(lost, seen, "gt", "left").withColumn("reason", reason).unionByName(nowhere.withColumn("reason", F.lit("blind")), allowMissingColumns=True)


def false_alarms(truth: DataFrame, preds: DataFrame, matches: DataFrame, conf: float = CONF) -> DataFrame:
    """Predictions at conf without a match and why: dup, nearmiss, confusion or ghost, in this order.

    dup: overlaps a truth of its class by 0.5, which is taken. nearmiss: by [0.3, 0.5).
    confusion: overlaps a truth of another class by 0.3. ghost: none of these.
    """
    sure = preds.filter(F.col("conf") >= conf)
    lost = sure.join(matches.select("image_id", "pred"), ["image_id", "pred"], "left_anti")
    near = overlaps(truth, lost, NEAR, same_class=False)
    same = F.col("gt_cls") == F.col("cls")
    seen = near.groupBy("image_id", "pred").agg(F.max(F.when(same, F.col("iou"))).alias("own"), F.max(F.when(~same, F.col("iou"))).alias("other"))
    reason = F.when(F.col("own") >= MATCH, "dup").when(F.col("own") >= NEAR, "nearmiss").when(F.col("other") >= NEAR, "confusion").otherwise("ghost")
    return lost.join(seen, ["image_id", "pred"], "left").withColumn("reason", reason)


def average_precision(truth: DataFrame, preds: DataFrame, matches: DataFrame, points: int = 101) -> DataFrame:
    """Interpolated average precision per class: the mean over recall levels of the best precision at that recall or more.

    Predictions of one class and confidence count together, which makes the curve a running
    sum over at most as many rows as there are confidences.
    """
    hit = preds.join(matches.select("image_id", "pred", F.lit(1).alias("hit")), ["image_id", "pred"], "left")
    by_conf = hit.groupBy("cls", "conf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("tp"))
    run = W.partitionBy("cls").orderBy(F.desc("conf")).rowsBetween(W.unboundedPreceding, 0)
    n = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("gt"))
    curve = by_conf.select("cls", "conf", F.sum("tp").over(run).alias("tp"), F.sum("n").over(run).alias("made")).join(n, "cls").select("cls", (F.col("tp") / F.col("gt")).alias("recall"), (F.col("tp") / F.col("made")).alias("precision"))
    level = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("recall") * (points - 1)).cast("int")), lambda i: i)).alias("level")
    best = curve.select("cls", "precision", level).groupBy("cls", "level").agg(F.max("precision").alias("p"))
    return best.groupBy("cls").agg((F.sum("p") / points).alias("ap"))


#: The ten overlaps of a mean average precision.
TEN = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def matches_by_overlap(pairs: DataFrame, thresholds: Sequence[float] = TEN) -> DataFrame:
    """Matches (t, image_id, gt, pred, cls, conf, iou) at each least overlap t of overlaps() at the least of them: one join serves all."""
    steps = F.explode(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: t <= F.col("iou")))
    dealt = pairs.withColumn("t", steps).withColumn("image_id", F.struct("t", "image_id"))
    return greedy_matches(dealt).select("image_id.t", "image_id.image_id", "gt", "pred", "cls", "conf", "iou")


def mean_average_precision(truth: DataFrame, preds: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = TEN, points: int = 101) -> DataFrame:
    """Per class: map50_95, the mean of its average precisions over thresholds; map50, and precision and recall where F1 at the first threshold is greatest.

    pairs are overlaps() at the first threshold. A class without a match has 0 for both
    means and null precision and recall. Curves have a row for each class, threshold and
    confidence. Equal F1 go to the higher confidence.
    """
    n = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("gt"))
    tp = matches_by_overlap(pairs, thresholds).groupBy("cls", "t", "conf").agg(F.count(F.lit(1)).alias("tp"))
    made = preds.groupBy("cls", "conf").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    run = W.partitionBy("cls", "t").orderBy(F.desc("conf")).rowsBetween(W.unboundedPreceding, 0)
    sums = made.join(tp, ["cls", "t", "conf"], "left").na.fill(0, ["tp"]).select("cls", "t", "conf", F.sum("tp").over(run).alias("tp"), F.sum("n").over(run).alias("made"))
    curve = sums.join(n, "cls").select("cls", "t", "conf", (F.col("tp") / F.col("gt")).alias("recall"), (F.col("tp") / F.col("made")).alias("precision"))
    level = F.explode(F.sequence(F.lit(0), F.floor(F.col("recall") * (points - 1)).cast("int"))).alias("level")
    best = curve.select("cls", "t", "precision", level).groupBy("cls", "t", "level").agg(F.max("precision").alias("p"))
    means = best.groupBy("cls", "t").agg((F.sum("p") / points).alias("ap")).groupBy("cls").agg((F.sum("ap") / len(thresholds)).alias("map50_95"), F.max(F.when(F.col("t") == thresholds[0], F.col("ap"))).alias("map50"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    point = curve.where((F.col("t") == thresholds[0]) & (F.col("recall") > 0)).groupBy("cls").agg(F.max(F.struct(F.round(f1, 9).alias("f1"), "conf", "precision", "recall")).alias("p"))
    return n.select("cls").join(means, "cls", "left").join(point, "cls", "left").select("cls", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("map50_95", "map50")), "p.precision", "p.recall")


def nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each box of a the box of b in its image with the least L1 distance of corners; not exclusive."""
    x, y = a.alias("x"), b.alias("y")
    d = G.l1(tuple(F.col(f"x.{c}") for c in BOX), tuple(F.col(f"y.{c}") for c in BOX))
    return x.join(y, "image_id").groupBy("image_id", F.col("x.box").alias("box")).agg(F.min(F.struct(d.alias("distance"), F.abs(F.col("x.conf") - F.col("y.conf")).alias("conf_diff"), F.col("y.box").alias("other"))).alias("n")).select("image_id", "box", "n.*")


def fp_rate(images: DataFrame, preds: DataFrame, key: Sequence[str], firing: Column) -> DataFrame:
    """Share of all images of a key with a firing prediction; images without predictions count."""
    n = preds.filter(firing).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return images.join(n, "image_id", "left").groupBy(*key).agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("n") > 0).alias("fired"), F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"))


def with_baseline(df: DataFrame, key: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """df with delta columns against the row whose key is baseline, null without one; of rows that repeat that key the greatest values count."""
    base = df.filter(F.col(key) == baseline).agg(*(F.max(m).alias(f"__{m}") for m in metrics))
    return df.crossJoin(F.broadcast(base)).select(*df.columns, *(F.round(F.col(m) - F.col(f"__{m}"), 4).alias(f"d_{m}") for m in metrics))


def error_benchmark(errors: DataFrame, images: int) -> DataFrame:
    """One row per run of a long error summary (run, kind, class, reason, width_bin, count).

    Recall by width bin of each class is matched over truths; false alarms are counted by
    reason; R_conf and FP_per_image follow a sweep's tp@t and fp@t rows, whose threshold is
    part of kind. Truths without a match are the misses: gt = matched + fn for each class.
    """
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    kind, cls = F.col("kind"), F.col("class")
    out = []
    for c in ("person", "bollard"):
        gt = n((kind == "GT") & (cls == c))
        out += [gt.alias(f"{c}_gt"), n((kind == "matched") & (cls == c)).alias(f"{c}_matched"), n((kind == "FN") & (cls == c)).alias(f"{c}_fn")]
        for i, b in enumerate(("<4px", "4~8px", "8~16px", ">16px")):
            here = (cls == c) & (F.col("width_bin") == b)
            out.append(F.round(F.try_divide(n((kind == "matched") & here), n((kind == "GT") & here)), 4).alias(f"{c}_r{i}"))
        out += [F.round(F.try_divide(n((kind == f"sweep_tp@{t}") & (cls == c)), gt), 4).alias(f"{c}_r_conf{t}".replace(".", "")) for t in SWEEP]
    out += [n((kind == "FP") & (F.col("reason") == r)).alias(f"fp_{r}") for r in ("dup", "nearmiss", "confusion", "ghost")]
    out += [F.round(n(kind == f"sweep_fp@{t}") / images, 3).alias(f"fp_per_image{t}".replace(".", "")) for t in SWEEP]
    return errors.groupBy("run").agg(*out)


def decoded_head(raw: Column, classes: int) -> Column:
    """(cls, conf) of an anchor's raw values (cx, cy, w, h, score of each class): the best score, the first of equals."""
    scores = F.slice(raw, F.lit(5), F.lit(classes))
    return F.struct((F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("cls"), F.array_max(scores).alias("conf"))


def decoded_boxes(anchors: DataFrame, classes: int, least: float = CONF) -> DataFrame:
    """anchors (raw besides other columns) less raw, with cls, conf and corners x1, y1, x2, y2; anchors whose best score is below least go."""
    head = anchors.withColumn("__h", decoded_head(F.col("raw"), classes)).where(F.col("__h.conf") >= least)
    cx, cy, w, h = (F.col("raw")[i] for i in range(4))
    corners = {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}
    return head.select(*(c for c in anchors.columns if c != "raw"), "__h.cls", "__h.conf", *(c.alias(n) for n, c in corners.items()))
