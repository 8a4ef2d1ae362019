"""Queries that write annotations in the formats of other tools and read them back, pack training sets, and profile pools; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import geometry as G
from lumenlake.functions import stats as S
from lumenlake.operators import annotations as A
from lumenlake.operators import blobs as B
from lumenlake.operators import detection as D
from lumenlake.operators import packaging as PK
from lumenlake.plans import annotation_queries as AQ
from lumenlake.plans import views as V
from lumenlake.sources import annotations as SRC
from lumenlake.sources import sinks
from lumenlake.sources.shared import scratch

LABELS = {1: "bollard", 2: "Bicycle", 3: "stair_up", 4: "sidewalk"}


def _names() -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("category_id"))


def coco_index(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes written as documents of one image each and read back: what each recording has."""
    path = scratch(spark, "coco")
    b = V.boxes(spark, sf)
    image = F.struct(F.col("image_id").alias("id"), F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".png")).alias("file_name"), "width", "height", F.when(F.col("recording") != "none", F.col("recording").cast("double")).alias("recordings_id"))
    box = F.struct("image_id", "category_id", F.array(*(F.col(c).cast("double") for c in ("x", "y", "bw", "bh"))).alias("bbox"), F.when(F.col("ignore_flag"), "1").otherwise("0").alias("ignore"))
    b.groupBy("image_id").agg(F.array(F.first(image)).alias("images"), F.collect_list(box).alias("annotations")).drop("image_id").write.json(path)
    images, boxes = SRC.coco(spark, path, lines=True)
    n = images.groupBy("recording").agg(F.count(F.lit(1)).alias("images"))
    return n.join(boxes.groupBy("recording").agg(F.count(F.lit(1)).alias("boxes"), F.count_if("ignore_flag").alias("ignored"), F.round(F.sum(F.col("bw") * F.col("bh")), 1).alias("area")), "recording")


def _cvat(spark: SparkSession, sf: str) -> str:
    """Images as XML, a file for each task: boxes of half of the images, polygons around those of the others."""
    path = scratch(spark, "cvat")
    b = V.boxes(spark, sf).withColumn("label", _names())
    x1, y1, x2, y2 = F.col("x"), F.col("y"), F.col("x") + F.col("bw"), F.col("y") + F.col("bh")
    shape = F.struct(F.col("label").alias("_label"), *(c.cast("double").alias(n) for n, c in (("_xtl", x1), ("_ytl", y1), ("_xbr", x2), ("_ybr", y2))))
    corner = lambda *p: F.concat_ws(",", *(c.cast("double").cast("string") for c in p))
    polygon = F.struct(F.col("label").alias("_label"), F.concat_ws(";", corner(x1, y1), corner(x2, y1), corner(x2, y2)).alias("_points"))
    even = F.col("image_id") % 2 == 0
    images = b.groupBy("image_id").agg(
        F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("_name"), F.first("width").alias("_width"), F.first("height").alias("_height"),
        F.collect_list(F.when(even, shape)).alias("box"), F.collect_list(F.when(~even, polygon)).alias("polygon"))
    images.drop("image_id").write.format("xml").option("rowTag", "image").option("rootTag", "annotations").save(path)
    return path


def cvat_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of XML files by class, those of images without any among them, and what was dropped."""
    boxes, counts = SRC.cvat_boxes(spark, _cvat(spark, sf), {"bollard": 2, "Bicycle": 1}, min_width=20)
    kept = boxes.groupBy(F.coalesce(F.col("cls").cast("string"), F.lit("background")).alias("what")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), 1).alias("area"))
    lost = counts.select(F.concat(F.lit("lost_"), "label").alias("what"), (F.col("dropped") + F.col("small")).alias("n"), F.lit(None).cast("double").alias("area"))
    return kept.unionByName(lost)


def surface_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes around shapes that are stairs, whether given as boxes or polygons."""
    s = SRC.surface_boxes(spark, _cvat(spark, sf))
    return s.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("image_id"), *(F.round(c, 1).alias(c) for c in AQ.BOX))


def label_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Label texts written and read back: boxes and background images of each split."""
    path = scratch(spark, "labels")
    norm = A.normalised(V.boxes(spark, sf)).join(V.boxes(spark, sf).select("image_id", "box_no", "category_id"), ["image_id", "box_no"])
    boxes = norm.select(F.col("image_id").alias("image"), F.col("category_id").alias("cls"), "cx", "cy", "w", "h")
    images = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.when(F.col("o_orderstatus") == "F", "val").otherwise("train").alias("split"))
    sinks.write_labels(sinks.label_texts(images, boxes), path)
    t = SRC.label_table(spark, path)
    return t.groupBy("split").agg(F.count_distinct("image").alias("images"), F.count("cls").alias("boxes"), F.count_if(F.col("cls").isNull()).alias("background"), F.round(F.sum("cx"), 3).alias("cx"), F.round(F.sum(F.col("w") * F.col("h")), 3).alias("area"))


def prediction_files(spark: SparkSession, sf: str) -> DataFrame:
    """A detector's output as CSV, read back: what each class has at the confidence that counts."""
    path = scratch(spark, "predictions")
    V.preds(spark, sf).select("image_id", "cls", "conf", *(F.col(c).cast("double").alias(c) for c in AQ.BOX)).write.csv(path, header=True)
    p = SRC.predictions(spark, path)
    return p.where(F.col("conf") >= D.CONF).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("images"), F.round(F.avg("conf"), 5).alias("conf"), F.round(F.sum("x2"), 1).alias("x2"))


def decoded_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Raw head output, centres and sizes with a score for each of three classes, as boxes."""
    p = V.preds(spark, sf)
    score = lambda k: F.when(F.col("cls") == k, F.col("conf")).otherwise(F.col("conf") / 2 + 0.1 * k - 0.1).cast("double")
    centre = [(F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")]
    anchors = p.select("image_id", F.array(*(c.cast("double") for c in centre), *(score(k) for k in (0, 1, 2))).alias("raw"))
    d = D.decoded_boxes(anchors, 3)
    return d.groupBy("image_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("conf"), 4).alias("conf"), *(F.round(F.sum(c), 2).alias(c) for c in AQ.BOX))


def _emitted(spark: SparkSession, sf: str) -> DataFrame:
    orders = V.table(spark, sf, "orders")
    images = orders.select(F.col("o_orderkey").alias("image"), F.col("o_orderkey").alias("number"))
    files = orders.select(F.col("o_orderkey").alias("image"), F.lit(V.WIDTH).alias("width"), (F.lit(V.HEIGHT) + F.col("o_orderkey") % 5 * 300).cast("int").alias("height"), (F.col("o_orderstatus") != "P").alias("made"))
    norm = A.normalised(V.boxes(spark, sf)).join(V.boxes(spark, sf).select("image_id", "box_no", "category_id"), ["image_id", "box_no"])
    boxes = norm.select(F.col("image_id").alias("image"), F.col("category_id").alias("cls"), "cx", "cy", "w", "h")
    return PK.emitted(images, boxes, files, "number", "aihub", most=1000)


def emitted_images(spark: SparkSession, sf: str) -> DataFrame:
    """A packed set of a thousand images: sizes, boxes and the length of each label text."""
    return _emitted(spark, sf).select("split", "image", "stem", "width", "height", "boxes", F.length("text").cast("long").alias("chars"))


def emit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return PK.emit_summary(_emitted(spark, sf))


def _night_planes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Planes by night with their pool, a vector's label."""
    pools = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("pool"))
    return V.nights(V.pixels(spark, sf)), pools


def pool_brightness(spark: SparkSession, sf: str) -> DataFrame:
    """Pools of planes: mean and median level, shares under two thresholds, and the mean share of saturated pixels."""
    px, pools = _night_planes(spark, sf)
    per = px.groupBy("frame_id").agg(F.avg("l").alias("mean"), (100 * S.share(F.col("l") >= 250)).alias("saturated")).join(pools, "frame_id")
    return per.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("mean"), 3).alias("mean"), F.round(F.percentile("mean", 0.5), 3).alias("median"), F.round(S.share(F.col("mean") < 60), 5).alias("under_60"),
        F.round(S.share(F.col("mean") < 40), 5).alias("under_40"), F.round(F.avg("saturated"), 3).alias("saturated"))


def recon_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Planes by band: how many, their share, those with a wanted object, and medians of their lamps and blobs."""
    px, pools = _night_planes(spark, sf)
    probe = B.luma_probe(px).join(pools.select("frame_id", (F.col("pool") % 3 == 0).alias("wanted")), "frame_id").withColumn("band", S.luma_band(F.col("mean")))
    out = probe.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if("wanted").alias("wanted"), *(F.round(F.percentile(c, 0.5), 4).alias(c) for c in ("lamp", "big", "blobs")))
    # three rows at most, so that a window over all of them is small
    return out.select("band", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 5).alias("share"), "wanted", "lamp", "big", "blobs")


QUERIES = {f.__name__: f for f in (
    coco_index, cvat_boxes, surface_boxes, label_round_trip, prediction_files, decoded_heads, emitted_images, emit_summary, pool_brightness, recon_counts)}

from lumenlake.plans.image_queries import PROBE, REACH  # noqa: E402

EMIT = f"""{AQ.NORM}, o as (select o_orderkey as image, o_orderstatus <> 'P' as made, 1080 + o_orderkey % 5 * 300 as h0, row_number() over (order by o_orderkey) - 1 as rk, count(*) over () as n from orders),
    th as (select distinct o.* from o left join (select unnest(range(1000)) as k) t on rk = floor(k * n / 1000) where n <= 1000 or k is not null),
    sp as (select *, case when row_number() over (order by image) > count(*) over () - floor(count(*) over () * 0.2) then 'val' else 'train' end as split from th),
    bx as (select n.image_id as image, count(*) as boxes, sum(length(printf('%d %.6f %.6f %.6f %.6f', category_id, cx::double, cy::double, n.w::double, n.h::double))) + count(*) - 1 as chars from n join v_boxes using (image_id, box_no) group by 1),
    em as (select split, sp.image, 'aihub_' || sp.image as stem, cast(case when greatest(1920, h0) > 640 then round_even(1920 * (640.0::double / greatest(1920, h0)), 0) else 1920 end as int) as width, cast(case when greatest(1920, h0) > 640 then round_even(h0 * (640.0::double / greatest(1920, h0)), 0) else h0 end as int) as height,
        coalesce(boxes, 0) as boxes, coalesce(chars, 0)::bigint as chars from sp left join bx using (image) where made)"""
LABELLED = "l as (select *, case category_id when 1 then 'bollard' when 2 then 'Bicycle' when 3 then 'stair_up' else 'sidewalk' end as label from v_boxes)"

ORACLES = {
    "coco_index": f"{AQ.B} select recording, count(distinct image_id) as images, count(*) as boxes, count(*) filter (ignore_flag) as ignored, round(sum(bw * bh)::double, 1) as area from v_boxes group by 1",
    "cvat_boxes": f"""{AQ.B}, {LABELLED}, c as (select *, category_id in (1, 2) and image_id % 2 = 0 and x2 > x1 and y2 > y1 and x2 - x1 >= 20 as ok from (select image_id, label, category_id, least(greatest(x, 0), 1920) as x1, least(greatest(y, 0), 1080) as y1, greatest(least(x + bw, 1920), 0) as x2, greatest(least(y + bh, 1080), 0) as y2 from l))
        select case category_id when 1 then '2' else '1' end as what, count(*) as n, round(sum((x2 - x1) * (y2 - y1))::double, 1) as area from c where ok group by 1
        union all select 'background', count(*), null from (select image_id from c group by 1 having not bool_or(ok))
        union all select 'lost_' || label, count(*), null from c where not ok and image_id % 2 = 0 group by 1""",
    "surface_boxes": f"{AQ.B}, {LABELLED} select image_id, round(x::double, 1) as x1, round(y::double, 1) as y1, round((x + bw)::double, 1) as x2, round((y + bh)::double, 1) as y2 from l where label like '%stair%'",
    "label_round_trip": f"""{AQ.NORM}, i as (select o_orderkey as image_id, case when o_orderstatus = 'F' then 'val' else 'train' end as split from orders)
        select split, count(distinct i.image_id) as images, count(n.image_id) as boxes, count(*) filter (n.image_id is null) as background, round(sum(cx), 3) as cx, round(sum(n.w * n.h), 3) as area from i left join n using (image_id) group by 1""",
    "prediction_files": f"with {V.PREDS} select cls, count(*) as n, count(distinct image_id) as images, round(avg(conf), 5) as conf, round(sum(x1 + bw)::double, 1) as x2 from v_preds where conf >= 0.25 group by 1",
    "decoded_heads": f"""with {V.PREDS}, s as (select *, [case when cls = 0 then conf else conf / 2 - 0.1 end, case when cls = 1 then conf else conf / 2 end, case when cls = 2 then conf else conf / 2 + 0.1 end]::double[] as sc from v_preds),
        d as (select image_id, x1, y1, x1 + bw as x2, y1 + bh as y2, list_max(sc) as conf, (list_position(sc, list_max(sc)) - 1)::int as cls from s where list_max(sc) >= 0.25)
        select image_id, cls, count(*) as n, round(max(conf), 4) as conf, round(sum(x1)::double, 2) as x1, round(sum(y1)::double, 2) as y1, round(sum(x2)::double, 2) as x2, round(sum(y2)::double, 2) as y2 from d group by 1, 2""",
    "emitted_images": f"{EMIT} select * from em",
    "emit_summary": f"{EMIT} select split, count(*) as images, sum(boxes)::bigint as boxes from em group by 1",
    "pool_brightness": f"""with {V.PIXELS}, {V.NIGHTS.format(source="v_pixels")}, f as (select frame_id, avg(l) as mean, 100 * avg((l >= 250)::int) as sat from v_nights group by 1)
        select label as pool, count(*) as n, round(avg(mean), 3) as mean, round(quantile_cont(mean, 0.5), 3) as median, round(avg((mean < 60)::int), 5) as under_60, round(avg((mean < 40)::int), 5) as under_40, round(avg(sat), 3) as saturated from f join embeddings on vec_id = frame_id group by 1""",
    "recon_counts": f"""with recursive {V.PIXELS}, {V.NIGHTS.format(source="v_pixels")}, {REACH.format(source="v_nights")}, {PROBE.format(source="v_nights")},
        b as (select *, case when mean >= 90 then 'day' when mean < 40 then 'low_light' else 'dusk' end as band, label % 3 = 0 as wanted from probe join embeddings on vec_id = frame_id)
        select band, count(*) as n, round(count(*) / (select count(*) from b), 5) as share, count(*) filter (wanted) as wanted, round(quantile_cont(lamp, 0.5), 4) as lamp, round(quantile_cont(big, 0.5), 4) as big, round(quantile_cont(blobs, 0.5), 4) as blobs from b group by 1""",
}
