"""Queries on annotations: conversion, integrity, selection and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import geometry as G
from lumenlake.functions import stats as S
from lumenlake.operators import annotations as A
from lumenlake.operators import selection as SEL
from lumenlake.plans import views as V

BOX = ("x1", "y1", "x2", "y2")
RATE = 5


def box_clamp_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return A.normalised(V.boxes(spark, sf))


def box_clamp_cvat_rule(spark: SparkSession, sf: str) -> DataFrame:
    kept = G.larger_than(G.cols(BOX), 0)
    return A.with_clamped(V.boxes(spark, sf)).groupBy("category_id").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.sum(F.when(kept, G.area(G.cols(BOX)))).alias("area"))


def segment_union_box(spark: SparkSession, sf: str) -> DataFrame:
    segments = V.boxes(spark, sf).withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("bw"), "y2": F.col("y") + F.col("bh")})
    return A.union_boxes(segments).select("image_id", *(F.round(c, 3).alias(c) for c in BOX))


def yolo_to_pixel(spark: SparkSession, sf: str) -> DataFrame:
    norm = A.normalised(V.boxes(spark, sf))
    px = G.to_pixels(G.cols(["cx", "cy", "w", "h"]), F.lit(V.WIDTH), F.lit(V.HEIGHT))
    return norm.select("image_id", "box_no", *(v.alias(n) for n, v in zip(BOX, px)))


def letterbox_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    scale, _, _, left, top = G.letterbox(F.col("width"), F.col("height"), 640)
    df = A.with_clamped(V.boxes(spark, sf)).filter(G.larger_than(G.cols(BOX), 1)).withColumns({"s": scale, "left": left, "top": top})
    boxed = df.withColumns({"bx": F.col("x1") * F.col("s") + F.col("left"), "by": F.col("y1") * F.col("s") + F.col("top")})
    back = F.round((F.col("bx") - F.col("left")) / F.col("s"), 3), F.round((F.col("by") - F.col("top")) / F.col("s"), 3)
    return boxed.select("image_id", "box_no", F.round("bx", 3).alias("bx"), F.round("by", 3).alias("by"), back[0].alias("x_back"), back[1].alias("y_back"))


CLASSES = {A.PEDESTRIAN: 0, A.BICYCLE: 2}


def class_remap_counts(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = A.remapped(V.boxes(spark, sf), CLASSES)
    return kept.groupBy("recording", "cls").agg(F.count(F.lit(1)).alias("n"))


def dropped_class_topk(spark: SparkSession, sf: str) -> DataFrame:
    _, dropped = A.remapped(V.boxes(spark, sf), CLASSES)
    return dropped.orderBy(F.desc("dropped"), "category_id").limit(6)


def frame_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.frame_flags(V.boxes(spark, sf)).groupBy("recording", A.frame_kind().alias("kind")).agg(F.count(F.lit(1)).alias("frames"))


def unlabeled_person_filter(spark: SparkSession, sf: str) -> DataFrame:
    flags = A.frame_flags(V.boxes(spark, sf))
    return A.select_frames(flags, drop_unlabelled=True).groupBy("recording").agg(F.count(F.lit(1)).alias("frames"), F.count_if("has_ped").alias("positive"))


def _images(spark: SparkSession, sf: str, which: Column | None = None) -> DataFrame:
    """The manifest of images: orders, as lines may be missing for one and an order for a line."""
    key = F.col("o_orderkey")
    orders = V.table(spark, sf, "orders")
    return (orders if which is None else orders.where(which)).select(key.alias("image_id"), F.when(key % 6 == 5, "none").otherwise((34 + key % 6).cast("string")).alias("recording"))


def pair_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return A.pair_integrity(_images(spark, sf), V.boxes(spark, sf), "image_id", "recording")


def label_image_left_join(spark: SparkSession, sf: str) -> DataFrame:
    counts = A.normalised(V.boxes(spark, sf)).groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes"))
    return _images(spark, sf).join(counts, "image_id", "left").select("image_id", F.coalesce("boxes", F.lit(0)).alias("boxes"))


def dedupe_boxes(spark: SparkSession, sf: str) -> DataFrame:
    norm = A.normalised(V.boxes(spark, sf), digits=3)
    raw = norm.groupBy("image_id").agg(F.count(F.lit(1)).alias("raw"))
    return raw.join(A.deduped(norm).groupBy("image_id").agg(F.count(F.lit(1)).alias("unique")), "image_id")


def _available(spark: SparkSession, sf: str) -> DataFrame:
    """Images whose order isn't pending."""
    return _images(spark, sf, F.col("o_orderstatus") != "P")


def recording_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    A.guard_recordings(("36", "37", "none"))
    flags = A.frame_flags(V.boxes(spark, sf))
    picked = A.select_frames(flags, available=_available(spark, sf), recordings=("36", "37", "none"))
    return picked.groupBy("recording").agg(F.count(F.lit(1)).alias("frames"), F.min("image_id").alias("first"), F.max("image_id").alias("last"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    boxes = V.boxes(spark, sf)
    kept, _ = A.remapped(boxes, {A.PEDESTRIAN: 0, A.BICYCLE: 2, A.MOTORBIKE: 2})
    of = lambda *r: kept.filter(F.col("recording").isin(*r))
    return A.union_sources(("night", "train", of("36", "37")), ("night", "val", of("35")), ("street", "train", of("none")), ("stair", "test", of("34", "38")))


def source_union_summary(spark: SparkSession, sf: str) -> DataFrame:
    one = _sources(spark, sf).groupBy("split", "source").agg(F.count_distinct("image").alias("images"), F.count_if(F.col("cls") == 0).alias("persons"), F.count_if(F.col("cls") == 2).alias("others"))
    return one.withColumn("ratio", F.round(F.try_divide("persons", "others"), RATE))


def source_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _sources(spark, sf).rollup("split", "source", "cls").agg(F.count(F.lit(1)).alias("boxes"), F.grouping_id().alias("level"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select(F.col("user_id").alias("recording"), F.col("event_id").alias("number"))


def filename_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return SEL.blocks(_numbered(spark, sf), ["recording"], "number", gap=200).drop("block")


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.regexp_replace(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]+)/?$", 1), r"\.html$", "")
    prefix, number = SEL.name_number(F.concat(F.lit("IMG_"), stem))
    pages = V.table(spark, sf, "pages").select(prefix.alias("prefix"), number.alias("number"))
    return SEL.blocks(pages, ["prefix"], "number").drop("block")


def block_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = SEL.blocks(_numbered(spark, sf), ["recording"], "number", gap=200)
    return found.groupBy("recording").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.percentile("n", 0.5), 3).alias("median_size"), F.max("n").alias("largest"))


def tail_split(spark: SparkSession, sf: str) -> DataFrame:
    split = SEL.tail_split(_images(spark, sf), ["recording"], ["image_id"], 0.2)
    return split.groupBy("recording", "split").agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first"), F.max("image_id").alias("last"))


def uniform_thinning(spark: SparkSession, sf: str) -> DataFrame:
    return SEL.thinned(_images(spark, sf), ["recording"], ["image_id"], 40)


def strided_pick(spark: SparkSession, sf: str) -> DataFrame:
    return SEL.strided(_images(spark, sf), ["recording"], ["image_id"], 16)


def row_slice(spark: SparkSession, sf: str) -> DataFrame:
    return V.frames(spark, sf).filter("seq between 11 and 30").select("recording", "frame_id", "seq")


def pool_quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    frames = V.frames(spark, sf).withColumn("pool", F.col("recording") % 5)
    return SEL.pool_quota(frames, "pool", "frame_id", F.col("mean_luma") <= 60, total=60, pools=5).select("pool", "frame_id", "pick")


def positives_sample(spark: SparkSession, sf: str) -> DataFrame:
    flags = A.frame_flags(V.boxes(spark, sf))
    return SEL.positives_with_background(flags, "recording", "image_id", F.col("has_ped"), 100).select("recording", "image_id", "positive")


def _clamped(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_clamped(V.boxes(spark, sf)).filter(G.larger_than(G.cols(BOX), 1))


def box_percentiles_linear(spark: SparkSession, sf: str) -> DataFrame:
    df = _clamped(spark, sf).withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    q = lambda c: S.linear_quantiles(c, (0.01, 0.05, 0.5))
    out = df.groupBy("category_id").agg(*(f for c in "wh" for f in (F.min(c).alias(f"{c}_min"), q(c).alias(f"{c}_q"), F.max(c).alias(f"{c}_max"))))
    return out.select("category_id", *(x for c in "wh" for x in (f"{c}_min", *(F.round(F.col(f"{c}_q")[i], 3).alias(f"{c}_{n}") for i, n in enumerate(("p1", "p5", "p50"))), f"{c}_max")))


def box_quantiles_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    """Per image: groups are small, so a sorted list of one group's values is bounded."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (V.WIDTH * V.HEIGHT)
    lists = _clamped(spark, sf).groupBy("image_id").agg(F.array_sort(F.collect_list(area)).alias("a"))
    return lists.select("image_id", *(S.fixed(S.exclusive_quantile(F.col("a"), p), RATE).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)))


def edge_touch_rates(spark: SparkSession, sf: str) -> DataFrame:
    touch = G.touches(G.cols(BOX), F.col("width"), F.col("height"))
    return _clamped(spark, sf).groupBy("category_id").agg(*(F.round(S.share(c), RATE).alias(n) for n, c in touch.items()))


def small_box_rates(spark: SparkSession, sf: str) -> DataFrame:
    share = G.area(G.cols(BOX)) / (V.WIDTH * V.HEIGHT)
    return _clamped(spark, sf).groupBy("category_id").agg(
        *(F.round(S.share(share < p / 100), RATE).alias(f"under_{p}") for p in (10, 5, 1)), F.round(S.share(F.col("y2") - F.col("y1") < 32), RATE).alias("low"), F.count(F.lit(1)).alias("n"))


#: Medians of a reference corpus, and how far from them a corpus may be.
GATE = {"area": 0.02, "aspect": 0.7}


def stairs_gate(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    df = _clamped(spark, sf).withColumns({"area": w * h / (V.WIDTH * V.HEIGHT), "aspect": w / h})
    out = df.groupBy("recording").agg(*(F.percentile(c, 0.5).alias(c) for c in GATE))
    ok = [(F.col(c) >= v / 2) & (F.col(c) <= v * 2) for c, v in GATE.items()]
    return out.select("recording", *(F.round(c, RATE).alias(f"{c}_median") for c in GATE), (ok[0] & ok[1]).alias("passed"))


def area_histogram(spark: SparkSession, sf: str) -> DataFrame:
    share = G.area(G.cols(BOX)) / (V.WIDTH * V.HEIGHT)
    return _clamped(spark, sf).groupBy(F.least(F.lit(39), F.floor(share * 40)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def boxes_per_image(spark: SparkSession, sf: str) -> DataFrame:
    """The median is over boxes, each with its image's count."""
    n = _clamped(spark, sf).groupBy("recording", "image_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("recording").agg(F.min("n").alias("least"), F.floor(F.percentile("n", 0.5, F.col("n"))).cast("long").alias("median"), F.max("n").alias("most"), F.sum("n").alias("boxes"), F.count(F.lit(1)).alias("images"))


def area_summary(spark: SparkSession, sf: str) -> DataFrame:
    share = G.area(G.cols(BOX)) / (V.WIDTH * V.HEIGHT)
    return _clamped(spark, sf).withColumn("a", share).groupBy("recording").agg(
        F.round(F.percentile("a", 0.5), RATE).alias("median"), F.round(F.min("a"), RATE).alias("least"), F.round(F.max("a"), RATE).alias("most"), F.round(S.share(F.col("a") >= 0.8), RATE).alias("large"), F.round(S.share(F.col("a") < 0.05), RATE).alias("small"))


PALETTE = {1: "person", 2: "stairs"}


def outline_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles to draw: clipped to the last pixel, stroke and rim by frame size, colour by class and white for the rest."""
    df = V.boxes(spark, sf)
    inside = lambda v, top: F.greatest(F.lit(0), F.least(v, top - 1))
    corners = G.xyxy(*G.cols(["x", "y", "bw", "bh"]))
    clipped = [inside(v, F.col(top)).alias(n) for v, n, top in zip(corners, BOX, ("width", "height") * 2)]
    line, rim = G.stroke(F.col("width"), F.col("height"))
    colour = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PALETTE.items() for x in kv)), F.col("category_id")), F.lit("white"))
    drawn = df.select("image_id", "box_no", "width", "height", "category_id", *clipped).filter("x2 > x1 and y2 > y1")
    return drawn.select("image_id", "box_no", *BOX, line.alias("line"), rim.alias("rim"), colour.alias("colour"))


def crop_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A window of 256 pixels around each box's centre, moved inside the frame."""
    df = _clamped(spark, sf)
    top, left = G.crop_window(F.floor((F.col("y1") + F.col("y2")) / 2), F.floor((F.col("x1") + F.col("x2")) / 2), 256, F.col("height"), F.col("width"))
    return df.select("image_id", "box_no", top.cast("long").alias("top"), left.cast("long").alias("left"))


def luma_bands(spark: SparkSession, sf: str) -> DataFrame:
    df = V.frames(spark, sf).withColumn("band", S.luma_band(F.col("mean_luma")))
    return df.groupBy("recording", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("recording")), RATE))


THRESHOLDS = (55, 60, 62, 65, 68, 70, 75)


def luma_threshold_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """One pass: every threshold is a conditional sum."""
    one = V.frames(spark, sf).agg(*(f for t in THRESHOLDS for f in (F.count_if(F.col("mean_luma") < t).alias(f"f{t}"), F.count_if((F.col("mean_luma") < t) & F.col("detection").isNotNull()).alias(f"d{t}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"f{t}").alias("frames"), F.col(f"d{t}").alias("detections")) for t in THRESHOLDS)))
    return one.select(rows.alias("r")).select("r.*")


def pool_profile(spark: SparkSession, sf: str) -> DataFrame:
    f = V.frames(spark, sf).withColumn("pool", F.col("recording") % 5)
    return f.groupBy("pool").agg(F.round(F.avg("mean_luma"), 3).alias("mean"), F.round(F.percentile("mean_luma", 0.5), 3).alias("median"), F.round(S.share(F.col("mean_luma") < 60), RATE).alias("under_60"), F.round(S.share(F.col("mean_luma") < 40), RATE).alias("under_40"), F.count(F.lit(1)).alias("n"))


def output_health(spark: SparkSession, sf: str) -> DataFrame:
    m = F.avg("mean_luma")
    return V.frames(spark, sf).groupBy("recording").agg(F.round(m, 3).alias("mean"), F.when(m < 5, "black").when(m > 250, "white").otherwise("fine").alias("health"))


QUERIES = {f.__name__: f for f in (
    box_clamp_normalize, box_clamp_cvat_rule, segment_union_box, yolo_to_pixel, letterbox_roundtrip, class_remap_counts, dropped_class_topk, frame_kind_counts, unlabeled_person_filter,
    pair_integrity, label_image_left_join, dedupe_boxes, recording_semi_join, source_union_summary, source_rollup, filename_blocks, page_blocks, block_summary, tail_split, uniform_thinning, strided_pick,
    row_slice, pool_quota_sample, positives_sample, box_percentiles_linear, box_quantiles_exclusive, edge_touch_rates, small_box_rates, stairs_gate, area_histogram, boxes_per_image, area_summary,
    outline_geometry, crop_windows, luma_bands, luma_threshold_sensitivity, pool_profile, output_health)}



def fx(value: str, unit: float = 1e6) -> str:
    return f"floor({value} * {unit:.0f}::double + 0.5) / {unit:.0f}::double"


B = f"with {V.BOXES}"
CL = f"{B}, c as (select *, x2 - x1 as w, y2 - y1 as h, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) / 2073600 as share from v_clamped where x2 - x1 > 1 and y2 - y1 > 1)"
NORM = f"{CL}, n as (select image_id, box_no, {fx('(x1 + x2) / 2 / width')} as cx, {fx('(y1 + y2) / 2 / height')} as cy, {fx('w / width')} as w, {fx('h / height')} as h from c)"
IMAGES = "i as (select o_orderkey as image_id, case when o_orderkey % 6 = 5 then 'none' else cast(34 + o_orderkey % 6 as varchar) end as recording from orders)"
SRC = f"""{B}, k as (select image_id, recording, case category_id when 1 then 0 else 2 end as cls from v_boxes where category_id in (1, 2, 3)),
s as (select case when recording in ('35', '36', '37') then 'night' when recording = 'none' then 'street' else 'stair' end as source,
    case when recording in ('36', '37', 'none') then 'train' when recording = '35' then 'val' else 'test' end as split, image_id, cls from k)"""
EV = "e as (select user_id as recording, event_id as number from events)"
BL = """b as (select *, sum(fresh) over (partition by recording order by number rows unbounded preceding) as block from (
    select *, case when number - lag(number) over (partition by recording order by number) <= 200 then 0 else 1 end as fresh from e)),
g as (select recording, block, min(number) as first, max(number) as last, count(*) as n from b group by 1, 2)"""
F_ = f"with {V.FRAMES}"

ORACLES = {
    "box_clamp_normalize": f"{NORM} select * from n",
    "box_clamp_cvat_rule": f"{B}, k as (select *, x2 - x1 > 0 and y2 - y1 > 0 as kept from v_clamped) select category_id, count(*) filter (kept) as kept, count(*) filter (not kept) as dropped, sum((x2 - x1) * (y2 - y1)) filter (kept) as area from k group by 1",
    "segment_union_box": f"{B}, u as (select image_id, min(least(x, x + bw)) as x1, min(least(y, y + bh)) - 10.8 as y1, max(greatest(x, x + bw)) as x2, max(greatest(y, y + bh)) + 10.8 as y2 from v_boxes group by 1) select image_id, round(greatest(0, least(x1, 1920)), 3) as x1, round(greatest(0, least(y1, 1080)), 3) as y1, round(greatest(0, least(x2, 1920)), 3) as x2, round(greatest(0, least(y2, 1080)), 3) as y2 from u",
    "yolo_to_pixel": f"{NORM} select image_id, box_no, cast(trunc((cx - w / 2) * 1920) as int) as x1, cast(trunc((cy - h / 2) * 1080) as int) as y1, cast(trunc((cx + w / 2) * 1920) as int) as x2, cast(trunc((cy + h / 2) * 1080) as int) as y2 from n",
    "letterbox_roundtrip": f"{CL}, t as (select *, least(640 / height, 640 / width) as s from c), l as (select *, x1 * s + floor((640 - round_even(width * s, 0)) / 2) as bx, y1 * s + floor((640 - round_even(height * s, 0)) / 2) as by_ from t) select image_id, box_no, round(bx, 3) as bx, round(by_, 3) as by, round((bx - floor((640 - round_even(width * s, 0)) / 2)) / s, 3) as x_back, round((by_ - floor((640 - round_even(height * s, 0)) / 2)) / s, 3) as y_back from l",
    "class_remap_counts": f"{B} select recording, case category_id when 1 then 0 else 2 end as cls, count(*) as n from v_boxes where category_id in (1, 2) group by 1, 2",
    "dropped_class_topk": f"{B} select category_id, count(*) as dropped from v_boxes where category_id not in (1, 2) group by 1 order by 2 desc, 1 limit 6",
    "frame_kind_counts": f"{B} select recording, case when has_ped then 'pedestrian' when has_ignore then 'ignore_only' when has_rider then 'rider_only' else 'background' end as kind, count(*) as frames from v_kinds group by 1, 2",
    "unlabeled_person_filter": f"{B} select recording, count(*) as frames, count(*) filter (has_ped) as positive from v_kinds where has_ped or not (has_ignore or has_rider) group by 1",
    "pair_integrity": f"""{B}, {IMAGES}, a as (select distinct recording, image_id from i), b as (select distinct recording, image_id from v_boxes),
        j as (select coalesce(a.recording, b.recording) as recording, coalesce(a.image_id, b.image_id) as image_id, case when b.image_id is null then 'left' when a.image_id is null then 'right' else 'both' end as side
            from a full join b on a.recording = b.recording and a.image_id = b.image_id),
        r as (select *, row_number() over (partition by recording, side order by image_id) as rn from j)
        select recording, count(*) filter (side = 'both') as paired, count(*) filter (side = 'left') as left_only, count(*) filter (side = 'right') as right_only,
            coalesce(string_agg(image_id::varchar, ',' order by image_id) filter (side = 'left' and rn <= 5), '') as first_left, coalesce(string_agg(image_id::varchar, ',' order by image_id) filter (side = 'right' and rn <= 5), '') as first_right,
            count(*) filter (side <> 'both') = 0 and count(*) filter (side = 'both') > 0 as ok from r group by 1""",
    "label_image_left_join": f"{NORM}, {IMAGES}, k as (select image_id, count(*) as boxes from n group by 1) select i.image_id, coalesce(boxes, 0) as boxes from i left join k using (image_id)",
    "dedupe_boxes": f"{CL}, m as (select image_id, {fx('(x1 + x2) / 2 / width', 1e3)} as cx, {fx('(y1 + y2) / 2 / height', 1e3)} as cy, {fx('w / width', 1e3)} as w, {fx('h / height', 1e3)} as h from c) select image_id, count(*) as raw, count(distinct (cx, cy, w, h)) as unique from m group by 1",
    "recording_semi_join": f"{B} select recording, count(*) as frames, min(image_id) as first, max(image_id) as last from v_kinds where recording in ('36', '37', 'none') and image_id in (select o_orderkey from orders where o_orderstatus <> 'P') group by 1",
    "source_union_summary": f"{SRC} select split, source, count(distinct image_id) as images, count(*) filter (cls = 0) as persons, count(*) filter (cls = 2) as others, round(count(*) filter (cls = 0) / nullif(count(*) filter (cls = 2), 0), 5) as ratio from s group by 1, 2",
    "source_rollup": f"{SRC} select split, source, cls, count(*) as boxes, grouping_id(split, source, cls) as level from s group by rollup (split, source, cls)",
    "filename_blocks": f"with {EV}, {BL} select recording, first, last, n from g",
    "page_blocks": r"""with e as (select 'IMG_' || regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/?$', 1), '\.html$', '') as stem from pages),
        p as (select regexp_replace(stem, '\d+$', '') as prefix, case when regexp_extract(stem, '(\d+)$', 1) = '' then -1 else cast(regexp_extract(stem, '(\d+)$', 1) as bigint) end as number from e),
        b as (select *, sum(fresh) over (partition by prefix order by number rows unbounded preceding) as block from (select *, case when number >= 0 and number - lag(number) over (partition by prefix order by number) <= 30 then 0 else 1 end as fresh from p))
        select prefix, min(number) as first, max(number) as last, count(*) as n from b group by prefix, block""",
    "block_summary": f"with {EV}, {BL} select recording, count(*) as blocks, round(quantile_cont(n, 0.5), 3) as median_size, max(n) as largest from g group by 1",
    "tail_split": f"with {IMAGES}, r as (select *, case when row_number() over (partition by recording order by image_id) > count(*) over (partition by recording) - floor(count(*) over (partition by recording) * 0.2) then 'val' else 'train' end as split from i) select recording, split, count(*) as n, min(image_id) as first, max(image_id) as last from r group by 1, 2",
    "uniform_thinning": f"with {IMAGES}, r as (select *, row_number() over (partition by recording order by image_id) - 1 as rk, count(*) over (partition by recording) as n from i), t as (select unnest(range(40)) as k) select distinct image_id, recording from r left join t on rk = floor(k * n / 40) where n <= 40 or k is not null",
    "strided_pick": f"with {IMAGES}, r as (select *, row_number() over (partition by recording order by image_id) - 1 as rk, greatest(1, floor(count(*) over (partition by recording) / 16)) as step from i) select image_id, recording from r where rk % step = 0 and rk / step < 16",
    "row_slice": f"{F_} select recording, frame_id, seq from v_frames where seq between 11 and 30",
    "pool_quota_sample": f"{F_}, r as (select *, recording % 5 as pool, row_number() over (partition by recording % 5 order by md5('0:' || (recording % 5) || ':' || frame_id)) as rk from v_frames), p as (select *, row_number() over (partition by pool order by rk) as pick from r where rk <= 600 and mean_luma <= 60) select pool, frame_id, pick from p where pick <= 12",
    "positives_sample": f"""{B}, r as (select recording, image_id, has_ped as positive, md5('0:' || recording || ':' || image_id) as d from v_kinds),
        s as (select *, sum(positive::int) over (partition by recording order by d rows unbounded preceding) as seen from r),
        k as (select *, row_number() over (partition by recording, positive order by d) as nth from s where (positive and seen <= 100) or (not positive and seen < 100)),
        t as (select *, sum(positive::int) over (partition by recording) as total from k) select recording, image_id, positive from t where positive or nth <= floor(total * 0.1)""",
    "box_percentiles_linear": f"{CL} select category_id, {', '.join(f'min({c}) as {c}_min, round(quantile_cont({c}, 0.01), 3) as {c}_p1, round(quantile_cont({c}, 0.05), 3) as {c}_p5, round(quantile_cont({c}, 0.5), 3) as {c}_p50, max({c}) as {c}_max' for c in 'wh')} from c group by 1",
    "box_quantiles_exclusive": f"{CL}, l as (select image_id, list(w * h / 2073600 order by w * h) as a, count(*) as n from c group by 1) select image_id, " + ", ".join(f"case when n > 2 then floor((a[greatest(1, least(floor({p} * (n + 1)), n - 1))::int] + (a[greatest(1, least(floor({p} * (n + 1)), n - 1))::int + 1] - a[greatest(1, least(floor({p} * (n + 1)), n - 1))::int]) * ({p} * (n + 1) - greatest(1, least(floor({p} * (n + 1)), n - 1)))) * 100000.0::double + 0.5) / 100000.0::double end as p{round(100 * p)}" for p in (0.25, 0.5, 0.75)) + " from l",
    "edge_touch_rates": f"{CL}, t as (select category_id, x1 <= 2 as l, y1 <= 2 as t, x2 >= width - 2 as r, y2 >= height - 2 as b from c) select category_id, round(avg(l::int), 5) as \"left\", round(avg(r::int), 5) as \"right\", round(avg(t::int), 5) as top, round(avg(b::int), 5) as bottom, round(avg((l or r or t or b)::int), 5) as \"any\", round(avg((l and r)::int), 5) as left_right, round(avg((t and b)::int), 5) as top_bottom from t group by 1",
    "small_box_rates": f"{CL} select category_id, round(avg((share < 0.1)::int), 5) as under_10, round(avg((share < 0.05)::int), 5) as under_5, round(avg((share < 0.01)::int), 5) as under_1, round(avg((h < 32)::int), 5) as low, count(*) as n from c group by 1",
    "stairs_gate": f"{CL}, g as (select recording, quantile_cont(w * h / 2073600, 0.5) as area, quantile_cont(w / h, 0.5) as aspect from c group by 1) select recording, round(area, 5) as area_median, round(aspect, 5) as aspect_median, area >= 0.01 and area <= 0.04 and aspect >= 0.35 and aspect <= 1.4 as passed from g",
    "area_histogram": f"{CL} select cast(least(39, floor(share * 40)) as bigint) as bin, count(*) as n from c group by 1",
    "boxes_per_image": f"{CL}, k as (select recording, count(*) over (partition by image_id) as n, image_id from c) select recording, min(n) as least, cast(floor(quantile_cont(n, 0.5)) as bigint) as median, max(n) as most, count(*) as boxes, count(distinct image_id) as images from k group by 1",
    "area_summary": f"{CL} select recording, round(quantile_cont(share, 0.5), 5) as median, round(min(share), 5) as least, round(max(share), 5) as most, round(avg((share >= 0.8)::int), 5) as large, round(avg((share < 0.05)::int), 5) as small from c group by 1",
    "outline_geometry": f"{B}, k as (select image_id, box_no, category_id, greatest(0, least(x, 1919)) as x1, greatest(0, least(y, 1079)) as y1, greatest(0, least(x + bw, 1919)) as x2, greatest(0, least(y + bh, 1079)) as y2 from v_boxes) select image_id, box_no, x1, y1, x2, y2, 6 as line, 3 as rim, case category_id when 1 then 'person' when 2 then 'stairs' else 'white' end as colour from k where x2 > x1 and y2 > y1",
    "crop_windows": f"{CL} select image_id, box_no, cast(greatest(0, least(floor((y1 + y2) / 2) - 128, 1080 - 256)) as bigint) as top, cast(greatest(0, least(floor((x1 + x2) / 2) - 128, 1920 - 256)) as bigint) as \"left\" from c",
    "luma_bands": f"{F_}, b as (select recording, case when mean_luma >= 90 then 'day' when mean_luma < 40 then 'low_light' else 'dusk' end as band, count(*) as n from v_frames group by 1, 2) select *, round(n / sum(n) over (partition by recording), 5) as share from b",
    "luma_threshold_sensitivity": f"{F_}, t as (select unnest([55, 60, 62, 65, 68, 70, 75]) as threshold) select threshold, count(*) filter (mean_luma < threshold) as frames, count(*) filter (mean_luma < threshold and detection is not null) as detections from v_frames, t group by 1",
    "pool_profile": f"{F_} select recording % 5 as pool, round(avg(mean_luma), 3) as mean, round(quantile_cont(mean_luma, 0.5), 3) as median, round(avg((mean_luma < 60)::int), 5) as under_60, round(avg((mean_luma < 40)::int), 5) as under_40, count(*) as n from v_frames group by 1",
    "output_health": f"{F_} select recording, round(avg(mean_luma), 3) as mean, case when avg(mean_luma) < 5 then 'black' when avg(mean_luma) > 250 then 'white' else 'fine' end as health from v_frames group by 1",
}
