"""Queries on joins, unions, reports and sizes of data sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import geometry as G
from lumenlake.operators import annotations as A
from lumenlake.plans import detection_queries as D
from lumenlake.plans import views as V
from lumenlake.sources.annotations import stem


def _images(spark: SparkSession, sf: str) -> DataFrame:
    """Images with their size and recording, whether they have a label or not."""
    key = F.col("o_orderkey")
    kind = F.when(key % 6 == 5, "none").otherwise((34 + key % 6).cast("string"))
    return V.table(spark, sf, "orders").select(key.alias("image_id"), kind.alias("recording"), F.lit(V.WIDTH).alias("width"), F.lit(V.HEIGHT).alias("height"), F.col("o_orderstatus").alias("status"))


def variant_join(spark: SparkSession, sf: str) -> DataFrame:
    """Images in two exposures with the labels of the brighter one: an inner join across variants."""
    images = _images(spark, sf).withColumn("exposure", F.explode(F.array(F.lit("low"), F.lit("high"))))
    labels = V.boxes(spark, sf).groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes")).withColumn("labelled_on", F.lit("high"))
    return images.join(labels, "image_id").groupBy("recording", "exposure", "labelled_on").agg(F.count(F.lit(1)).alias("images"), F.sum("boxes").alias("boxes"))


def record_image_join(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation records to image files by the stem of their paths; records without a file go."""
    path = lambda folder, end: F.concat(F.lit(folder), F.col("recording"), F.lit("/img_"), F.col("image_id").cast("string"), F.lit(end))
    records = V.boxes(spark, sf).select("image_id", "recording").distinct().select(path("ann/", ".png.xml").alias("record"), "recording")
    files = _images(spark, sf).filter("status <> 'P'").select(path("img/", ".png").alias("file"))
    joined = records.withColumn("stem", stem(F.col("record"))).join(files.withColumn("stem", stem(F.col("file"))), "stem", "left").na.drop(subset=["file"])
    return joined.groupBy("recording").agg(F.count(F.lit(1)).alias("records"), F.min("file").alias("first"))


def obstacle_surface_union(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of obstacles and of surfaces by image: an image of either side is there, with the boxes of both."""
    boxes = V.boxes(spark, sf)
    obstacle = boxes.filter(F.col("category_id").isin(1, 2)).select("image_id", F.col("category_id").alias("cls"), F.lit("obstacle").alias("task"))
    surface = boxes.filter(F.col("category_id").isin(3, 4)).select("image_id", F.col("category_id").alias("cls"), F.lit("surface").alias("task"))
    both = obstacle.unionByName(surface)
    return both.groupBy("image_id").agg(
        F.count_if(F.col("task") == "obstacle").alias("obstacles"), F.count_if(F.col("task") == "surface").alias("surfaces"), F.array_join(F.array_sort(F.collect_list("cls")).cast("array<string>"), ",").alias("classes"))


def metrics_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Exported models with the metrics of their run; one that was never evaluated has none."""
    runs = _images(spark, sf).select(F.concat(F.lit("run"), (F.col("image_id") % 9).cast("string")).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("images"))
    known = D.benchmark_pivot(spark, sf).select("run", F.round((F.col("c1_hit") + F.col("c2_hit")) / sum(F.col(k) for k in D.KINDS), 4).alias("hit_rate"))
    return runs.join(known, "run", "left")


def selection_union(spark: SparkSession, sf: str) -> DataFrame:
    """Images with a usable pedestrian, and all of two recordings, each once."""
    labelled = A.frame_flags(V.boxes(spark, sf)).filter("has_ped").select("image_id")
    whole = _images(spark, sf).filter(F.col("recording").isin("36", "37")).select("image_id")
    return labelled.union(whole).distinct()


def top_false_alarms(spark: SparkSession, sf: str) -> DataFrame:
    """The eight most confident predictions of each class on images without a usable pedestrian."""
    clean = A.frame_flags(V.boxes(spark, sf)).filter("not has_ped").select("image_id")
    fired = V.preds(spark, sf).join(clean, "image_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("cls").orderBy(F.desc("conf"), "image_id", "x1", "y1", "x2", "y2"))
    return fired.withColumn("rank", rank).filter("rank <= 8").select("cls", "rank", "image_id", F.round("conf", 3).alias("conf"))


def size_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of all files of a host, and what as many pictures of 80 KiB would take."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    one = V.table(spark, sf, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("html")).alias("bytes"))
    return one.withColumn("estimated_gib", F.round(F.col("files") * 80 / 2**20, 6))


def night_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Two rules that tell night by a name: it has the word anywhere in any case, or between underscores."""
    hour = F.hour("ts")
    part = F.when(hour < 6, "_night_").when(hour < 8, "-Night-").when(hour < 20, "_day_").otherwise("_midNIGHT_")
    names = V.frames(spark, sf).select("recording", F.concat(F.lit("img"), part, F.col("frame_id").cast("string")).alias("name"))
    return names.groupBy("recording").agg(F.count_if(F.lower("name").contains("night")).alias("anywhere"), F.count_if(F.col("name").contains("_night_")).alias("between"), F.count(F.lit(1)).alias("frames"))


def fitted_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Box sizes fitted to 200 pixels of width: never enlarged, the height cut to whole pixels."""
    boxes = A.with_clamped(V.boxes(spark, sf)).filter(G.larger_than(G.cols(["x1", "y1", "x2", "y2"]), 1)).withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    width, height = G.fitted(F.col("w"), F.col("h"), 200)
    return boxes.select("image_id", "box_no", width.cast("int").alias("w"), height.cast("int").alias("h"))


def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    """Images with and without a label by recording, and all together; a row is right when none lacks its label."""
    labelled = V.boxes(spark, sf).select("image_id").distinct().withColumn("label", F.lit(1))
    rows = _images(spark, sf).join(labelled, "image_id", "left")
    one = rows.rollup("recording").agg(F.count(F.lit(1)).alias("images"), F.count("label").alias("labelled"), F.grouping("recording").alias("total"))
    return one.select(F.when(F.col("total") == 1, "all").otherwise(F.col("recording")).alias("recording"), "images", "labelled", (F.col("images") == F.col("labelled")).alias("ok"))


def persons_only(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of one source class alone, renumbered to 0, in normal form."""
    return A.normalised(V.boxes(spark, sf).filter(F.col("category_id") == A.PEDESTRIAN)).withColumn("cls", F.lit(0))


QUERIES = {f.__name__: f for f in (
    variant_join, record_image_join, obstacle_surface_union, metrics_registry, selection_union, top_false_alarms, size_estimates, night_rules, fitted_sizes, integrity_report, persons_only)}

B = f"with {V.BOXES}"
I = "i as (select o_orderkey as image_id, case when o_orderkey % 6 = 5 then 'none' else cast(34 + o_orderkey % 6 as varchar) end as recording, o_orderstatus as status from orders)"  # noqa: E741

ORACLES = {
    "variant_join": f"{B}, {I}, l as (select image_id, count(*) as boxes from v_boxes group by 1) select recording, exposure, 'high' as labelled_on, count(*) as images, sum(boxes)::bigint as boxes from i join l using (image_id), (values ('low'), ('high')) e(exposure) group by 1, 2",
    "record_image_join": f"{B}, {I}, r as (select distinct image_id, recording from v_boxes) select r.recording, count(*) as records, min('img/' || i.recording || '/img_' || i.image_id || '.png') as first from r join i using (image_id) where status <> 'P' group by 1",
    "obstacle_surface_union": f"{B} select image_id, count(*) filter (category_id in (1, 2)) as obstacles, count(*) filter (category_id in (3, 4)) as surfaces, string_agg(category_id::varchar, ',' order by category_id) as classes from v_boxes group by 1",
    "metrics_registry": f"{D.PIV}, n as (select 'run' || (o_orderkey % 9) as run, count(*) as images from orders group by 1) select n.run, images, hit_rate from n left join h using (run)",
    "selection_union": f"{B}, {I} select image_id from v_kinds where has_ped union select image_id from i where recording in ('36', '37')",
    "top_false_alarms": f"{B}, {V.PREDS}, p as (select cls, image_id, conf, row_number() over (partition by cls order by conf desc, image_id, x1, y1, x1 + bw, y1 + bh) as rank from v_preds where image_id in (select image_id from v_kinds where not has_ped)) select cls, rank, image_id, round(conf, 3) as conf from p where rank <= 8",
    "size_estimates": "select regexp_extract(url, '^https?://([^/?#:]+)', 1) as host, count(*) as files, sum(octet_length(encode(html)))::bigint as bytes, round(count(*) * 80 / 1048576, 6) as estimated_gib from pages group by 1",
    "night_rules": "with n as (select user_id as recording, case when hour(ts) < 6 then '_night_' when hour(ts) < 8 then '-Night-' when hour(ts) < 20 then '_day_' else '_midNIGHT_' end as part from events) select recording, count(*) filter (part <> '_day_') as anywhere, count(*) filter (part = '_night_') as between, count(*) as frames from n group by 1",
    "fitted_sizes": f"{B}, c as (select image_id, box_no, x2 - x1 as w, y2 - y1 as h from v_clamped where x2 - x1 > 1 and y2 - y1 > 1) select image_id, box_no, case when w > 200 then 200 else floor(w)::int end as w, case when w > 200 then floor(h * (200.0::double / w))::int else floor(h)::int end as h from c",
    "integrity_report": f"{B}, {I}, r as (select i.recording, l.image_id from i left join (select distinct image_id from v_boxes) l using (image_id)) select case when grouping(recording) = 1 then 'all' else recording end as recording, count(*) as images, count(image_id) as labelled, count(*) = count(image_id) as ok from r group by rollup (recording)",
    "persons_only": f"""{B}, c as (select *, x2 - x1 as w, y2 - y1 as h from v_clamped where x2 - x1 > 1 and y2 - y1 > 1 and category_id = 1)
        select image_id, box_no, floor((x1 + x2) / 2 / width * 1e6::double + 0.5) / 1e6::double as cx, floor((y1 + y2) / 2 / height * 1e6::double + 0.5) / 1e6::double as cy, floor(w / width * 1e6::double + 0.5) / 1e6::double as w, floor(h / height * 1e6::double + 0.5) / 1e6::double as h, 0 as cls from c""",
}
