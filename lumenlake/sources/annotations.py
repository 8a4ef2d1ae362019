"""Readers of annotation formats into one box schema, and of image files, predictions and result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp")
COCO = """images array<struct<id:bigint,file_name:string,width:int,height:int,recordings_id:double>>,
    annotations array<struct<image_id:bigint,category_id:int,bbox:array<double>,ignore:string>>"""
_SHAPE = "struct<_label:string,_points:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:array<string>>"
CVAT = f"_name string, _width int, _height int, box array<{_SHAPE}>, polygon array<{_SHAPE}>, polyline array<{_SHAPE}>"
# Labels that tell what an XML file annotates, boxes or surfaces; those of surfaces win.
BOX_MARKERS = ("bollard", "tree_trunk", "traffic_sign", "pole", "car")
SURFACE_MARKERS = ("sidewalk", "roadway", "caution_zone", "braille_guide_blocks", "bike_lane", "alley")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length of all images below root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES))


def stem(path: Column) -> Column:
    """The file name without its extension, and without an image extension before that."""
    once = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(once, rf"(?i)\.({'|'.join(IMAGE_SUFFIXES)})$", "")


def first_by_name(files: DataFrame) -> DataFrame:
    """One path of each file name, the first in order."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("name", name).withColumn("__rn", F.row_number().over(W.partitionBy("name").orderBy("path"))).filter("__rn = 1").drop("__rn")


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """path, length and SHA-256 of each file below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.sha2("content", 256).alias("sha256"))


def coco(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, boxes) of a COCO-style document, or of many, one a line; a recording without a number is `none`."""
    doc = spark.read.schema(COCO).json(path, multiLine=not lines)
    images = doc.select(F.explode("images").alias("i")).select(
        F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height", F.coalesce(F.col("i.recordings_id").cast("long").cast("string"), F.lit("none")).alias("recording"))
    a = doc.select(F.posexplode("annotations").alias("box_no", "a"))
    flag = F.coalesce(F.lower("a.ignore").isin("1", "true", "1.0"), F.lit(False))
    boxes = a.select(F.col("a.image_id").alias("image_id"), "box_no", F.col("a.category_id").alias("category_id"), flag.alias("ignore_flag"), *(F.col("a.bbox")[i].alias(n) for i, n in enumerate(("x", "y", "bw", "bh"))))
    return images, boxes.join(images.drop("file_name"), "image_id")


def _cvat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "image").schema(CVAT).load(path)


def cvat_boxes(spark: SparkSession, path: str, mapping: Mapping[str, int], min_width: float = 0) -> tuple[DataFrame, DataFrame]:
    """(boxes, counts of dropped ones) of CVAT XML. An image without a kept box has one row whose cls is null.

    Corners are clamped to the frame, empty boxes and those narrower than min_width pixels go.
    Counts are by label: dropped for want of a class, small for their size. Images are told
    apart by file and name.
    """
    table = F.create_map(*(F.lit(v) for kv in mapping.items() for v in kv))
    raw = _cvat(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_name").alias("name"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.explode_outer("box").alias("b"))
    b = raw.select("file", "name", "width", "height", F.col("b._label").alias("label"), F.element_at(table, F.col("b._label")).alias("cls"), *(F.col(f"b._{c}").alias(c) for c in ("xtl", "ytl", "xbr", "ybr")))
    inside = lambda c, top: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(top)))
    c = b.withColumns({"x1": inside("xtl", "width"), "y1": inside("ytl", "height"), "x2": inside("xbr", "width"), "y2": inside("ybr", "height")}).drop("xtl", "ytl", "xbr", "ybr")
    ok = F.col("cls").isNotNull() & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (F.col("x2") - F.col("x1") >= min_width)
    kept = c.filter(ok)
    images = c.select("file", "name", "width", "height").distinct()
    counts = c.filter(F.col("label").isNotNull() & ~F.coalesce(ok, F.lit(False))).groupBy("label").agg(F.count_if(F.col("cls").isNull()).alias("dropped"), F.count_if(F.col("cls").isNotNull()).alias("small"))
    return images.join(kept.drop("width", "height"), ["file", "name"], "left"), counts


def surface_boxes(spark: SparkSession, path: str, wanted: str = "stair") -> DataFrame:
    """Boxes around shapes whose label or an attribute names wanted; polygons need three points. Images without one have no row."""
    img = _cvat(spark, path)
    none = F.array().cast(f"array<{_SHAPE}>")
    shapes = img.select(F.col("_name").alias("name"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.explode(F.concat(*(F.coalesce(c, none) for c in ("box", "polygon", "polyline")))).alias("s"))
    names = F.lower(F.coalesce("s._label", F.lit(""))).contains(wanted) | F.coalesce(F.exists("s.attribute", lambda a: F.lower(a).contains(wanted)), F.lit(False))
    at = lambda i: F.transform(F.split("s._points", ";"), lambda p: F.split(p, ",")[i].cast("double"))
    n = F.size(F.split("s._points", ";"))
    corner = lambda c, f, i: F.when(F.col("s._points").isNull(), F.col(f"s._{c}")).otherwise(f(at(i)))
    hit = shapes.filter(names & (F.col("s._points").isNull() | (n >= 3)))
    return hit.select("name", "width", "height", corner("xtl", F.array_min, 0).alias("x1"), corner("ytl", F.array_min, 1).alias("y1"), corner("xbr", F.array_max, 0).alias("x2"), corner("ybr", F.array_max, 1).alias("y2"))


def xml_tasks(spark: SparkSession, path: str) -> DataFrame:
    """file and task of each XML file: surface, bbox or unknown by the labels of all its shapes."""
    img = _cvat(spark, path).select(F.col("_metadata.file_path").alias("file"), F.explode(F.concat(*(F.coalesce(F.col(c)["_label"], F.array().cast("array<string>")) for c in ("box", "polygon", "polyline")))).alias("label"))
    low = F.lower("label")
    flags = img.groupBy("file").agg(F.bool_or(low.isin(*SURFACE_MARKERS)).alias("s"), F.bool_or(low.isin(*BOX_MARKERS)).alias("b"))
    return flags.select("file", F.when(F.col("s"), "surface").when(F.col("b"), "bbox").otherwise("unknown").alias("task"))


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split(F.trim("value"), r"\s+").alias("t"))
    return t.filter(F.size("t") >= 5).select(stem(F.col("file")).alias("image"), F.try_element_at("t", F.lit(1)).cast("double").cast("int").alias("cls"), "t")


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """split, image, cls, cx, cy, w, h of label texts in JSON lines, as sinks.write_labels() puts them down; cls and box are null for background."""
    raw = spark.read.schema("split string, image string, text string").json(path)
    lines = raw.select("split", "image", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    t = F.split(F.trim("line"), r"\s+")
    full = F.size(t) >= 5
    value = lambda i: F.when(full, F.get(t, F.lit(i)).cast("double"))
    return lines.select("split", "image", value(0).cast("int").alias("cls"), *(value(i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)))


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """image, cls, cx, cy, w, h of label files; lines of fewer than five tokens are none. Empty files have no row: join from the images."""
    return _tokens(spark, path).select("image", "cls", *(F.col("t")[i].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)))


def segment_labels(spark: SparkSession, path: str) -> DataFrame:
    """image, cls, x1, y1, x2, y2 (whole pixels) of segment files."""
    return _tokens(spark, path).select("image", "cls", *(F.col("t")[i].cast("double").cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"), 1)))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """A detector's output as CSV: image_id, cls, conf, x1, y1, x2, y2."""
    return spark.read.csv(path, header=True, schema="image_id string, cls int, conf double, x1 double, y1 double, x2 double, y2 double")


def error_summaries(spark: SparkSession, *paths: str) -> DataFrame:
    """Error counts of runs in long form, from any number of files."""
    return spark.read.csv(list(paths), header=True, schema="run string, imgsz int, kind string, class string, reason string, width_bin string, count int")


def sequence(images: DataFrame, recording: str, start: int, n: int) -> DataFrame:
    """n frames of a recording from start, in order of file name."""
    ranked = images.filter(F.col("recording") == recording).withColumn("seq", F.row_number().over(W.partitionBy("recording").orderBy("file_name")) - 1)
    return ranked.filter(F.col("seq").between(start, start + n - 1))


def pairs(low: DataFrame, high: DataFrame, n: int) -> DataFrame:
    """The first n file names that both sides have with equal width and height."""
    return low.join(high.withColumnsRenamed({"path": "high_path"}), ["name", "width", "height"]).orderBy("name").limit(n)
