"""Writers: boxes as partitioned tables, label texts, nested statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_texts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image, split, text: a line per box with six decimals; an image without boxes keeps an empty text."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h")
    texts = boxes.groupBy("image").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return images.select("image", "split").join(texts, "image", "left").na.fill("", ["text"])


def write_boxes(boxes: DataFrame, path: str) -> None:
    boxes.write.partitionBy("split").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Label texts as JSON lines of image and text, a folder for each split: as many files as tasks, not as images."""
    labels.select("split", "image", "text").write.partitionBy("split").json(path)


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be made: rows of wanted whose key is not done."""
    return wanted.join(done.select(key), key, "left_anti")


def nested_stats(counts: DataFrame, group: str, *metrics: str) -> DataFrame:
    """One JSON document of a group's metrics each: group, stats."""
    return counts.groupBy(group).agg(F.to_json(F.first(F.struct(*metrics))).alias("stats"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
