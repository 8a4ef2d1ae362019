"""Packed training sets, target sizes, decoded heads, label tables and the folders that operators leave."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lumenlake.functions import geometry as G
from lumenlake.operators import detection as D
from lumenlake.operators import packaging as PK
from lumenlake.operators import selection as SEL
from lumenlake.plans import detection_queries
from lumenlake.sources import annotations as SRC
from lumenlake.sources import shared, sinks


@pytest.mark.parametrize("size,want", [((1920, 1080), (640, 360)), ((1080, 1920), (360, 640)), ((640, 640), (640, 640)), ((300, 20), (300, 20)), ((6400, 3), (640, 1)), ((1281, 2), (640, 1)), ((1280, 721), (640, 360))])
def test_longest_side(spark, size, want):
    w, h = G.longest_side(F.lit(size[0]), F.lit(size[1]), 640)
    assert tuple(spark.range(1).select(w, h).first()) == want


def packed(spark, n, **options):
    images = spark.createDataFrame([(i, i) for i in range(n)], "image long, number long")
    boxes = spark.createDataFrame([(i, c, 0.5, 0.25, 0.1, 0.2) for i in range(0, n, 2) for c in (2, 0)], "image long, cls int, cx double, cy double, w double, h double")
    files = spark.createDataFrame([(i, 1920, 1080, i % 5 != 1) for i in range(n) if i % 7], "image long, width int, height int, made boolean")
    return PK.emitted(images, boxes, files, "number", "set", **options)


def test_emitted_splits_first_and_drops_failures_then(spark, monkeypatch):
    monkeypatch.setattr(SEL, "SPAN", 5)
    rows = {r.image: r for r in packed(spark, 20).collect()}
    assert set(rows) == {i for i in range(20) if i % 7 and i % 5 != 1}
    assert {i for i, r in rows.items() if r.split == "val"} == {i for i in rows if i >= 16}
    assert rows[2].text == "0 0.500000 0.250000 0.100000 0.200000\n2 0.500000 0.250000 0.100000 0.200000" and rows[3].text == "" and rows[3].boxes == 0
    assert (rows[2].stem, rows[2].width, rows[2].height) == ("set_2", 640, 360)
    assert {(r.split, r.images, r.boxes) for r in PK.emit_summary(packed(spark, 20)).collect()} == {(s, sum(r.split == s for r in rows.values()), sum(r.boxes for r in rows.values() if r.split == s)) for s in ("train", "val")}


def test_emitted_thins_evenly(spark):
    kept = sorted(r.image for r in packed(spark, 40, most=8, ratio=0.25).collect())
    assert kept == [i for i in range(0, 40, 5) if i % 7 and i % 5 != 1]
    assert packed(spark, 40, most=8).where("split = 'val'").count() == sum(1 for i in (35,) if i % 7)
    assert packed(spark, 0).count() == 0


def test_decoded_boxes(spark):
    raw = [[50.0, 40.0, 20.0, 10.0, 0.1, 0.6, 0.6], [0.0, 0.0, 2.0, 2.0, 0.2, 0.1, 0.0]]
    got = D.decoded_boxes(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "anchor int, raw array<double>"), 3).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0.6, 40.0, 35.0, 60.0, 45.0)]


def test_missed_boxes_from_pairs_at_hand(spark):
    box = "x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(1, k, 1, 100.0 * k, 0.0, 100.0 * k + 10, 10.0) for k in range(4)], f"image_id int, gt int, cls int, {box}")
    preds = spark.createDataFrame([(1, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 0.9, 105.0, 0.0, 115.0, 10.0), (1, 2, 1, 0.1, 200.0, 0.0, 210.0, 10.0)], f"image_id int, pred int, cls int, conf double, {box}")
    pairs = D.overlaps(truth, preds, 1e-9)
    matches = D.greedy_matches(pairs.where(F.col("iou") >= D.MATCH))
    reasons = lambda **o: sorted((r.gt, r.reason) for r in D.missed(truth, preds, matches, **o).collect())
    assert reasons() == reasons(pairs=pairs) == [(1, "nearmiss"), (2, "lowconf"), (3, "blind")]


def test_a_repeated_baseline_adds_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "run string, m double")
    assert sorted(map(tuple, D.with_baseline(df, "run", "a", ["m"]).collect())) == [("a", 1.0, -1.0), ("a", 2.0, 0.0), ("b", 5.0, 3.0)]
    assert {r.d_m for r in D.with_baseline(df, "run", "none", ["m"]).collect()} == {None}


def test_labels_come_back(spark, tmp_path):
    images = spark.createDataFrame([("a", "train"), ("b", "val")], "image string, split string")
    boxes = spark.createDataFrame([("a", 0, 0.1, 0.2, 0.3, 0.4), ("a", 2, 0.5, 0.5, 0.25, 0.125)], "image string, cls int, cx double, cy double, w double, h double")
    sinks.write_labels(sinks.label_texts(images, boxes), str(tmp_path / "labels"))
    got = sorted(map(tuple, SRC.label_table(spark, str(tmp_path / "labels")).collect()), key=str)
    assert got == [("train", "a", 0, 0.1, 0.2, 0.3, 0.4), ("train", "a", 2, 0.5, 0.5, 0.25, 0.125), ("val", "b", None, None, None, None, None)]


def test_folders_go_when_they_are_no_longer_read(spark):
    with shared.cuts_removed():
        df = shared.cut(spark.range(5))
        path = shared.scratch(spark)
        spark.range(3).write.parquet(path)
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path) and not any(os.path.exists(f.removeprefix("file:").removeprefix("//")) for f in df.inputFiles())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_missed_boxes_move_their_lines_once(spark):
    plan = detection_queries.fn_taxonomy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"l_orderkey", "cls"} and "cut-" not in plan
