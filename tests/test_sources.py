import json

from pyspark.sql import functions as F

from lumenlake.sources import annotations as S
from lumenlake.sources import sinks

XML = """<annotations><image name="a.jpg" width="100" height="50">
<box label="person" xtl="-5" ytl="1" xbr="20" ybr="30"/><box label="car" xtl="1" ytl="1" xbr="5" ybr="5"/>
<polygon label="road" points="1,2;10,20;5,30"><attribute name="kind">stairs</attribute></polygon>
<polyline label="Stair" points="1,2;3,4"/></image>
<image name="b.jpg" width="100" height="50"></image></annotations>"""


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "x.png", "width": 100, "height": 50, "recordings_id": 36.0}, {"id": 2, "file_name": "y.png", "width": 100, "height": 50, "recordings_id": None}],
           "annotations": [{"image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4], "ignore": 0}, {"image_id": 2, "category_id": 4, "bbox": [1, 2, 3, 4], "ignore": 1}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, boxes = S.coco(spark, str(tmp_path / "c.json"))
    assert {r.image_id: r.recording for r in images.collect()} == {1: "36", 2: "none"}
    assert sorted((r.image_id, r.category_id, r.ignore_flag, r.bw) for r in boxes.collect()) == [(1, 1, False, 3), (2, 4, True, 3)]


def test_cvat(spark, tmp_path):
    (tmp_path / "t.xml").write_text(XML)
    boxes, dropped = S.cvat_boxes(spark, str(tmp_path / "t.xml"), {"person": 0})
    assert sorted((r.name, r.cls, r.x1, r.x2) for r in boxes.collect() if r.cls is not None) == [("a.jpg", 0, 0.0, 20.0)]
    assert [r.name for r in boxes.collect() if r.cls is None] == ["b.jpg"]
    assert [tuple(r) for r in dropped.collect()] == [("car", 1, 0)]
    (tmp_path / "u.xml").write_text(XML.replace('label="car" xtl="1" ytl="1" xbr="5"', 'label="person" xtl="1" ytl="1" xbr="1"'))
    boxes, dropped = S.cvat_boxes(spark, f"{tmp_path}/*.xml", {"person": 0}, min_width=3)
    assert boxes.count() == 4 and sorted(tuple(r) for r in dropped.collect()) == [("car", 1, 0), ("person", 0, 1)]
    assert [tuple(r)[3:] for r in S.surface_boxes(spark, str(tmp_path / "t.xml")).collect()] == [(1.0, 2.0, 10.0, 30.0)]
    assert [r.task for r in S.xml_tasks(spark, str(tmp_path / "t.xml")).collect()] == ["bbox"]


def test_every_marker_tells_the_task(spark, tmp_path):
    for task, labels in (("surface", ["sidewalk", "roadway", "caution_zone", "braille_guide_blocks", "bike_lane", "alley"]), ("bbox", ["bollard", "tree_trunk", "traffic_sign", "pole", "car"]), ("unknown", ["person"])):
        for label in labels:
            (tmp_path / f"{task}-{label}.xml").write_text(f'<annotations><image name="a" width="9" height="9"><box label="{label}" xtl="1" ytl="1" xbr="5" ybr="5"/></image></annotations>')
    got = S.xml_tasks(spark, str(tmp_path)).collect()
    assert len(got) == 12 and all(r.file.rsplit("/", 1)[1].startswith(r.task) for r in got)


def test_label_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 .5 .5 .1 .2\nbad line\n2.0 .1 .1 .1 .1\n")
    (tmp_path / "2015_1.png.txt").write_text("1 10 20 30.9 40\n")
    assert sorted((r.image, r.cls) for r in S.yolo_labels(spark, str(tmp_path)).collect()) == [("2015_1", 1), ("a", 0), ("a", 2)]
    assert [(r.image, r.x2) for r in S.segment_labels(spark, str(tmp_path / "2015_1.png.txt")).collect()] == [("2015_1", 30)]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for p in ("a.PNG", "d/a.png", "d/n.txt"):
        (tmp_path / p).write_bytes(b"xy")
    found = S.image_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.PNG", "a.png"]
    assert S.first_by_name(found).count() == 2
    assert len({r.sha256 for r in S.checksums(spark, str(tmp_path)).collect()}) == 1


def test_background_image_keeps_an_empty_label(spark, tmp_path):
    images = spark.createDataFrame([("a", "train"), ("b", "val")], "image string, split string")
    boxes = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.1, 0.2)], "image string, cls int, cx double, cy double, w double, h double")
    texts = sinks.label_texts(images, boxes)
    assert {r.image: r.text for r in texts.collect()} == {"a": "0 0.500000 0.500000 0.100000 0.200000", "b": ""}
    sinks.write_labels(texts, str(tmp_path / "out"))
    assert {(r.split, r.image, r.text) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("train", "a", "0 0.500000 0.500000 0.100000 0.200000"), ("val", "b", "")}


def test_stats(spark):
    df = spark.createDataFrame([("a", 1)], "g string, n int")
    assert json.loads(sinks.nested_stats(df, "g", "n").first().stats) == {"n": 1}
    assert sinks.missing(df, df.filter(F.lit(False)), "g").count() == 1
