import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import geometry as G
from lumenlake.functions import stats as S
from lumenlake.operators import annotations as A
from lumenlake.operators import arms, detection, pixels, selection, temporal


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def box(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_clamp_and_normal_form(spark):
    b = G.clamp(G.xyxy(*box(-5, 10, 60, 100)), F.lit(1920.0), F.lit(1080.0))
    assert list(one(spark, *b)) == [0, 10, 55, 110]
    n = one(spark, *G.to_norm(b, F.lit(1920.0), F.lit(1080.0)))
    assert [round(x, 6) for x in n] == [0.014323, 0.055556, 0.028646, 0.092593]


@pytest.mark.parametrize("least,kept", [(1, False), (0, True)])
def test_one_pixel_rules(spark, least, kept):
    assert one(spark, G.larger_than(box(0, 0, 1, 5), least))[0] is kept


def test_iou(spark):
    assert one(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)))[0] == pytest.approx(1 / 7)
    assert one(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)))[0] == 0


def test_letterbox(spark):
    s, w, h, left, top = one(spark, *G.letterbox(F.lit(1920), F.lit(1080), 640))
    assert (round(s, 4), w, h, left, top) == (0.3333, 640, 360, 0, 140)


def test_quantiles(spark):
    df = spark.range(10)
    assert df.agg(S.linear_quantiles("id", [0.25]))  .first()[0] == [2.25]
    assert df.agg(S.exclusive_quantile(F.array_sort(F.collect_list("id")), 0.25)).first()[0] == 1.75
    assert spark.range(2).agg(S.exclusive_quantile(F.array_sort(F.collect_list("id")), 0.25)).first()[0] is None


def test_bands_and_gates(spark):
    bands = one(spark, *(S.luma_band(F.lit(x)) for x in (90.0, 89.99, 40.0, 39.99)))
    assert list(bands) == ["day", "dusk", "dusk", "low_light"]
    assert list(one(spark, *(S.gate_verdict(F.lit(x)) for x in (0.01, 15.0, 15.01, 25.0)))) == ["—", "OK", "borderline", "fail"]
    with pytest.raises(ValueError):
        S.gate_verdict(F.lit(1.0), "other")


def test_degenerate_pedestrian_sets_no_flag(spark):
    rows = [(1, "36", 0, 0.0, 0.0, 1.0, 50.0, 1, False), (2, "36", 0, 0.0, 0.0, 20.0, 50.0, 1, True), (3, "36", 0, 0.0, 0.0, 20.0, 50.0, 3, False)]
    df = spark.createDataFrame(rows, "image_id int, recording string, box_no int, x double, y double, bw double, bh double, category_id int, ignore_flag boolean").withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    kinds = {r.image_id: r.kind for r in A.frame_flags(df).withColumn("kind", A.frame_kind()).collect()}
    assert kinds == {1: "background", 2: "ignore_only", 3: "rider_only"}


def test_held_out_recordings_stop():
    with pytest.raises(ValueError):
        A.guard_recordings(["36", "38"])


def test_blocks_and_thinning(spark):
    df = spark.createDataFrame([("MP_1",), ("MP_2",), ("MP_40",), ("X",)], "s string")
    prefix, number = selection.name_number(F.col("s"))
    got = selection.blocks(df.select(prefix.alias("p"), number.alias("n")), ["p"], "n")
    assert sorted((r.p, r.first, r.last, r.n) for r in got.collect()) == [("MP_", 1, 2, 2), ("MP_", 40, 40, 1), ("X", -1, -1, 1)]
    ten = spark.range(10).withColumn("k", F.lit(0))
    assert sorted(r.id for r in selection.thinned(ten, ["k"], ["id"], 4).collect()) == [0, 2, 5, 7]
    seven = selection.tail_split(spark.range(7).withColumn("k", F.lit(0)), ["k"], ["id"], 0.2)
    assert [r.id for r in seven.filter("split = 'val'").collect()] == [6]


@pytest.mark.parametrize("n,most", [(1, 1), (7, 3), (100, 13), (13, 13), (50, 49)])
def test_thinning_size(spark, n, most):
    df = spark.range(n).withColumn("k", F.lit(0))
    got = sorted(r.id for r in selection.thinned(df, ["k"], ["id"], most).collect())
    assert got == (list(range(n)) if n <= most else [int(i * n / most) for i in range(most)])


def test_smoothing_matches_recursion(spark):
    alpha = temporal.smoothing()
    assert alpha == pytest.approx(1 - math.exp(-2 * math.pi * 0.5 / 16))
    values = np.random.default_rng(1).random(300).tolist()
    df = spark.createDataFrame([(0, i + 1, v) for i, v in enumerate(values)], "recording int, seq int, v double")
    got = [r.ema for r in temporal.smoothed(df, "v", alpha, block=32).orderBy("seq").collect()]
    ema, want = values[0], []
    for i, v in enumerate(values):
        ema = v if i == 0 else alpha * v + (1 - alpha) * ema
        want.append(ema)
    assert got == pytest.approx(want)


def test_denoise_keeps_still_and_follows_motion(spark):
    df = spark.createDataFrame([(0, 1, [10.0, 10.0]), (0, 2, [10.0, 200.0]), (1, 1, [5.0, 5.0])], "recording int, frame_id long, luma array<double>")
    got = {(r.recording, r.frame_id): r.out for r in temporal.denoised(df, 2).collect()}
    assert got == {(0, 1): [10, 10], (0, 2): [10, 200], (1, 1): [5, 5]}


def test_neighbourhoods_against_numpy(spark):
    """Deviation, response and Laplacian with mirrored borders."""
    rng = np.random.default_rng(0)
    plane = np.floor(rng.random((6, 9)) * 256)
    px = spark.createDataFrame([(1, y, x, float(plane[y, x])) for y in range(6) for x in range(9)], "frame_id int, y int, x int, l double")
    got = {(r.y, r.x): r for r in pixels.around(px, ["frame_id"], "l", "l").collect()}
    p = np.pad(plane, 1, mode="reflect")
    for y in range(6):
        for x in range(9):
            w = p[y : y + 3, x : x + 3]
            k = np.outer([1, -2, 1], [1, -2, 1])
            assert got[y, x].l_sd == pytest.approx(w.std()) and got[y, x].l_response == pytest.approx((w * k).sum()) and got[y, x].l_mean == pytest.approx(w.mean())
            assert got[y, x].l_laplace == pytest.approx(w[0, 1] + w[2, 1] + w[1, 0] + w[1, 2] - 4 * w[1, 1])


def test_arms_of_a_flat_frame_change_nothing(spark):
    px = spark.createDataFrame([(1, y, x, 50.0) for y in range(4) for x in range(4)], "frame_id int, y int, x int, l double")
    got = {r.arm: r for r in arms.measured(px, 2, 4, 4).collect()}
    assert got["none"].psnr is None and got["none"].gain == 1 and got["none"].noise_out == 0 and got["none"].core_out is None
    assert got["gamma"].mean_out > 50


def test_ratio_of_means(spark):
    rows = [(1, "a", 2.0, 1.0), (2, "a", 4.0, 7.0)]
    df = spark.createDataFrame(rows, "frame_id int, arm string, contrast double, gain double")
    df = df.withColumns({m: F.lit(0.0) for m in arms.METRICS if m not in df.columns})
    assert arms.arm_summary(df).first().contrast_over_gain == 0.75


# Published error counts of two runs over 2,146 images (class: width bins matched/GT, misses and false alarms by reason, sweep tp/fp).
RUNS = {
    "c4d_26n_960": {
        "bollard": ([(747, 1522), (1835, 2392), (1250, 1605), (1180, 1469)], (72, 1098, 94, 712), (223, 74, 0, 495), [(5012, 792), (5529, 2270), (5792, 4092), (6187, 12451)]),
        "person": ([(1, 14), (395, 801), (1539, 1907), (1795, 2014)], (60, 510, 190, 246), (181, 69, 5, 488), [(3730, 743), (4035, 1957), (4175, 3603), (4401, 13083)]),
    },
    "c4d_11n_640": {
        "bollard": ([(485, 1522), (1636, 2392), (1198, 1605), (1167, 1469)], (151, 1098, 79, 1174), (266, 246, 8, 701), [(4486, 1221), (5042, 3557), (5310, 6173), (5648, 18247)]),
        "person": ([(0, 14), (216, 801), (1327, 1907), (1760, 2014)], (84, 758, 197, 394), (154, 138, 6, 408), [(3303, 706), (3698, 2417), (3898, 4730), (4223, 16812)]),
    },
}


def test_published_benchmark(spark):
    rows = []
    for run, classes in RUNS.items():
        for cls, (bins, fn, fp, sweep) in classes.items():
            for b, (m, g) in zip(("<4px", "4~8px", "8~16px", ">16px"), bins):
                rows += [(run, "GT", cls, None, b, g), (run, "matched", cls, None, b, m)]
            rows += [(run, "FN", cls, r, None, n) for r, n in zip(("nearmiss", "lowconf", "merged", "blind"), fn)]
            rows += [(run, "FP", cls, r, None, n) for r, n in zip(("dup", "nearmiss", "confusion", "ghost"), fp)]
            rows += [(run, f"sweep_{k}@{t}", cls, None, None, n) for t, pair in zip((0.25, 0.1, 0.05, 0.01), sweep) for k, n in zip(("tp", "fp"), pair)]
    df = spark.createDataFrame(rows, "run string, kind string, class string, reason string, width_bin string, count int")
    got = {r.run: r for r in detection.error_benchmark(df, 2146).collect()}
    best = got["c4d_26n_960"]
    assert (best.bollard_r0, best.fp_per_image025, best.bollard_gt, best.person_gt) == (0.4908, 0.715, 6988, 4736)
    for r in got.values():
        assert r.person_gt == r.person_matched + r.person_fn and r.bollard_gt == r.bollard_matched + r.bollard_fn
    assert (best.fp_per_image01, best.fp_per_image005, best.fp_per_image001) == (1.97, 3.586, 11.898)


def test_decoded_head(spark):
    raw = F.array(*(F.lit(x) for x in (10.0, 10.0, 4.0, 4.0, 0.2, 0.7, 0.7)))
    assert tuple(one(spark, detection.decoded_head(raw, 3))[0]) == (1, 0.7)
