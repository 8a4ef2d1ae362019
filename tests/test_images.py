"""Operators on planes against plain NumPy, and files of images."""

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import blobs as B
from lumenlake.operators import detection as D
from lumenlake.operators import enhancement as E
from lumenlake.operators import matrix as M
from lumenlake.operators import neighbourhoods as N
from lumenlake.operators import quality as Q
from lumenlake.operators import segments as L
from lumenlake.operators import temporal as T
from lumenlake.sources import images as I
from lumenlake.sources.shared import cuts_removed


def rows(spark, frames, names="l"):
    """Pixel rows of frames: {frame_id: plane or planes}."""
    data = []
    for k, planes in frames.items():
        planes = planes if isinstance(planes, tuple) else (planes,)
        h, w = planes[0].shape
        data += [(k, y, x, h, w, *(float(p[y, x]) for p in planes)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(data, "frame_id long, y int, x int, height int, width int, " + ", ".join(f"{c} double" for c in names.split()))


def plane(df, frame, name, shape):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("frame_id") == frame).collect():
        out[r.y, r.x] = r[name]
    return out


def boxed(a, k):
    before = k // 2
    p = np.pad(a.astype(float), ((before, k - 1 - before),) * 2, mode="reflect")
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(k) for j in range(k)) / (k * k)


@pytest.mark.parametrize("k", [3, 4, 9])
def test_box_means_mirror_borders(spark, k):
    a = np.random.default_rng(k).integers(0, 256, (11, 14))
    out = N.box_means(rows(spark, {1: a}), ["frame_id"], {"m": F.col("l")}, k, F.col("height"), F.col("width"))
    assert np.allclose(plane(out, 1, "m", a.shape), boxed(a, k))


def naive_blobs(lit, diagonal):
    """By flooding: (first pixel, area, top, bottom, left, right)."""
    seen, out = set(), []
    for y, x in zip(*np.nonzero(lit), strict=True):
        if (y, x) in seen:
            continue
        todo, own = [(y, x)], set()
        while todo:
            p = todo.pop()
            if p in own or not (0 <= p[0] < lit.shape[0] and 0 <= p[1] < lit.shape[1] and lit[p]):
                continue
            own.add(p)
            todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not (i and j)]
        seen |= own
        ys, xs = [p[0] for p in own], [p[1] for p in own]
        out.append((*min(own), len(own), min(ys), max(ys), min(xs), max(xs)))
    return sorted(tuple(map(int, b)) for b in out)


def spiral(n):
    a, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    a[0, 0] = True
    for _ in range(n * n):
        ny, nx, by, bx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
        if not (0 <= ny < n and 0 <= nx < n) or a[ny, nx] or (0 <= by < n and 0 <= bx < n and a[by, bx]):
            dy, dx = dx, -dy
            ny, nx, by, bx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
            if not (0 <= ny < n and 0 <= nx < n) or a[ny, nx] or (0 <= by < n and 0 <= bx < n and a[by, bx]):
                break
        y, x = ny, nx
        a[y, x] = True
    return a


@pytest.mark.parametrize("diagonal", [True, False])
def test_blobs(spark, diagonal):
    rng = np.random.default_rng(1)
    planes = {1: rng.random((20, 23)) < 0.4, 2: spiral(21), 3: np.zeros((5, 5), bool), 4: np.ones((6, 7), bool)}
    px = rows(spark, planes).where("l > 0")
    with cuts_removed():
        got = B.blobs(px.union(px.limit(5)), diagonal).collect()
    for k, lit in planes.items():
        assert sorted(tuple(r)[1:] for r in got if r.frame_id == k) == naive_blobs(lit, diagonal)
    assert B.blobs(px.limit(0)).count() == 0


def test_probe_and_verdicts(spark):
    dark, lamp, sky = np.full((20, 20), 10), np.full((20, 20), 10), np.full((20, 20), 10)
    lamp[3, 3] = lamp[10, 10] = 240
    sky[:2, :10] = 240
    probe = B.luma_probe(rows(spark, {i: (dark, lamp, sky)[i // 6] for i in range(18)}))
    got = {r.frame_id: r for r in probe.collect()}
    assert (got[0].lamp, got[0].big, got[0].blobs) == (0, 0, 0) and got[6].blobs == 2 and got[6].big == 0.25 and got[12].big == 5
    verdict = lambda lo, hi: [(r.band, r.n, r.verdict) for r in B.source_verdicts(probe.where(F.col("frame_id").between(lo, hi))).collect()]
    assert verdict(0, 5) == [("low_light", 6, "no saturated source")]
    assert verdict(6, 11) == [("low_light", 6, "point lights")]
    assert verdict(12, 17) == [("low_light", 6, "sky or reflection")]
    assert verdict(0, 3) == []


def bitmap(a):
    """A 24-bit bitmap file of blue, green and red planes."""
    h, w = a.shape[:2]
    lines = [a[y].astype(np.uint8).tobytes() for y in reversed(range(h))]
    body = b"".join(r + b"\0" * (-len(r) % 4) for r in lines)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_images_are_read_and_broken_ones_skipped(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, (6, 9, 3)), rng.integers(0, 256, (4, 4, 3))
    folder = tmp_path / "밤 사진"
    (folder / "deeper").mkdir(parents=True)
    (folder / "ä.bmp").write_bytes(bitmap(a))
    (folder / "deeper" / "b.bmp").write_bytes(bitmap(b))
    (folder / "broken.bmp").write_bytes(b"BMxx")
    (folder / "empty.png").write_bytes(b"")
    images = I.read_images(spark, str(folder))
    assert sorted((r.height, r.width, r.n_channels) for r in images.collect()) == [(4, 4, 3), (6, 9, 3)]
    px = I.pixel_rows(images).where("height = 6")
    got = {(r.y, r.x): (r.b, r.g, r.r, r.l) for r in px.collect()}
    assert len(got) == 54
    for (y, x), (blue, green, red, grey) in got.items():
        assert (blue, green, red) == tuple(a[y, x]) and abs(grey - (0.114 * blue + 0.587 * green + 0.299 * red)) <= 0.51
    small = {(r.y, r.x): r.l for r in I.quarter(px, ["origin"]).collect()}
    assert set(small) == {(y, x) for y in range(2) for x in range(3)}
    assert small[1, 2] == math.floor(np.mean([got[y, 8][3] for y in (4, 5)]) + 0.5)


def naive_flat(a, least, k):
    dark = (a >= 3) & (a <= 80)
    dark = dark if dark.sum() >= least else a <= np.percentile(a, 60)
    sd = np.sqrt(np.maximum(boxed(a * a, k) - boxed(a, k) ** 2, 0))
    flat = dark & (sd <= 2)
    if flat.sum() < least:
        flat = dark & (sd <= np.percentile(sd[dark], 50))
    p = np.pad(flat, 1, constant_values=True)
    eroded = np.all([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0)
    return eroded if eroded.sum() >= least else dark


def test_flat_dark_takes_every_fallback(spark):
    rng = np.random.default_rng(3)
    calm = np.full((24, 24), 40.0)
    calm[:, 20:] = 200
    noisy = rng.integers(3, 80, (24, 24)).astype(float)
    rising = np.add.outer(np.arange(24) ** 1.3, np.zeros(24)).round()
    bright = rng.integers(90, 250, (24, 24)).astype(float)
    planes = {1: calm, 2: noisy, 3: rising, 4: bright}
    out = Q.flat_dark(rows(spark, planes), 100, 9)
    for k, a in planes.items():
        assert np.array_equal(plane(out, k, "flat", a.shape) == 1, naive_flat(a, 100, 9)), k


def test_noise_on_masks(spark):
    rng = np.random.default_rng(4)
    noise = 100 + rng.normal(0, 3, (60, 60))
    px = rows(spark, {1: noise, 2: np.add.outer(np.arange(60.0), 2 * np.arange(60.0))}).withColumn("mask", (F.col("y") % 59 > 0) & (F.col("x") % 59 > 0))
    got = {r.frame_id: r.l_noise for r in Q.masked_noise(px, ["frame_id"], ["l"], "mask").collect()}
    assert abs(got[1] - 3) < 0.2 and got[2] == pytest.approx(0, abs=1e-9)
    assert Q.masked_noise(px.withColumn("mask", F.lit(False)), ["frame_id"], ["l"], "mask").first().l_noise is None


def test_lab_of_known_colours(spark):
    known = {(0, 0, 0): (0, 128, 128), (255, 255, 255): (255, 128, 128), (255, 0, 0): (82, 207, 20), (0, 255, 0): (224, 42, 211), (0, 0, 255): (136, 208, 195), (128, 128, 128): (137, 128, 128)}
    df = spark.createDataFrame([tuple(map(float, c)) for c in known], "b double, g double, r double")
    got = df.select("b", "g", "r", *(c.alias(n) for n, c in zip("lax", Q.lab(*(F.col(c) for c in "bgr")), strict=True))).collect()
    for r in got:
        assert np.allclose((r.l, r.a, r.x), known[int(r.b), int(r.g), int(r.r)], atol=1)


def test_contrast_gain_of_a_gamma_is_one(spark):
    a = np.random.default_rng(5).integers(0, 200, (20, 20)).astype(float)
    local = np.clip(a + 40 * np.sin(a), 0, 255)
    px = rows(spark, {1: (a, 255 * (a / 255) ** 0.6, local)}, "l even local")
    long = px.select("frame_id", "y", "x", "height", "width", "l", F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), F.col(n).alias("o")) for n in ("even", "local")))).alias("a")).select("frame_id", "y", "x", "height", "width", "l", "a.*")
    got = {r.arm: r for r in Q.contrast_gains(long, 50).collect()}
    assert got["even"].contrast_gain == pytest.approx(1, abs=1e-3) and got["even"].ref_gamma == pytest.approx(0.6, abs=1e-3)
    assert got["local"].contrast_gain > 1.05


def test_similarity(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (16, 18)).astype(float)
    b = np.clip(a + rng.normal(0, 20, a.shape), 0, 255)
    got = {r.frame_id: r for r in Q.similarity(rows(spark, {1: (a, b), 2: (a, a)}, "a b"), ["frame_id"]).collect()}
    assert got[2].ssim == pytest.approx(1) and got[2].psnr is None
    c, s = 49 / 48, []
    for y in range(3, 13):
        for x in range(3, 15):
            p, q = a[y - 3 : y + 4, x - 3 : x + 4], b[y - 3 : y + 4, x - 3 : x + 4]
            vp, vq, vpq = c * p.var(), c * q.var(), c * ((p - p.mean()) * (q - q.mean())).mean()
            s.append((2 * p.mean() * q.mean() + 6.5025) * (2 * vpq + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (vp + vq + 58.5225)))
    assert got[1].ssim == pytest.approx(np.mean(s)) and got[1].psnr == pytest.approx(10 * math.log10(65025 / ((a - b) ** 2).mean()))


def naive_tiles(a, n, clip):
    th, tw = a.shape[0] // n, a.shape[1] // n
    curves = np.zeros((n, n, 256))
    for i in range(n):
        for j in range(n):
            h = np.bincount(a[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            most = max(1, int(clip * th * tw / 256))
            over = np.maximum(h - most, 0).sum()
            h = np.minimum(h, most) + over // 256
            left = over % 256
            if left:
                for v in range(0, 256, max(256 // left, 1)):
                    if left > 0:
                        h[v], left = h[v] + 1, left - 1
            curves[i, j] = np.rint(np.round(np.cumsum(h) * 255 / (th * tw), 6))
    out = np.zeros(a.shape)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            py, px = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
            i, j = math.floor(py), math.floor(px)
            at = lambda u, v: curves[min(max(u, 0), n - 1), min(max(v, 0), n - 1), a[y, x]]
            fy, fx = py - i, px - j
            out[y, x] = np.rint(round((at(i, j) * (1 - fx) + at(i, j + 1) * fx) * (1 - fy) + (at(i + 1, j) * (1 - fx) + at(i + 1, j + 1) * fx) * fy, 6))
    return np.clip(out, 0, 255)


@pytest.mark.parametrize("clip", [2.0, 40.0])
def test_tile_equalisation(spark, clip):
    a = np.clip(np.random.default_rng(7).normal(60, 30, (32, 48)), 0, 255).astype(int)
    out = E.tile_equalised(rows(spark, {1: a}), 4, clip, None)
    assert np.array_equal(plane(out, 1, "o", a.shape), naive_tiles(a, 4, clip))


def test_guided_filter(spark):
    a = np.random.default_rng(8).random((24, 32))
    a[:, 16:] += 3
    cells = a.reshape(6, 4, 8, 4).mean(axis=(1, 3))
    m, v = boxed(cells, 4), boxed(cells * cells, 4) - boxed(cells, 4) ** 2
    slope = v / (v + 1e-3)
    offset = m - slope * m
    want = np.zeros(a.shape)
    for y in range(24):
        for x in range(32):
            py, px = (y + 0.5) / 4 - 0.5, (x + 0.5) / 4 - 0.5
            i, j = math.floor(py), math.floor(px)
            at = lambda g: sum(g[min(max(i + u, 0), 5), min(max(j + w, 0), 7)] * (py - i if u else 1 - py + i) * (px - j if w else 1 - px + j) for u in (0, 1) for w in (0, 1))
            want[y, x] = at(slope) * a[y, x] + at(offset)
    assert np.allclose(plane(E.guided(rows(spark, {1: a}, "v"), "v"), 1, "smooth", a.shape), want)


def test_division_by_light_lifts_dark_and_keeps_bright(spark):
    dark, bright = np.full((24, 24), 20), np.full((24, 24), 255)
    out = E.divided_by_light(rows(spark, {1: (dark, dark // 2, dark), 2: (bright, bright, bright)}, "b g r"))
    assert {(r.ob, r.og) for r in out.where("frame_id = 1").collect()} == {(math.floor(20 / 0.15**0.8), math.floor(10 / 0.15**0.8))}
    assert {r.ob for r in out.where("frame_id = 2").collect()} == {255}


def test_darkened_noise_is_normal_and_repeats(spark):
    px = spark.range(40_000).select(F.lit(1).alias("frame_id"), F.floor(F.col("id") / 200).alias("y"), (F.col("id") % 200).alias("x"), F.lit(128.0).alias("l"))
    z = px.select(E.normal_noise(3, F.col("frame_id"), F.col("y"), F.col("x"), "l").alias("z")).agg(F.avg("z"), F.stddev("z"), F.avg(F.pow("z", F.lit(4)))).first()
    assert abs(z[0]) < 0.02 and abs(z[1] - 1) < 0.02 and abs(z[2] - 3) < 0.15
    one, other = (E.darkened(px, ["l"], seed=s).agg(F.sum("dl"), F.avg("dl")).first() for s in (0, 1))
    assert tuple(E.darkened(px, ["l"], seed=0).agg(F.sum("dl"), F.avg("dl")).first()) == tuple(one) != tuple(other)
    assert abs(one[1] - 255 * ((128 / 255) ** 2.2 * 0.35) ** (1 / 2.2)) < 2
    assert E.darkened(px.withColumn("l", F.lit(0.0)), ["l"]).agg(F.min("dl")).first()[0] == 0


def test_arms_fold_stages_and_guard_single_pictures(spark):
    px = rows(spark, {1: (np.full((16, 16), 64),) * 3}, "b g r")
    arms = M.Arms({"none": [], "twice": [M.gamma(0.5), M.gamma(0.5)], "A1+ts": [M.gamma(0.5)]}, temporal=["A1+ts"])
    got = {(r.arm, r.ob) for r in arms.applied(px, ["none", "twice"]).collect()}
    assert got == {("none", 64.0), ("twice", float(math.floor(255 * (math.floor(255 * (64 / 255) ** 0.5) / 255) ** 0.5)))}
    with pytest.raises(ValueError, match="sequence"):
        arms.applied(px)
    with pytest.raises(KeyError, match="no arm"):
        arms.applied(px, ["other"])


def test_segments(spark):
    kind = "image_id long, {} long, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(1, 1, 0.0, 100.0, 100.0, 100.0), (1, 2, 0.0, 119.0, 100.0, 121.0), (1, 3, 200.0, 50.0, 229.0, 50.0), (2, 1, 0.0, 0.0, 90.0, 90.0)], kind.format("gt"))
    found = spark.createDataFrame([(1, 1, 10.0, 108.0, 90.0, 110.0), (1, 2, 60.0, 95.0, 120.0, 90.0), (1, 3, 200.0, 50.0, 260.0, 50.0), (2, 1, 0.0, 45.0, 90.0, 45.0), (1, 4, 0.0, 129.5, 40.0, 130.0)], kind.format("pred"))
    pairs = L.segment_pairs(truth, found)
    assert sorted((r.image_id, r.gt, r.pred) for r in pairs.collect()) == [(1, 1, 1), (1, 1, 2), (1, 2, 4)]
    assert sorted((r.image_id, r.gt, r.pred, r.overlap) for r in L.segment_matches(pairs).collect()) == [(1, 1, 1, 80.0), (1, 2, 4, 40.0)]


def test_mean_average_precision(spark):
    box = lambda k, x, w: (1, k, 1, float(x), 0.0, float(x + w), 10.0)
    truth = spark.createDataFrame([box(1, 0, 10), box(2, 100, 10), (1, 9, 2, 0.0, 50.0, 9.0, 60.0)], "image_id long, gt long, cls int, x1 double, y1 double, x2 double, y2 double")
    preds = spark.createDataFrame([(*box(1, 0, 10)[:3], 0.9, *box(1, 0, 10)[3:]), (*box(2, 101, 10)[:3], 0.8, *box(2, 101, 10)[3:]), (*box(3, 500, 10)[:3], 0.7, *box(3, 500, 10)[3:])], "image_id long, pred long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    got = {r.cls: r for r in D.mean_average_precision(truth, preds, D.overlaps(truth, preds, 0.5)).collect()}
    # The second overlaps by 9 / 11 = 0.818: found at seven thresholds; beyond, half the truths are.
    assert got[1].map50 == pytest.approx(1) and got[1].map50_95 == pytest.approx((7 + 3 * 51 / 101) / 10)
    assert (got[1].precision, got[1].recall) == (1, 1)
    assert (got[2].map50, got[2].map50_95, got[2].precision) == (0, 0, None)


def test_sequences_begin_anew_at_gaps(spark, monkeypatch):
    from lumenlake.operators import selection

    monkeypatch.setattr(selection, "SPAN", 7)
    frames = [(r, 100 * r + k, at, float(at), "a" if k % 2 else None) for r in (1, 2) for k, at in enumerate([0, 1, 2, 3, 3, 10, 11, 12, 30, 31])]
    df = spark.createDataFrame(frames, "recording int, frame_id long, at int, mean_luma double, detection string").repartition(5)
    got = sorted(map(tuple, T.two_paths(df, "at", 5, every=2, alpha=0.5).where("recording = 2").collect()), key=lambda r: r[2])
    assert [r[1] for r in got] == [1] * 5 + [2] * 3 + [3] * 2 and [r[3] for r in got] == [1, 2, 3, 4, 5, 1, 2, 3, 1, 2]
    assert [round(r[4], 4) for r in got] == [0, 0.5, 1.25, 2.125, 2.5625, 10, 10.5, 11.25, 30, 30.5]
    assert [r[5] for r in got] == [None] * 5 + ["a", "a", "a"] + [None, None]
    planes = df.select("recording", "frame_id", "at", F.array(*[F.col("mean_luma")] * 9).alias("luma"))
    out = {r.frame_id: r.out[0] for r in T.denoised(T.split_at_gaps(planes, "at", 5).drop("seq"), 3).where("recording.recording = 1").collect()}
    assert out[100] == 0 and out[105] == 10 and out[108] == 30 and out[101] < 1


def test_runs_break_by_the_nearest_second_and_go_by_time(spark, tmp_path):
    import datetime as dt

    from lumenlake.plans import frame_queries
    from tests.compare import database, same

    start, rows = dt.datetime(2024, 1, 1), []
    # gaps near 21,600 seconds, each of a user of its own; and two frames of one second whose ids fall as time rises
    for user, first, gap in ((1, 0.4, 21600.2), (2, 0.0, 21600.9), (3, 0.6, 21600.2), (4, 0.4, 0.05)):
        rows += [(10 * user + 1, start + dt.timedelta(seconds=first), user, "view", 10.0), (10 * user, start + dt.timedelta(seconds=first + gap), user, "click", 90.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = frame_queries.two_path_sequence(spark, str(tmp_path))
    same(got, database(str(tmp_path)), frame_queries.ORACLES["two_path_sequence"])
    assert {r.frame_id: (r.run, r.seq) for r in got.collect()} == {11: (1, 1), 10: (2, 1), 21: (1, 1), 20: (2, 1), 31: (1, 1), 30: (1, 2), 41: (1, 1), 40: (1, 2)}


def test_many_vectors_share_an_image_file(spark, tmp_path, monkeypatch):
    import glob

    from lumenlake.plans import image_queries
    from tests.compare import database, same

    monkeypatch.setattr(image_queries, "SHEET", 8)
    rng = np.random.default_rng(8)
    spark.createDataFrame([(1000003 * i, [float(v) for v in rng.normal(0, 0.3, 64)], i % 3) for i in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/bitmaps-*/**/part-*", recursive=True))
    before = found()
    same(image_queries.image_luma(spark, str(tmp_path)), database(str(tmp_path)), image_queries.ORACLES["image_luma"])
    assert 300 / 8 <= len(found() - before) < 60


def test_strips_of_images(spark):
    whole = spark.createDataFrame([("a", 5, 2, 1, bytes(range(10)))], "name string, height int, width int, n_channels int, data binary")
    got = [(r.name, r.strip, r.height, r.width, bytes(r.data)) for r in I.strips(whole, 2).orderBy("strip").collect()]
    assert got == [("a", 0, 2, 2, bytes(range(4))), ("a", 1, 2, 2, bytes(range(4, 8))), ("a", 2, 1, 2, bytes([8, 9]))]


def test_noise_of_planes_that_lack_pixels(spark, tmp_path):
    from lumenlake.plans import image_queries
    from tests.compare import database, same

    # of 16 vectors that make a plane, some are missing at its end, in its middle, or all but two that meet at a corner
    rng = np.random.default_rng(9)
    ids = [*range(7), *(16 + i for i in range(16) if i not in (5, 10)), 32, 37, *range(48, 64)]
    spark.createDataFrame([(i, [float(v) for v in rng.normal(-0.1, 0.02 + 0.1 * (i % 2), 64)], i % 3) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = database(str(tmp_path))
    for name in ("noise_absolute", "flat_dark_masks", "structural_similarity"):
        same(image_queries.QUERIES[name](spark, str(tmp_path)), con, image_queries.ORACLES[name])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_matrix_deals_vectors_and_no_pixels(spark):
    import re

    from lumenlake.plans import image_queries

    plan = image_queries._measures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange (\w+).*?, (ENSURE_REQUIREMENTS|REPARTITION_BY_NUM)", plan)
    assert dealt and {how for _, how in dealt} == {"REPARTITION_BY_NUM"} and "cut-" not in plan
