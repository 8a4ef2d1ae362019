"""Queries on pixels, frame sequences and benchmark matrices, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import stats as S
from lumenlake.operators import arms as ARMS
from lumenlake.operators import pixels as P
from lumenlake.operators import temporal as T
from lumenlake.plans import views as V
from lumenlake.streaming import frames as ST

SIDE, LEAST = 8, 16


def _px(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel rows with their recording, a vector's label."""
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("recording"), F.posexplode("embedding").alias("pos", "v"))
    level = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("v").cast("double") + 0.3) * 425.0).cast("double")))
    return e.select("frame_id", "recording", F.floor(F.col("pos") / SIDE).cast("int").alias("y"), (F.col("pos") % SIDE).alias("x"), level.alias("l"))


def pixel_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(_px(spark, sf), "recording")


def agcwd_curve(spark: SparkSession, sf: str) -> DataFrame:
    return P.weighted_curve(P.histogram(_px(spark, sf), "recording"), "recording")


def local_std_interior(spark: SparkSession, sf: str) -> DataFrame:
    return P.local_std(V.pixels(spark, sf), 1, SIDE, SIDE).groupBy("frame_id").agg(F.round(F.avg("sd"), 3).alias("mean_sd"), F.round(F.max("sd"), 3).alias("max_sd"))


def dark_mask_stats(spark: SparkSession, sf: str) -> DataFrame:
    return P.dark_mask(V.pixels(spark, sf), LEAST).groupBy("frame_id").agg(F.count_if("dark").alias("dark"), F.round(F.avg(F.when(F.col("dark"), F.col("l"))), 3).alias("dark_mean"))


def glare_core(spark: SparkSession, sf: str) -> DataFrame:
    return P.glare(V.pixels(spark, sf), 3).select("frame_id", F.round("p99", 3).alias("p99"), F.round("saturated", 4).alias("saturated"), F.round("core", 3).alias("core"))


def saturation_rates(spark: SparkSession, sf: str) -> DataFrame:
    l = F.col("l")  # noqa: E741
    return _px(spark, sf).groupBy("recording").agg(*(F.round(100 * S.share(c), 4).alias(n) for n, c in (("dark", l <= 80), ("crushed", l < 3), ("lamp", l >= P.LAMP), ("saturated", l >= P.SATURATED))))


def tone_curve_bins(spark: SparkSession, sf: str) -> DataFrame:
    gamma = F.floor(F.pow(F.col("l") / 255, F.lit(0.45)) * 255)
    return P.tone_curve(V.pixels(spark, sf), gamma).select("bin", "frames", F.round("level", 3).alias("level"))


def gamma_match(spark: SparkSession, sf: str) -> DataFrame:
    """The gamma that lifts each plane to the mean level of 120."""
    levels = V.pixels(spark, sf).groupBy("frame_id", "l").agg(F.count(F.lit(1)).alias("n"))
    frames = levels.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("l", "n"))).alias("h"))
    return frames.select("frame_id", F.round(P.gamma_to_mean(F.col("h"), F.lit(120.0)), 4).alias("gamma"))


def frame_diff_flicker(spark: SparkSession, sf: str) -> DataFrame:
    return T.flicker(V.frames(spark, sf)).select("recording", F.round("sigma", 3).alias("sigma"), "pairs")


def hold_last_detection(spark: SparkSession, sf: str) -> DataFrame:
    f = V.frames(spark, sf)
    return f.select("recording", "frame_id", T.held(f, "detection").alias("held"))


def detect_stride(spark: SparkSession, sf: str) -> DataFrame:
    f = V.frames(spark, sf)
    return f.withColumn("held", T.held(f, "detection", every=3)).groupBy("recording", "held").agg(F.count(F.lit(1)).alias("frames"))


def flicker_amplification(spark: SparkSession, sf: str) -> DataFrame:
    """Flicker of a brightened sequence over that of the input."""
    f = V.frames(spark, sf).withColumn("bright", 255 * F.pow(F.col("mean_luma") / 255, F.lit(0.45)))
    base, out = T.flicker(f), T.flicker(f, "bright").toDF("recording", "sigma_out", "pairs_out")
    return base.join(out, "recording").select("recording", F.round(F.try_divide("sigma_out", "sigma"), 3).alias("amplification"))


def static_mask_sigma(spark: SparkSession, sf: str) -> DataFrame:
    return T.temporal_noise(_px(spark, sf), 4).select("recording", *(F.round(c, 3).alias(c) for c in ("sigma", "static_share", "moving_share")))


def iir_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    return T.smoothed(V.frames(spark, sf), "mean_luma", T.smoothing(), block=64).select("recording", "frame_id", F.round("ema", 3).alias("ema"))


def motion_denoise(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    return T.denoised(V.planes(spark, sf), SIDE).select("recording", "frame_id", F.round(mean("luma"), 3).alias("mean_in"), F.round(mean("out"), 3).alias("mean_out"))


def motion_denoise_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Denoising that begins anew where a recording has a gap of over 25 frame numbers."""
    runs = T.split_at_gaps(V.planes(spark, sf), "frame_id", 25).drop("seq")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    return T.denoised(runs, SIDE).select("recording.recording", "recording.run", "frame_id", F.round(mean("luma"), 3).alias("mean_in"), F.round(mean("out"), 3).alias("mean_out"))


def two_path_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed frames and held detections of runs between gaps of six hours, of times in whole seconds, the nearest."""
    frames = V.frames(spark, sf).withColumn("at", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    p = T.two_paths(frames, "at", 6 * 3600, order=["ts", "frame_id"])
    return p.select("recording", "run", "frame_id", "seq", F.round("shown", 3).alias("shown"), "held")


def tone_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Brightened planes whose tone curve is smoothed over the recording, from every second pixel of either direction."""
    px = _px(spark, sf).withColumn("o", F.floor(255 * F.pow(F.col("l") / 255, F.lit(ARMS.GAMMA))).cast("double"))
    out = T.tone_smoothed(px, T.smoothing(), every=2)
    return out.groupBy("recording", "frame_id").agg(F.round(F.avg("o"), 3).alias("before"), F.round(F.avg("smooth"), 3).alias("after"))


def arm_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every arm over every plane, summed up."""
    return ARMS.arm_summary(ARMS.measured(V.pixels(spark, sf), LEAST, SIDE, SIDE))


def arm_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Arms against the untouched input on three axes: lamp core, contrast and noise; and those that hold all three."""
    one = arm_metrics(spark, sf)
    base = one.filter("arm = 'none'").select(F.col("core_out").alias("b_core"), F.col("contrast").alias("b_contrast"), F.col("noise_out").alias("b_noise"))
    axes = {"core": F.col("core_out") <= F.col("b_core"), "contrast": F.col("contrast") >= F.col("b_contrast"), "noise": F.col("noise_out") <= F.col("b_noise")}
    judged = one.crossJoin(F.broadcast(base)).select("arm", *(c.alias(f"{n}_ok") for n, c in axes.items()))
    return judged.withColumn("all_ok", F.col("core_ok") & F.col("contrast_ok") & F.col("noise_ok"))


def glare_zone(spark: SparkSession, sf: str) -> DataFrame:
    """What arms make of levels from 200 up, beside the levels themselves."""
    bright = ARMS.applied(V.pixels(spark, sf)).filter("l >= 200")
    return bright.groupBy("arm").agg(F.round(F.avg("l"), 3).alias("level_in"), F.round(F.avg("o"), 3).alias("level_out"), F.count(F.lit(1)).alias("pixels"))


def extreme_spots(spark: SparkSession, sf: str) -> DataFrame:
    """Per frame the brightest spot of the blurred plane and the flattest of its dark pixels, the first in reading order where several tie."""
    px = P.around(V.pixels(spark, sf), ["frame_id"], "l", "l").withColumns({"m": F.round("l_mean", 6), "sd": F.round("l_sd", 6)})
    place = F.struct("y", "x")
    bright = F.max(F.struct("m", (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    flat = F.min(F.when(F.col("l") <= P.DARK_HIGH, F.struct("sd", place.alias("at"))))
    found = px.groupBy("frame_id").agg(bright.alias("b"), flat.alias("f"))
    return found.select("frame_id", (-F.col("b.y")).alias("bright_y"), (-F.col("b.x")).alias("bright_x"), F.round("b.m", 3).alias("bright"), F.col("f.at.y").alias("flat_y"), F.col("f.at.x").alias("flat_x"), F.round("f.sd", 3).alias("flat_sd"))


def most_saturated(spark: SparkSession, sf: str) -> DataFrame:
    """The three frames with the largest share of saturated pixels."""
    share = V.pixels(spark, sf).groupBy("frame_id").agg((100 * F.avg((F.col("l") >= P.SATURATED).cast("int"))).alias("share"))
    return share.orderBy(F.desc("share"), "frame_id").limit(3).select("frame_id", F.round("share", 4).alias("share"))


def motion_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Mean response to a Laplacian on moving pixels, of the input and of a brightened plane, and how much of it stays."""
    px = _px(spark, sf).withColumn("o", F.floor(255 * F.pow(F.col("l") / 255, F.lit(ARMS.GAMMA))))
    seen = T.pixel_pairs(P.around(P.around(px, ["recording", "frame_id"], "l", "i"), ["recording", "frame_id"], "o", "o")).filter(F.abs(F.col("l") - F.col("prev")) >= T.MOVING)
    one = seen.groupBy("recording").agg(F.avg(F.abs("i_laplace")).alias("a"), F.avg(F.abs("o_laplace")).alias("b"))
    return one.select("recording", F.round("a", 3).alias("detail_in"), F.round("b", 3).alias("detail_out"), F.round(F.try_divide("b", "a"), 3).alias("kept"))


def smoothing_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Flicker that is left after smoothing with several cutoffs, a parameter being a column."""
    f = V.frames(spark, sf)
    runs = [T.flicker(T.smoothed(f, "mean_luma", T.smoothing(c), block=64), "ema").withColumn("cutoff", F.lit(c)) for c in (0.25, 0.5, 1.0)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("recording", "cutoff", F.round("sigma", 3).alias("sigma"))


def _timings(spark: SparkSession, sf: str) -> DataFrame:
    """Arms by resolution: an event type is an arm, its events are timed frames at three sizes."""
    size = F.element_at(F.array(F.lit("720p"), F.lit("480p"), F.lit("360p")), (F.col("event_id") % 3 + 1).cast("int"))
    return V.table(spark, sf, "events").select(F.col("event_type").alias("arm"), size.alias("size"), (F.col("value") / F.element_at(F.array(*(F.lit(x) for x in (1.0, 2.0, 3.5))), (F.col("event_id") % 3 + 1).cast("int"))).alias("ms"), (F.col("user_id") % 7 + F.col("event_id") % 3).alias("core"))


def arm_size_matrix(spark: SparkSession, sf: str) -> DataFrame:
    wide = _timings(spark, sf).groupBy("arm").pivot("size", ["720p", "480p", "360p"]).agg(F.round(F.percentile("ms", 0.5), 3))
    return wide.select("arm", F.col("720p").alias("ms_720p"), F.col("480p").alias("ms_480p"), F.col("360p").alias("ms_360p"))


def gate_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.col("ms")
    med = _timings(spark, sf).groupBy("arm", "size").agg(F.round(F.percentile("ms", 0.5), 3).alias("ms"))
    return med.select("arm", "size", *(S.gate_verdict(ms, r).alias(r) for r in ("band", "double", "plain", "near")))


def event_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    s = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return e.groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly counts again, from a stream with a watermark: each window as the last batch that changed it has it."""
    out = ST.to_table(ST.windowed_counts(ST.events(spark, sf)), "update")
    last = out.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "v.n", "v.total")


def stream_ema_state(spark: SparkSession, sf: str) -> DataFrame:
    """The smoothed luma that a stream's state holds at its end."""
    out = ST.to_table(ST.smoothed(ST.events(spark, sf), T.smoothing()), "update")
    last = out.groupBy("recording").agg(F.max_by(F.struct("frames", "ema"), "batch").alias("v"))
    return last.select("recording", "v.frames", F.round("v.ema", 3).alias("ema"))


def stream_held_detection(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.to_table(ST.held(ST.events(spark, sf)), "update")
    return out.groupBy("recording").agg(F.max_by("held", "batch").alias("held"))


QUERIES = {f.__name__: f for f in (
    pixel_histogram, agcwd_curve, local_std_interior, dark_mask_stats, glare_core, saturation_rates, tone_curve_bins, gamma_match, frame_diff_flicker, hold_last_detection, detect_stride,
    flicker_amplification, static_mask_sigma, iir_smoothing, tone_smoothing, motion_denoise, motion_denoise_runs, two_path_sequence, arm_metrics, arm_axes, glare_zone, extreme_spots, most_saturated, motion_detail, smoothing_sweep, arm_size_matrix, gate_verdicts, event_tumbling, event_sessions, stream_event_counts, stream_ema_state, stream_held_detection)}

X = f"with {V.PIXELS}"
FR = f"with {V.FRAMES}"
HIST = f"{X}, c as (select recording, l::int as level, count(*) as n from v_pixels group by 1, 2), h as (select r.recording, k as level, coalesce(n, 0) as n from (select distinct recording from c) r cross join range(256) t(k) left join c on c.recording = r.recording and c.level = k)"
TM = """with t as (select event_type as arm, ['720p', '480p', '360p'][event_id % 3 + 1] as size, value / case event_id % 3 when 0 then 1.0::double when 1 then 2.0::double else 3.5::double end as ms, user_id % 7 + event_id % 3 as core from events)"""
GATE = {"band": "case when ms < 0.05 then '—' when ms <= 15 then 'OK' when ms < 25 then 'borderline' else 'fail' end", "double": "case when ms < 0.05 then '—' when ms <= 20 then 'OK' when ms <= 40 then 'borderline' else 'fail' end",
        "plain": "case when ms < 0.05 then '—' when ms <= 20 then 'OK' else 'fail' end", "near": "case when ms < 0.05 then '—' when abs(ms - 20) <= 4 then 'borderline' when ms < 20 then 'OK' else 'fail' end"}

ORACLES = {
    "pixel_histogram": f"{HIST} select * from h",
    "agcwd_curve": f"""{HIST}, p as (select *, n / sum(n) over (partition by recording) as p from h), s as (select *, min(p) over (partition by recording) as lo, max(p) over (partition by recording) as hi from p),
        w as (select *, case when hi - lo < 1e-8 then 1.0 else hi * pow((p - lo) / nullif(hi - lo, 0), 0.5) end as w from s),
        d as (select *, sum(w) over (partition by recording order by level rows unbounded preceding) / sum(w) over (partition by recording) as cdf from w)
        select recording, level, round(cdf, 5) as cdf, case when hi - lo < 1e-8 then level else floor(round(least(greatest(255 * pow(level / 255, 1 - cdf), 0), 255), 6))::int end as curve from d""",
    "local_std_interior": f"""{X}, n as (select a.frame_id, a.y, a.x, avg(b.l) as m1, avg(b.l * b.l) as m2 from v_pixels a join v_pixels b on a.frame_id = b.frame_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 where a.x between 1 and 6 and a.y between 1 and 6 group by 1, 2, 3)
        select frame_id, round(avg(sqrt(greatest(0, m2 - m1 * m1))), 3) as mean_sd, round(max(sqrt(greatest(0, m2 - m1 * m1))), 3) as max_sd from n group by 1""",
    "dark_mask_stats": f"{X}, s as (select frame_id, count(*) filter (l between 3 and 80) as n, quantile_cont(l, 0.6) as p60 from v_pixels group by 1), d as (select frame_id, l, case when n >= 16 then l between 3 and 80 else l <= p60 end as dark from v_pixels join s using (frame_id)) select frame_id, count(*) filter (dark) as dark, round(avg(l) filter (dark), 3) as dark_mean from d group by 1",
    "glare_core": f"{X} select frame_id, round(quantile_cont(l, 0.99), 3) as p99, round(100 * avg((l >= 250)::int), 4) as saturated, case when count(*) filter (l >= 235) >= 3 then round(quantile_cont(l, 0.5) filter (l >= 235), 3) end as core from v_pixels group by 1",
    "saturation_rates": f"{X} select recording, round(100 * avg((l <= 80)::int), 4) as dark, round(100 * avg((l < 3)::int), 4) as crushed, round(100 * avg((l >= 235)::int), 4) as lamp, round(100 * avg((l >= 250)::int), 4) as saturated from v_pixels group by 1",
    "tone_curve_bins": f"{X}, p as (select frame_id, floor(l * 52 / 256)::int as bin, count(*) as n, quantile_cont(floor(pow(l / 255, 0.45) * 255), 0.5) as m from v_pixels group by 1, 2) select bin, count(*) as frames, round(quantile_cont(m, 0.5), 3) as level from p where n >= 2 group by 1 having count(*) >= 3",
    "gamma_match": """with recursive p as (select vec_id as frame_id, list_transform(embedding, lambda v: least(255.0, greatest(0.0, floor((v::double + 0.3) * 425.0)))) as ls from embeddings),
        b(frame_id, ls, lo, hi, k) as (select frame_id, ls, 0.05::double, 6.0::double, 0 from p
            union all select frame_id, ls, case when dark then lo else g end, case when dark then g else hi end, k + 1 from (select *, (lo + hi) / 2 as g, list_avg(list_transform(ls, lambda v: pow(v / 255, (lo + hi) / 2) * 255)) < 120 as dark from b where k < 30))
        select frame_id, round((lo + hi) / 2, 4) as gamma from b where k = 30""",
    "frame_diff_flicker": f"{FR}, d as (select recording, mean_luma - lag(mean_luma) over (partition by recording order by seq) as d from v_frames) select recording, round(stddev_pop(d), 3) as sigma, count(d) as pairs from d group by 1",
    "hold_last_detection": f"{FR} select recording, frame_id, last_value(detection ignore nulls) over (partition by recording order by seq rows unbounded preceding) as held from v_frames",
    "detect_stride": f"{FR}, h as (select recording, last_value(case when (seq - 1) % 3 = 0 then detection end ignore nulls) over (partition by recording order by seq rows unbounded preceding) as held from v_frames) select recording, held, count(*) as frames from h group by 1, 2",
    "flicker_amplification": f"{FR}, d as (select recording, mean_luma - lag(mean_luma) over w as a, 255 * pow(mean_luma / 255, 0.45) - lag(255 * pow(mean_luma / 255, 0.45)) over w as b from v_frames window w as (partition by recording order by seq)) select recording, round(stddev_pop(b) / nullif(stddev_pop(a), 0), 3) as amplification from d group by 1",
    "static_mask_sigma": f"""{X}, q as (select *, lag(l) over (partition by recording, y, x order by frame_id) as prev from v_pixels), d as (select *, abs(l - prev) as d from q where prev is not null),
        s as (select recording, frame_id, count(*) filter (d < 6) as ns, count(*) filter (d >= 20) as nm, quantile_cont(d, 0.05) as q5, quantile_cont(d, 0.95) as q95 from d group by 1, 2),
        m as (select d.*, case when ns >= 4 then d < 6 else d <= q5 end as still, case when nm >= 4 then d >= 20 else d >= q95 end as moved from d join s using (recording, frame_id))
        select recording, round(stddev_pop(l - prev) filter (still) / sqrt(2), 3) as sigma, round(avg(still::int), 3) as static_share, round(avg(moved::int), 3) as moving_share from m group by 1""",
    "iir_smoothing": f"with recursive {V.FRAMES}, a as (select 1 - exp(-2 * pi() * 0.5 / 16) as a), r as (select recording, seq, mean_luma as ema, frame_id from v_frames where seq = 1 union all select f.recording, f.seq, a * f.mean_luma + (1 - a) * r.ema, f.frame_id from r join v_frames f on f.recording = r.recording and f.seq = r.seq + 1, a) select recording, frame_id, round(ema, 3) as ema from r",
    "arm_size_matrix": f"{TM} select arm, round(quantile_cont(ms, 0.5) filter (size = '720p'), 3) as ms_720p, round(quantile_cont(ms, 0.5) filter (size = '480p'), 3) as ms_480p, round(quantile_cont(ms, 0.5) filter (size = '360p'), 3) as ms_360p from t group by 1",
    "gate_verdicts": f"{TM}, m as (select arm, size, round(quantile_cont(ms, 0.5), 3) as ms from t group by 1, 2) select arm, size, {', '.join(f'{sql} as {k}' for k, sql in GATE.items())} from m",
    "event_tumbling": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "event_sessions": "with d as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hours then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from d) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k",
}
SIDES = "coalesce(lag({v}) over {w}, lead({v}) over {w}) + coalesce(lead({v}) over {w}, lag({v}) over {w})"
#: Adaptive gamma and one gamma, as rows of (frame_id, y, x, l, arm, o); and neighbourhoods of 3 by 3 with mirrored borders.
APPLIED = f"""{X}, hc as (select frame_id, l, count(*) as n from v_pixels group by 1, 2),
    hp as (select *, n / sum(n) over (partition by frame_id) as p, count(*) over (partition by frame_id) as k from hc),
    hs as (select *, max(p) over (partition by frame_id) as hi, case when k = 256 then min(p) over (partition by frame_id) else 0 end as lo from hp),
    hw as (select *, case when hi - lo < 1e-8 then 1.0 else hi * pow((p - lo) / nullif(hi - lo, 0), 0.5) end as w from hs),
    hd as (select *, sum(w) over (partition by frame_id order by l rows unbounded preceding) / sum(w) over (partition by frame_id) as cdf from hw),
    cv as (select frame_id, l, case when hi - lo < 1e-8 then l else floor(round(255 * pow(l / 255, 1 - cdf), 6)) end as curve from hd),
    ap as (select frame_id, y, x, l, 'none' as arm, l as o from v_pixels union all select frame_id, y, x, l, 'A2', curve from v_pixels join cv using (frame_id, l) union all select frame_id, y, x, l, 'gamma', floor(255 * pow(l / 255, 0.45)) from v_pixels)"""


def _near_sql(source: str, key: str, value: str, name: str) -> str:
    """The rows of source with what P.around() adds, as two more table expressions."""
    across, down = f"(partition by {key}, y order by x)", f"(partition by {key}, x order by y)"
    side = lambda v, w: SIDES.format(v=v, w=w)
    return f"""{source}_{name}1 as (select *, {side(value, across)} as {name}_s, {side(f'{value} * {value}', across)} as {name}_q from {source}),
    {source}_{name}2 as (select *, {side(f'({name}_s + {value})', down)} + {name}_s + {value} as {name}_m, {side(f'({name}_q + {value} * {value})', down)} + {name}_q + {value} * {value} as {name}_m2,
        {side(f'({name}_s - 2 * {value})', down)} - 2 * ({name}_s - 2 * {value}) as {name}_response, {name}_s + {side(value, down)} - 4 * {value} as {name}_laplace from {source}_{name}1),
    {source}_{name} as (select *, {name}_m / 9 as {name}_mean, sqrt(greatest(0, {name}_m2 / 9 - {name}_m / 9 * ({name}_m / 9))) as {name}_sd from {source}_{name}2)"""


SUMMED = f"""{APPLIED}, {_near_sql('ap', 'frame_id, arm', 'l', 'i')}, {_near_sql('ap_i', 'frame_id, arm', 'o', 'o')},
    ms as (select frame_id, count(*) filter (l between 3 and 80) as n, quantile_cont(l, 0.6) as p60 from v_pixels group by 1),
    md as (select a.*, case when n >= 16 then l between 3 and 80 else l <= p60 end as dark from ap_i_o a join ms using (frame_id)),
    one as (select frame_id, arm, avg(l) as mean_in, avg(o) as mean_out, 100 * avg((o >= 250)::int) as saturated, case when count(*) filter (l >= 235) >= 3 then quantile_cont(l, 0.5) filter (l >= 235) end as core_in,
        case when count(*) filter (l >= 235) >= 3 then quantile_cont(o, 0.5) filter (l >= 235) end as core_out, avg(i_sd) filter (dark) as local_in, avg(o_sd) filter (dark) as local_out,
        sum(abs(i_response)) * sqrt(pi() / 2) / 216 as noise_in, sum(abs(o_response)) * sqrt(pi() / 2) / 216 as noise_out, avg((l - o) * (l - o)) as error from md group by 1, 2),
    two as (select *, (mean_out + 1e-6) / (mean_in + 1e-6) as gain, local_out / (local_in + 1e-6) as contrast, (noise_out + 1e-6) / (noise_in + 1e-6) / ((mean_out + 1e-6) / (mean_in + 1e-6)) as amplified,
        case when error > 0 then 10 * log10(65025 / error) end as psnr from one),
    summed as (select arm, count(*) as frames, {', '.join(f'round(avg({m}), 3) as {m}' for m in ARMS.METRICS)}, round(avg(contrast) / avg(gain), 3) as contrast_over_gain from two group by 1)"""
NUMBERED = "n as (select frame_id, recording, row_number() over (partition by recording order by frame_id) as seq from (select vec_id as frame_id, label as recording from embeddings))"
MIRROR = "case when {v} < 0 then 1 when {v} > 7 then 6 else {v} end"
ORACLES |= {
    "motion_denoise": f"""with recursive {NUMBERED}, p as (select n.*, list_transform(embedding, lambda v: least(255.0, greatest(0.0, floor((v::double + 0.3) * 425.0)))) as luma from n join embeddings e on e.vec_id = n.frame_id),
        r as (select recording, seq, frame_id, luma, luma as out from p where seq = 1
            union all select p.recording, p.seq, p.frame_id, p.luma, list_transform(range(0, 64), lambda i: floor(round(greatest(0, least(255, r.out[i + 1] + least(1, greatest(0.25, 0.25 + 0.75 *
                round_even(round(list_sum(list_transform([-1, 0, 1], lambda dy: list_sum(list_transform([-1, 0, 1], lambda dx: abs(p.luma[{MIRROR.format(v='(i // 8 + dy)')} * 8 + {MIRROR.format(v='(i % 8 + dx)')} + 1] - r.out[{MIRROR.format(v='(i // 8 + dy)')} * 8 + {MIRROR.format(v='(i % 8 + dx)')} + 1]))))) / 9, 6), 0)
                / 24)) * (p.luma[i + 1] - r.out[i + 1]))), 6)))
            from r join p on p.recording is not distinct from r.recording and p.seq = r.seq + 1)
        select recording, frame_id, round(list_avg(luma), 3) as mean_in, round(list_avg(out), 3) as mean_out from r""",
    "tone_smoothing": f"""with recursive {V.PIXELS}, {NUMBERED}, g as (select *, floor(255 * pow(l / 255, 0.45)) as o from v_pixels),
        c as (select recording, frame_id, l::int as level, avg(o) as mean from g where y % 2 = 0 and x % 2 = 0 group by 1, 2, 3),
        v as (select n.recording, n.frame_id, n.seq, k as level, mean from n cross join range(256) t(k) left join c on c.frame_id = n.frame_id and c.level = k),
        w as (select *, max(case when mean is not null then level end) over (partition by frame_id order by level rows unbounded preceding) as la, min(case when mean is not null then level end) over (partition by frame_id order by level rows between current row and unbounded following) as lb from v),
        u as (select w.recording, w.frame_id, w.seq, w.level, coalesce(a.mean + (b.mean - a.mean) * (w.level - la) / nullif(lb - la, 0), a.mean, b.mean) as curve from w left join c a on a.frame_id = w.frame_id and a.level = la left join c b on b.frame_id = w.frame_id and b.level = lb),
        r as (select recording, seq, level, frame_id, curve, curve as ema from u where seq = 1
            union all select u.recording, u.seq, u.level, u.frame_id, u.curve, (1 - exp(-2 * pi() * 0.5 / 16)) * u.curve + exp(-2 * pi() * 0.5 / 16) * r.ema from r join u on u.recording is not distinct from r.recording and u.seq = r.seq + 1 and u.level = r.level)
        select g.recording, g.frame_id, round(avg(o), 3) as before, round(avg(least(255, round_even(round(o * case when seq = 1 then 1 else least(2, greatest(0.5, ema / greatest(curve, 1))) end, 6), 0))), 3) as after
        from g join r on r.frame_id = g.frame_id and r.level = g.l group by 1, 2""",
    "arm_metrics": f"{SUMMED} select * from summed",
    "arm_axes": f"{SUMMED} select s.arm, s.core_out <= b.core_out as core_ok, s.contrast >= b.contrast as contrast_ok, s.noise_out <= b.noise_out as noise_ok, s.core_out <= b.core_out and s.contrast >= b.contrast and s.noise_out <= b.noise_out as all_ok from summed s, (select * from summed where arm = 'none') b",
    "glare_zone": f"{APPLIED} select arm, round(avg(l), 3) as level_in, round(avg(o), 3) as level_out, count(*) as pixels from ap where l >= 200 group by 1",
    "extreme_spots": f"""{X}, {_near_sql('v_pixels', 'frame_id', 'l', 'i')}, r as (select *, round(i_mean, 6) as m, round(i_sd, 6) as sd from v_pixels_i),
        b as (select frame_id, y as bright_y, x as bright_x, round(m, 3) as bright from r qualify row_number() over (partition by frame_id order by m desc, y, x) = 1),
        f as (select frame_id, y as flat_y, x as flat_x, round(sd, 3) as flat_sd from r where l <= 80 qualify row_number() over (partition by frame_id order by sd, y, x) = 1) select * from b left join f using (frame_id)""",
    "most_saturated": f"{X} select frame_id, round(100 * avg((l >= 250)::int), 4) as share from v_pixels group by 1 order by avg((l >= 250)::int) desc, frame_id limit 3",
    "motion_detail": f"""{X}, g as (select *, floor(255 * pow(l / 255, 0.45)) as o from v_pixels), {_near_sql('g', 'recording, frame_id', 'l', 'i')}, {_near_sql('g_i', 'recording, frame_id', 'o', 'o')},
        q as (select *, lag(l) over (partition by recording, y, x order by frame_id) as prev from g_i_o)
        select recording, round(avg(abs(i_laplace)), 3) as detail_in, round(avg(abs(o_laplace)), 3) as detail_out, round(avg(abs(o_laplace)) / nullif(avg(abs(i_laplace)), 0), 3) as kept from q where abs(l - prev) >= 20 group by 1""",
    "smoothing_sweep": f"""with recursive {V.FRAMES}, c as (select unnest([0.25::double, 0.5, 1.0]) as cutoff), a as (select cutoff, 1 - exp(-2 * pi() * cutoff / 16) as a from c),
        r as (select recording, seq, cutoff, mean_luma as ema from v_frames, c where seq = 1 union all select f.recording, f.seq, r.cutoff, a.a * f.mean_luma + (1 - a.a) * r.ema from r join v_frames f on f.recording = r.recording and f.seq = r.seq + 1 join a on a.cutoff = r.cutoff),
        d as (select recording, cutoff, ema - lag(ema) over (partition by recording, cutoff order by seq) as d from r) select recording, cutoff, round(stddev_pop(d), 3) as sigma from d group by 1, 2""",
    "stream_event_counts": ORACLES["event_tumbling"],
    "stream_ema_state": ORACLES["iir_smoothing"].replace("select recording, frame_id, round(ema, 3) as ema from r", "select recording, max(seq) as frames, round(arg_max(ema, seq), 3) as ema from r group by 1"),
    "stream_held_detection": f"{FR} select recording, arg_max(detection, seq) filter (detection is not null) as held from v_frames group by 1",
}
ORACLES |= {
    "motion_denoise_runs": ORACLES["motion_denoise"].replace(NUMBERED, """g as (select vec_id as frame_id, label, case when vec_id - lag(vec_id) over (partition by label order by vec_id) <= 25 then 0 else 1 end as fresh from embeddings),
        w as (select frame_id, {'recording': label, 'run': (sum(fresh) over (partition by label order by frame_id))::int} as recording from g),
        n as (select *, row_number() over (partition by recording order by frame_id) as seq from w)""").replace("select recording, frame_id, round(list_avg(luma)", "select recording.recording as recording, recording.run as run, frame_id, round(list_avg(luma)"),
    "two_path_sequence": f"""with recursive {V.FRAMES}, g as (select *, case when epoch(ts)::bigint - lag(epoch(ts)::bigint) over (partition by recording order by ts, frame_id) <= 21600 then 0 else 1 end as fresh from v_frames),
        w as (select recording, frame_id, ts, mean_luma, detection, (sum(fresh) over (partition by recording order by ts, frame_id rows unbounded preceding))::int as run from g),
        n as (select *, row_number() over (partition by recording, run order by ts, frame_id) as nr from w),
        a as (select 1 - exp(-2 * pi() * 0.5 / 16) as a),
        e as (select recording, run, nr, frame_id, mean_luma as ema from n where nr = 1 union all select n.recording, n.run, n.nr, n.frame_id, a * n.mean_luma + (1 - a) * e.ema from e join n on n.recording = e.recording and n.run = e.run and n.nr = e.nr + 1, a),
        h as (select frame_id, last_value(case when (nr - 1) % 3 = 0 then detection end ignore nulls) over (partition by recording, run order by nr rows unbounded preceding) as held from n)
        select recording, run, frame_id, nr::int as seq, round(ema, 3) as shown, held from e join h using (frame_id)""",
}
