"""Queries that hold predictions against annotations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import geometry as G
from lumenlake.functions import stats as S
from lumenlake.operators import annotations as A
from lumenlake.operators import detection as D
from lumenlake.operators import segments as L
from lumenlake.plans import views as V


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    boxes = A.with_clamped(V.boxes(spark, sf)).filter(G.larger_than(G.cols(D.BOX), 1))
    return boxes.select("image_id", F.col("box_no").alias("gt"), F.when(F.col("category_id") == 1, 1).otherwise(2).alias("cls"), *D.BOX)


def _preds(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by number; equal ones go by their line, which is at hand where truths are numbered from the same shuffle."""
    p = V.preds(spark, sf, "box_no")
    return p.withColumn("pred", F.row_number().over(W.partitionBy("image_id").orderBy("x1", "y1", "x2", "y2", "conf", "cls", "box_no"))).drop("box_no")


def _matches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    truth, preds = _truth(spark, sf), _preds(spark, sf)
    return truth, preds, D.greedy_matches(D.overlaps(truth, preds, D.MATCH))


def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = D.overlaps(_truth(spark, sf), _preds(spark, sf), D.NEAR)
    return found.groupBy("cls", F.floor(F.col("iou") * 10).cast("long").alias("tenth")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("iou"), 4).alias("mean_iou"))


def nearest_box_parity(spark: SparkSession, sf: str) -> DataFrame:
    truth, preds = _truth(spark, sf), _preds(spark, sf)
    a = truth.select("image_id", F.col("gt").alias("box"), F.lit(0.5).alias("conf"), *D.BOX)
    b = preds.select("image_id", F.col("pred").alias("box"), "conf", *D.BOX)
    na, nb = (x.groupBy("image_id").agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "na"), (b, "nb")))
    same = na.join(nb, "image_id", "full_outer").na.fill(0).withColumn("same", F.col("na") == F.col("nb"))
    near = D.nearest(a, b).join(same.filter("same"), "image_id", "left_semi")
    one = near.agg(F.max("distance").alias("max_distance"), F.round(F.max("conf_diff"), 4).alias("max_conf"), F.count(F.lit(1)).alias("boxes"))
    return one.crossJoin(F.broadcast(same.agg(F.count_if(~F.col("same")).alias("mismatched")))).withColumn("passed", (F.col("mismatched") == 0) & (F.col("max_distance") < 1) & (F.col("max_conf") < 0.01))


def fp_rate_by_image(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    images = V.table(spark, sf, "orders").select(key.alias("image_id"), F.when(key % 6 == 5, "none").otherwise((34 + key % 6).cast("string")).alias("recording"))
    rate = D.fp_rate(images, V.preds(spark, sf), ["recording"], (F.col("conf") >= D.CONF) & (F.col("cls") == 2))
    return rate.withColumn("rate", F.round(F.col("fired") / F.col("images"), 5))


def max_conf_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Share of images whose greatest confidence reaches each of 40 thresholds, from one histogram over confidences."""
    top = V.preds(spark, sf).filter("cls = 2").groupBy("image_id").agg(F.max("conf").alias("c"))
    images = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    per = images.join(top, "image_id", "left").groupBy(F.coalesce("c", F.lit(0.0)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    steps = spark.range(40).select(F.round(0.01 + F.col("id") * 0.59 / 39, 4).alias("threshold"))
    return per.crossJoin(F.broadcast(steps)).groupBy("threshold").agg(F.round(F.sum(F.when(F.col("c") >= F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n"), 5).alias("share"))


def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf)[2].select("image_id", "gt", "pred", "cls", F.round("conf", 3).alias("conf"))


def width_bin_recall(spark: SparkSession, sf: str) -> DataFrame:
    truth, _, matches = _matches(spark, sf)
    won = matches.filter(F.col("conf") >= D.CONF).select("image_id", "gt", F.lit(True).alias("won"))
    scaled = (F.col("x2") - F.col("x1")) * 640 / V.WIDTH
    return truth.join(won, ["image_id", "gt"], "left").groupBy("cls", S.width_bin(scaled).alias("width_bin")).agg(
        F.count(F.lit(1)).alias("gt"), F.count_if("won").alias("matched"), F.round(F.avg(F.coalesce("won", F.lit(False)).cast("int")), 4).alias("recall"))


def conf_sweep(spark: SparkSession, sf: str) -> DataFrame:
    truth, preds, matches = _matches(spark, sf)
    return D.conf_sweep(truth, preds, matches, V.table(spark, sf, "orders").count())


def fn_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    truth, preds = _truth(spark, sf), _preds(spark, sf)
    pairs = D.overlaps(truth, preds, 1e-9)
    lost = D.missed(truth, preds, D.greedy_matches(pairs.where(F.col("iou") >= D.MATCH)), pairs=pairs)
    return lost.groupBy("cls", "reason", S.width_bin((F.col("x2") - F.col("x1")) * 640 / V.WIDTH).alias("width_bin")).agg(F.count(F.lit(1)).alias("n"))


def fp_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    truth, preds, matches = _matches(spark, sf)
    return D.false_alarms(truth, preds, matches.filter(F.col("conf") >= D.CONF)).groupBy("cls", "reason").agg(F.count(F.lit(1)).alias("n"))


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return D.average_precision(*_matches(spark, sf)).select("cls", F.round("ap", 5).alias("ap"))


def mean_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    truth, preds = _truth(spark, sf), _preds(spark, sf)
    return D.mean_average_precision(truth, preds, D.overlaps(truth, preds, D.TEN[0])).select("cls", *(F.round(c, 5).alias(c) for c in ("map50_95", "map50", "precision", "recall")))


def segment_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Lower edges of boxes as segments, rising by an eighth of the box; predicted ones rise by their class."""
    x1, y1, x2, y2 = (F.col(c) for c in D.BOX)
    truth = _truth(spark, sf).select("image_id", "gt", x1.alias("x1"), y2.alias("y1"), x2.alias("x2"), (y2 - (y2 - y1) / 8).alias("y2"))
    found = _preds(spark, sf).where(x2 > x1).select("image_id", "pred", x1.alias("x1"), y2.alias("y1"), x2.alias("x2"), (y2 - (y2 - y1) * F.col("cls") / 16).alias("y2"))
    m = L.segment_matches(L.segment_pairs(truth, found))
    return m.select("image_id", "gt", "pred", F.round("overlap", 3).alias("overlap"), F.round("y_error", 3).alias("y_error"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Six detectors: predictions of an image belong to the run that its order's key names."""
    hits = D.overlaps(_truth(spark, sf), _preds(spark, sf).filter(F.col("conf") >= D.CONF), D.NEAR)
    best = hits.groupBy("image_id", "gt", F.col("gt_cls").alias("cls")).agg(F.max("iou").alias("iou"))
    run = F.concat(F.lit("run"), (F.col("image_id") % 6).cast("string"))
    return best.select(run.alias("run"), F.concat(F.lit("c"), F.col("cls").cast("string"), F.when(F.col("iou") >= D.MATCH, "_hit").otherwise("_near")).alias("kind"))


KINDS = ["c1_hit", "c1_near", "c2_hit", "c2_near"]


def benchmark_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).groupBy("run").pivot("kind", KINDS).agg(F.count(F.lit(1))).na.fill(0)


def baseline_deltas(spark: SparkSession, sf: str) -> DataFrame:
    wide = benchmark_pivot(spark, sf).withColumn("hit_rate", F.round((F.col("c1_hit") + F.col("c2_hit")) / sum(F.col(k) for k in KINDS), 4))
    return D.with_baseline(wide, "run", "run0", ["hit_rate", "c1_hit"]).select("run", "hit_rate", "d_hit_rate", "d_c1_hit")


def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A run passes when its person recall stays at the baseline's, and so does its rate of images on which the other class fires."""
    persons = benchmark_pivot(spark, sf).select("run", F.round(F.col("c1_hit") / (F.col("c1_hit") + F.col("c1_near")), 3).alias("recall"))
    images = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.concat(F.lit("run"), (F.col("o_orderkey") % 6).cast("string")).alias("run"))
    fired = D.fp_rate(images, V.preds(spark, sf), ["run"], (F.col("conf") >= D.CONF) & (F.col("cls") == 2)).select("run", F.round(100 * F.col("fired") / F.col("images"), 1).alias("fp_rate"))
    base = D.with_baseline(persons.join(fired, "run"), "run", "run0", ["recall", "fp_rate"])
    return base.select("run", "recall", "fp_rate", "d_recall", "d_fp_rate", ((F.col("d_recall") >= 0) & (F.col("d_fp_rate") <= 0)).alias("passed"))


QUERIES = {f.__name__: f for f in (
    iou_pairs, nearest_box_parity, fp_rate_by_image, max_conf_curve, greedy_match, width_bin_recall, conf_sweep, fn_taxonomy, fp_taxonomy, average_precision, mean_average_precision, segment_matching, benchmark_pivot, baseline_deltas, regression_gate)}

T = f"""with recursive {V.BOXES}, {V.PREDS},
gt as (select image_id, box_no as gt, case category_id when 1 then 1 else 2 end as cls, x1, y1, x2, y2 from v_clamped where x2 - x1 > 1 and y2 - y1 > 1),
p as (select *, row_number() over (partition by image_id order by x1, y1, x2, y2, conf, cls) as pred from (select image_id, x1, y1, x1 + bw as x2, y1 + bh as y2, conf, cls from v_preds)),
o as (select g.image_id, gt, pred, g.cls as gt_cls, p.cls, conf, greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) as both_,
    (g.x2 - g.x1) * (g.y2 - g.y1) as ag, greatest(p.x2 - p.x1, 0) * greatest(p.y2 - p.y1, 0) as ap, g.x2 - g.x1 as w from gt g join p using (image_id)),
u as (select *, coalesce(both_ / nullif(ag + ap - both_, 0), 0) as iou from o)"""
M = f"""{T},
q as (select image_id, gt, pred, cls, conf, row_number() over (partition by image_id order by conf desc, pred, iou desc, gt) as k from u where gt_cls = cls and iou >= 0.5),
r(image_id, k, gts, ps) as (select distinct image_id, 0::bigint, []::bigint[], []::bigint[] from q
    union all select q.image_id, q.k, case when list_contains(gts, q.gt) or list_contains(ps, q.pred) then gts else list_append(gts, q.gt) end, case when list_contains(gts, q.gt) or list_contains(ps, q.pred) then ps else list_append(ps, q.pred) end
    from r join q on q.image_id = r.image_id and q.k = r.k + 1),
l as (select image_id, arg_max(gts, k) as gts, arg_max(ps, k) as ps from r group by 1),
m0 as (select image_id, unnest(gts) as gt, unnest(ps) as pred from l),
m as (select m0.*, p.cls, p.conf from m0 join p using (image_id, pred))"""
BIN = "case when {w} < 4 then '<4px' when {w} < 8 then '4~8px' when {w} < 16 then '8~16px' else '>16px' end".format(w="(x2 - x1) * 640 / 1920")
PIV = f"""{T}, b as (select image_id, gt, gt_cls, max(iou) as iou from u where gt_cls = cls and conf >= 0.25 and iou >= 0.3 group by 1, 2, 3),
k as (select 'run' || (image_id % 6) as run, 'c' || gt_cls || case when iou >= 0.5 then '_hit' else '_near' end as kind from b),
w as (select run, {', '.join(f"count(*) filter (kind = '{x}') as {x}" for x in KINDS)} from k group by 1),
h as (select *, round((c1_hit + c2_hit) / (c1_hit + c1_near + c2_hit + c2_near), 4) as hit_rate from w)"""

ORACLES = {
    "iou_pairs": f"{T} select cls, cast(floor(iou * 10) as bigint) as tenth, count(*) as pairs, round(avg(iou), 4) as mean_iou from u where gt_cls = cls and iou >= 0.3 group by 1, 2",
    "nearest_box_parity": f"""{T}, n as (select coalesce(a.image_id, b.image_id) as image_id, coalesce(na, 0) = coalesce(nb, 0) as same from (select image_id, count(*) as na from gt group by 1) a full join (select image_id, count(*) as nb from p group by 1) b on a.image_id = b.image_id),
        d as (select image_id, gt, abs(g.x1 - p.x1) + abs(g.y1 - p.y1) + abs(g.x2 - p.x2) + abs(g.y2 - p.y2) as distance, abs(0.5 - conf) as cd, pred from gt g join p using (image_id) where image_id in (select image_id from n where same)),
        f as (select * from d qualify row_number() over (partition by image_id, gt order by distance, cd, pred) = 1)
        select max(distance) as max_distance, round(max(cd), 4) as max_conf, count(*) as boxes, any_value(z.mm) as mismatched, any_value(z.mm) = 0 and max(distance) < 1 and round(max(cd), 4) < 0.01 as passed from f, (select count(*) as mm from n where not same) z""",
    "fp_rate_by_image": f"with {V.PREDS}, n as (select image_id, count(*) as n from v_preds where conf >= 0.25 and cls = 2 group by 1), i as (select o_orderkey as image_id, case when o_orderkey % 6 = 5 then 'none' else cast(34 + o_orderkey % 6 as varchar) end as recording from orders) select recording, count(*) as images, count(n) as fired, coalesce(sum(n), 0) as boxes, round(count(n) / count(*), 5) as rate from i left join n using (image_id) group by 1",
    "max_conf_curve": f"with {V.PREDS}, t as (select image_id, max(conf) as c from v_preds where cls = 2 group by 1), i as (select coalesce(c, 0) as c from orders left join t on image_id = o_orderkey), s as (select round(0.01::double + k * 0.59::double / 39, 4) as threshold from range(40) x(k)) select threshold, round(avg((c >= threshold)::int), 5) as share from i, s group by 1",
    "greedy_match": f"{M} select image_id, gt, pred, cls, round(conf, 3) as conf from m",
    "width_bin_recall": f"{M} select gt.cls, {BIN} as width_bin, count(*) as gt, count(m.gt) as matched, round(count(m.gt) / count(*), 4) as recall from gt left join m on m.image_id = gt.image_id and m.gt = gt.gt and m.conf >= 0.25 group by 1, 2",
    "conf_sweep": f"{M}, s as (select unnest([0.25, 0.1, 0.05, 0.01]::double[]) as t), a as (select cls, count(*) as n from gt group by 1), b as (select t, cls, count(*) as tp from m, s where conf >= t group by 1, 2), c as (select t, cls, count(*) as made from p, s where conf >= t group by 1, 2) select t as conf, cls, n as gt, coalesce(tp, 0) as tp, round(coalesce(tp, 0) / n, 4) as recall, coalesce(made, 0) - coalesce(tp, 0) as fp, round((coalesce(made, 0) - coalesce(tp, 0)) / (select count(*) from orders), 4) as fp_per_image from (select * from a, s) left join b using (t, cls) left join c using (t, cls)",
    "fn_taxonomy": f"""{M}, v as (select * from m where conf >= 0.25), lost as (select gt.* from gt anti join v on v.image_id = gt.image_id and v.gt = gt.gt),
        n as (select u.image_id, u.gt, u.iou, u.conf, u.pred, v.pred is not null as taken from u left join v on v.image_id = u.image_id and v.pred = u.pred where u.gt_cls = u.cls and u.iou >= 1e-9),
        s as (select image_id, gt, max(iou) filter (conf >= 0.25) as iou, max(iou) filter (conf < 0.25) as low from n group by 1, 2),
        t as (select image_id, gt, taken from n where conf >= 0.25 qualify row_number() over (partition by image_id, gt order by iou desc, pred) = 1)
        select cls, case when s.iou >= 0.3 and s.iou < 0.5 then 'nearmiss' when low >= 0.5 then 'lowconf' when taken then 'merged' else 'blind' end as reason, {BIN} as width_bin, count(*) as n from lost left join s using (image_id, gt) left join t using (image_id, gt) group by 1, 2, 3""",
    "fp_taxonomy": f"""{M}, lost as (select * from p where conf >= 0.25 and not exists (select 1 from m where m.image_id = p.image_id and m.pred = p.pred)),
        s as (select image_id, pred, max(iou) filter (gt_cls = cls) as own, max(iou) filter (gt_cls <> cls) as other from u where iou >= 0.3 group by 1, 2)
        select cls, case when own >= 0.5 then 'dup' when own >= 0.3 then 'nearmiss' when other >= 0.3 then 'confusion' else 'ghost' end as reason, count(*) as n from lost left join s using (image_id, pred) group by 1, 2""",
    "average_precision": f"""{M}, h as (select p.cls, p.conf, count(*) as n, count(m.pred) as tp from p left join m on m.image_id = p.image_id and m.pred = p.pred group by 1, 2),
        c as (select cls, conf, sum(tp) over w as tp, sum(n) over w as made from h window w as (partition by cls order by conf desc rows unbounded preceding)), g as (select cls, count(*) as gt from gt group by 1),
        e as (select cls, tp / gt as recall, tp / made as prec from c join g using (cls)), b as (select cls, level, max(prec) as p from e, range(101) x(level) where level <= floor(recall * 100) group by 1, 2) select cls, round(sum(p) / 101, 5) as ap from b group by 1""",
    "benchmark_pivot": f"{PIV} select * from w",
    "baseline_deltas": f"{PIV} select h.run, h.hit_rate, round(h.hit_rate - z.hit_rate, 4) as d_hit_rate, h.c1_hit - z.c1_hit as d_c1_hit from h, (select * from h where run = 'run0') z",
    "regression_gate": f"""{PIV}, pr as (select run, round(c1_hit / (c1_hit + c1_near), 3) as recall from w),
        fr as (select 'run' || (o_orderkey % 6) as run, round(100 * count(*) filter (o_orderkey in (select image_id from p where conf >= 0.25 and cls = 2)) / count(*), 1) as fp_rate from orders group by 1),
        bs as (select * from pr join fr using (run)), z as (select recall, fp_rate from bs where run = 'run0')
        select bs.run, bs.recall, bs.fp_rate, round(bs.recall - z.recall, 4) as d_recall, round(bs.fp_rate - z.fp_rate, 4) as d_fp_rate, round(bs.recall - z.recall, 4) >= 0 and round(bs.fp_rate - z.fp_rate, 4) <= 0 as passed from bs, z""",
    "mean_average_precision": f"""{T}, th as (select unnest({list(D.TEN)}::double[]) as t),
        q as (select t, image_id, gt, pred, cls, conf, row_number() over (partition by t, image_id order by conf desc, pred, iou desc, gt) as k from u, th where gt_cls = cls and iou >= t),
        r(t, image_id, k, gts, ps) as (select distinct t, image_id, 0::bigint, []::bigint[], []::bigint[] from q
            union all select q.t, q.image_id, q.k, case when list_contains(gts, q.gt) or list_contains(ps, q.pred) then gts else list_append(gts, q.gt) end, case when list_contains(gts, q.gt) or list_contains(ps, q.pred) then ps else list_append(ps, q.pred) end
            from r join q on q.t = r.t and q.image_id = r.image_id and q.k = r.k + 1),
        l as (select t, image_id, arg_max(ps, k) as ps from r group by 1, 2), m as (select t, image_id, unnest(ps) as pred from l),
        h as (select th.t, p.cls, p.conf, count(*) as n, count(m.pred) as tp from p cross join th left join m on m.t = th.t and m.image_id = p.image_id and m.pred = p.pred group by 1, 2, 3),
        c as (select t, cls, conf, sum(tp) over w as tp, sum(n) over w as made from h window w as (partition by t, cls order by conf desc rows unbounded preceding)), g as (select cls, count(*) as gt from gt group by 1),
        e as (select t, cls, conf, tp / gt as recall, tp / made as prec from c join g using (cls)),
        b as (select t, cls, level, max(prec) as p from e, range(101) x(level) where level <= floor(recall * 100) group by 1, 2, 3), ap as (select t, cls, sum(p) / 101 as ap from b group by 1, 2),
        f as (select cls, prec, recall, row_number() over (partition by cls order by round(2 * prec * recall / (prec + recall), 9) desc, conf desc) as k from e where t = 0.5 and recall > 0)
        select g.cls, round(coalesce(sum(ap) / 10, 0), 5) as map50_95, round(coalesce(max(ap) filter (t = 0.5), 0), 5) as map50, round(any_value(f.prec), 5) as precision, round(any_value(f.recall), 5) as recall
        from g left join ap using (cls) left join f on f.cls = g.cls and f.k = 1 group by 1""",
    "segment_matching": f"""{T}, sa as (select image_id, gt, x1, x2, y2 as ya, y2 - (y2 - y1) / 8 as yb from gt), sb as (select image_id, pred, x1, x2, y2 as ya, y2 - (y2 - y1) * cls / 16 as yb from p where x2 > x1),
        d as (select image_id, gt, pred, least(a.x2, b.x2) - greatest(a.x1, b.x1) as ov, abs((a.ya + a.yb) / 2 - (b.ya + b.yb) / 2) as err, abs(degrees(atan2(a.yb - a.ya, a.x2 - a.x1)) - degrees(atan2(b.yb - b.ya, b.x2 - b.x1))) as turn from sa a join sb b using (image_id)),
        q as (select *, row_number() over (partition by image_id order by ov desc, pred, err, gt) as k from d where ov >= 30 and err <= 10 and least(turn, 180 - turn) <= 15),
        r(image_id, k, gts, ps) as (select distinct image_id, 0::bigint, []::bigint[], []::bigint[] from q
            union all select q.image_id, q.k, case when list_contains(gts, q.gt) or list_contains(ps, q.pred) then gts else list_append(gts, q.gt) end, case when list_contains(gts, q.gt) or list_contains(ps, q.pred) then ps else list_append(ps, q.pred) end
            from r join q on q.image_id = r.image_id and q.k = r.k + 1),
        l as (select image_id, arg_max(gts, k) as gts, arg_max(ps, k) as ps from r group by 1), m as (select image_id, unnest(gts) as gt, unnest(ps) as pred from l)
        select image_id, gt, pred, round(ov, 3) as overlap, round(err, 3) as y_error from m join d using (image_id, gt, pred)""",
}
