"""Queries on boxes: normalisation, filters, suppression, overlaps and quality."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from framelode.functions import geometry as geo
from framelode.operators import filters, nms
from framelode.sources import adapters as src

from .registry import query

B = src.BOXES
POLICY = json.dumps({"default": {"score_min": 0.35}, "classes": {"A": {"score_min": 0.5}, "R": {"min_score": 0.2}}})


@query("score_policy_filter", f"""
WITH {B} SELECT frame, idx, label, score FROM boxes WHERE score >= CASE label WHEN 'A' THEN 0.5 WHEN 'R' THEN 0.2 ELSE 0.35 END""")
def score_policy_filter(spark, sf_dir):
    return filters.score_policy(src.boxes(spark, sf_dir), filters.load_score_policy(POLICY)).select("frame", "idx", "label", "score")


@query("default_score_filter", f"WITH {B} SELECT frame, count(*) AS n FROM boxes WHERE score >= 0.35 GROUP BY frame")
def default_score_filter(spark, sf_dir):
    return filters.score_policy(src.boxes(spark, sf_dir), {"default": filters.DEFAULT_SCORE, "classes": {}}).groupBy("frame").agg(F.count("*").alias("n"))


@query("box_canonical", f"""
WITH {B}, f AS (SELECT frame, idx, CASE WHEN idx % 2 = 1 THEN x2 ELSE x1 END AS x1, y1, CASE WHEN idx % 2 = 1 THEN x1 ELSE x2 END AS x2, y2 FROM boxes)
SELECT frame, idx, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2 FROM f""")
def box_canonical(spark, sf_dir):
    odd = F.col("idx") % 2 == 1
    b = src.boxes(spark, sf_dir).select("frame", "idx", F.when(odd, F.col("x2")).otherwise(F.col("x1")).alias("a"), "y1", F.when(odd, F.col("x1")).otherwise(F.col("x2")).alias("b"), "y2")
    return b.select("frame", "idx", *geo.canonical_box(F.col("a"), F.col("y1"), F.col("b"), F.col("y2")))


@query("box_filter_chain", f"""
WITH {B} SELECT frame, idx FROM boxes WHERE score >= 0.4 AND label IN ('A', 'N') AND (x2 - x1) * (y2 - y1) <= 640 * 480 * 0.01""")
def box_filter_chain(spark, sf_dir):
    return filters.box_chain(src.boxes(spark, sf_dir), 0.4, ["A", "N"], 640 * 480, 0.01).select("frame", "idx")


@query("detection_normalise", f"""
WITH {B} SELECT frame, idx, CASE WHEN idx % 3 = 0 THEN 'unknown' ELSE label END AS class_name, label, x1, y1, x2 - x1 AS w, y2 - y1 AS h FROM boxes""")
def detection_normalise(spark, sf_dir):
    b = src.boxes(spark, sf_dir)
    raw = b.select(F.col("frame").alias("frame_idx"), F.struct(
        F.col("idx").alias("source_detection_id"), F.when(F.col("idx") % 3 == 0, F.lit("  ")).otherwise(F.col("label")).alias("class_name"), "label",
        F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), F.col("score").alias("cls_score"),
    ).alias("d")).groupBy("frame_idx").agg(F.collect_list("d").alias("instances"))
    n = filters.normalise_records(raw)
    box = F.col("bbox_xyxy")
    return n.select("frame", F.col("source_detection_id").alias("idx"), "class_name", "label", box[0].alias("x1"), box[1].alias("y1"), (box[2] - box[0]).alias("w"), (box[3] - box[1]).alias("h"))


@query("detection_summary", f"""
WITH {B} SELECT count(*) AS detections, count(DISTINCT frame) AS frames, count(DISTINCT label) AS labels, min(x2 - x1) AS min_width, max(x2 - x1) AS max_width,
  min(y2 - y1) AS min_height, max(y2 - y1) AS max_height, (SELECT count(*) FROM orders) - count(DISTINCT CASE WHEN frame IN (SELECT o_orderkey FROM orders) THEN frame END) AS empty_frames FROM boxes""")
def detection_summary(spark, sf_dir):
    b = src.boxes(spark, sf_dir)
    s = b.agg(F.count("*").alias("detections"), F.countDistinct("frame").alias("frames"), F.countDistinct("label").alias("labels"), F.min(F.expr("x2 - x1")).alias("min_width"), F.max(F.expr("x2 - x1")).alias("max_width"), F.min(F.expr("y2 - y1")).alias("min_height"), F.max(F.expr("y2 - y1")).alias("max_height"))
    o = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"))
    return s.crossJoin(o.join(b, "frame", "left_anti").agg(F.count("*").alias("empty_frames")))


@query("frame_complete_scan", f"""
WITH {B} SELECT o.o_orderkey AS frame, count(b.idx) AS detections FROM orders o LEFT JOIN boxes b ON b.frame = o.o_orderkey GROUP BY o.o_orderkey""")
def frame_complete_scan(spark, sf_dir):
    f = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"))
    return filters.complete_frames(f, src.boxes(spark, sf_dir)).groupBy("frame").agg(F.count("idx").alias("detections"))


@query("overlap_pairs", f"""
WITH {B}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, idx) AS p FROM boxes),
q AS (SELECT a.frame, a.idx AS a, b.idx AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS bb FROM r a JOIN r b ON a.frame = b.frame AND a.p < b.p)
SELECT frame, a, b, round(i / (aa + bb - i), 9) AS iou FROM q WHERE i > 0""")
def overlap_pairs(spark, sf_dir):
    return nms.overlapping_pairs(src.boxes(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


@query("box_nms", f"""
WITH RECURSIVE {B}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, idx) AS p, (x2 - x1) * (y2 - y1) AS area FROM boxes),
pr AS (
  SELECT a.frame, a.p AS ap, b.p AS bp, least(a.area, b.area) AS lo, greatest(a.area, b.area) AS hi,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, a.area + b.area AS s,
    (a.x1 - 2 <= b.x1 AND a.y1 - 2 <= b.y1 AND a.x2 + 2 >= b.x2 AND a.y2 + 2 >= b.y2) OR (b.x1 - 2 <= a.x1 AND b.y1 - 2 <= a.y1 AND b.x2 + 2 >= a.x2 AND b.y2 + 2 >= a.y2) AS inside
  FROM r a JOIN r b ON a.frame = b.frame AND a.p < b.p),
clash AS (SELECT frame, ap, bp FROM pr WHERE (inside AND hi <= lo * CASE WHEN lo <= 5000 THEN 5 ELSE 8 END) OR i / (s - i) >= CASE WHEN lo <= 2000 THEN 0.05 WHEN lo <= 5000 THEN 0.10 ELSE 0.20 END),
w AS (
  SELECT frame, 1 AS p, [CAST(1 AS BIGINT)] AS kept FROM (SELECT DISTINCT frame FROM r)
  UNION ALL
  SELECT w.frame, w.p + 1, CASE WHEN EXISTS (SELECT 1 FROM clash c WHERE c.frame = w.frame AND c.bp = w.p + 1 AND list_contains(w.kept, c.ap)) THEN w.kept ELSE list_append(w.kept, CAST(w.p + 1 AS BIGINT)) END
  FROM w WHERE EXISTS (SELECT 1 FROM r WHERE r.frame = w.frame AND r.p = w.p + 1)),
z AS (SELECT frame, arg_max(kept, p) AS kept FROM w GROUP BY frame)
SELECT r.frame, r.idx, r.label, r.score FROM r JOIN z ON r.frame = z.frame AND list_contains(z.kept, r.p)""")
def box_nms(spark, sf_dir):
    return nms.box_nms(src.boxes(spark, sf_dir), ["frame"]).select("frame", "idx", "label", "score")


@query("class_nms_top_k", f"""
WITH RECURSIVE {B}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, idx) AS p, (x2 - x1) * (y2 - y1) AS area FROM boxes),
pr AS (SELECT a.frame, a.label, a.p AS ap, b.p AS bp, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, a.area + b.area AS s
  FROM r a JOIN r b ON a.frame = b.frame AND a.label = b.label AND a.p < b.p),
clash AS (SELECT frame, label, ap, bp FROM pr WHERE i / (s - i) > 0.3),
w AS (
  SELECT frame, label, 1 AS p, [CAST(1 AS BIGINT)] AS kept FROM (SELECT DISTINCT frame, label FROM r)
  UNION ALL
  SELECT w.frame, w.label, w.p + 1, CASE WHEN EXISTS (SELECT 1 FROM clash c WHERE c.frame = w.frame AND c.label = w.label AND c.bp = w.p + 1 AND list_contains(w.kept, c.ap)) THEN w.kept ELSE list_append(w.kept, CAST(w.p + 1 AS BIGINT)) END
  FROM w WHERE EXISTS (SELECT 1 FROM r WHERE r.frame = w.frame AND r.label = w.label AND r.p = w.p + 1)),
z AS (SELECT frame, label, arg_max(kept, p) AS kept FROM w GROUP BY frame, label),
k AS (SELECT r.frame, r.idx, r.label, row_number() OVER (PARTITION BY r.frame ORDER BY r.score DESC, r.idx) AS place FROM r JOIN z ON r.frame = z.frame AND r.label = z.label AND list_contains(z.kept, r.p))
SELECT * FROM k WHERE place <= 3""")
def class_nms_top_k(spark, sf_dir):
    return nms.class_nms(src.boxes(spark, sf_dir), 0.3, 3).select("frame", "idx", "label", F.col("place").cast("long").alias("place"))


@query("score_order", f"WITH {B} SELECT frame, idx, row_number() OVER (PARTITION BY frame ORDER BY score DESC, idx) AS place FROM boxes")
def score_order(spark, sf_dir):
    return nms.top_per_frame(src.boxes(spark, sf_dir), ["frame"], 1 << 30).select("frame", "idx", F.col("place").cast("long").alias("place"))


@query("box_rescale", f"WITH {B} SELECT frame, idx, x1 * 1.5 AS x1, y1 * 1.5 AS y1, x2 * 1.5 AS x2, y2 * 1.5 AS y2, score FROM boxes")
def box_rescale(spark, sf_dir):
    from framelode.operators.rescale import rescale

    return rescale(src.boxes(spark, sf_dir), (1280, 720), (1920, 1080), x=["x1", "x2"], y=["y1", "y2"]).select("frame", "idx", "x1", "y1", "x2", "y2", "score")


#: Two versions of the same frames: all boxes moved by (3, 2), those of low score missing.
PAIR = f"{B}, ref AS (SELECT frame, idx, x1, y1, x2, y2 FROM boxes WHERE score >= 0.2), pred AS (SELECT frame, idx, x1 + 3 AS x1, y1 + 2 AS y1, x2 + 3 AS x2, y2 + 2 AS y2 FROM boxes WHERE score < 0.9)"
AREAS = f"""{PAIR}, j AS (
  SELECT coalesce(r.frame, p.frame) AS frame, coalesce(r.idx, p.idx) AS idx, coalesce((r.x2 - r.x1) * (r.y2 - r.y1), 0) AS ra, coalesce((p.x2 - p.x1) * (p.y2 - p.y1), 0) AS pa,
    CASE WHEN r.frame IS NULL OR p.frame IS NULL THEN 0 ELSE greatest(0, least(r.x2, p.x2) - greatest(r.x1, p.x1)) * greatest(0, least(r.y2, p.y2) - greatest(r.y1, p.y1)) END AS i
  FROM ref r FULL JOIN pred p ON r.frame = p.frame AND r.idx = p.idx)"""


def pair_areas(spark, sf_dir):
    from framelode.operators.evaluate import box_areas

    b = src.boxes(spark, sf_dir)
    moved = b.where("score < 0.9").select("frame", "idx", *[(F.col(c) + d).alias(c) for c, d in (("x1", 3), ("y1", 2), ("x2", 3), ("y2", 2))])
    return box_areas(b.where("score >= 0.2").select("frame", "idx", "x1", "y1", "x2", "y2"), moved)


@query("mask_full_outer", f"WITH {AREAS} SELECT frame, idx, ra, pa, i FROM j")
def mask_full_outer(spark, sf_dir):
    return pair_areas(spark, sf_dir)


@query("mask_metrics", f"""
WITH {AREAS} SELECT round(sum(i) / (sum(ra) + sum(pa) - sum(i)), 9) AS micro_iou, round(sum(i) / sum(pa), 9) AS micro_precision, round(sum(i) / sum(ra), 9) AS micro_recall,
  round(avg(CASE WHEN ra + pa - i = 0 THEN 1.0 ELSE i / (ra + pa - i) END), 9) AS macro_iou, round(sum(2 * (ra - i) + (pa - i)), 3) AS weighted_error FROM j""")
def mask_metrics(spark, sf_dir):
    from framelode.operators.evaluate import metrics

    m = metrics(pair_areas(spark, sf_dir))
    return m.select(*[F.round(c, 3 if c == "weighted_error" else 9).alias(c) for c in m.columns])


@query("mask_diff_report", f"""
WITH {AREAS}, u AS (SELECT *, CASE WHEN ra + pa - i = 0 THEN 1.0 ELSE i / (ra + pa - i) END AS iou FROM j)
SELECT count(*) AS keys, sum(CASE WHEN pa = 0 THEN 1 ELSE 0 END)::BIGINT AS missing, sum(CASE WHEN ra = 0 THEN 1 ELSE 0 END)::BIGINT AS extra, round(min(iou), 9) AS min_iou,
  round(stddev_pop(iou), 6) AS sd_iou, round(quantile_cont(iou, 0.5), 6) AS p50, sum(CASE WHEN pa > ra THEN 1 ELSE 0 END)::BIGINT AS grown FROM u""")
def mask_diff_report(spark, sf_dir):
    j = pair_areas(spark, sf_dir).withColumn("iou", F.expr("CASE WHEN ra + pa - i = 0 THEN 1.0D ELSE i / (ra + pa - i) END"))
    one = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    return j.agg(F.count("*").alias("keys"), one("pa = 0").alias("missing"), one("ra = 0").alias("extra"), F.round(F.min("iou"), 9).alias("min_iou"), F.round(F.stddev_pop("iou"), 6).alias("sd_iou"), F.round(geo.percentile("iou", 0.5), 6).alias("p50"), one("pa > ra").alias("grown"))


@query("set_comparison", f"""
WITH {PAIR} SELECT sum(CASE WHEN r.frame IS NOT NULL AND p.frame IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS common, sum(CASE WHEN p.frame IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_left,
  sum(CASE WHEN r.frame IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_right FROM ref r FULL JOIN pred p ON r.frame = p.frame AND r.idx = p.idx""")
def set_comparison(spark, sf_dir):
    a = pair_areas(spark, sf_dir)
    one = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    return a.agg(one("ra > 0 AND pa > 0").alias("common"), one("pa = 0").alias("only_left"), one("ra = 0").alias("only_right"))


@query("vertex_budget", f"""
WITH {B}, q AS (SELECT frame % 50 AS track, quantile_cont((x2 - x1) * (y2 - y1), 0.999) / (200.0 * 150) AS occ FROM boxes GROUP BY 1)
SELECT CAST(CASE WHEN occ <= 0.03 THEN 14 WHEN occ <= 0.10 THEN 16 WHEN occ <= 0.25 THEN 18 ELSE 20 END AS BIGINT) AS vertices, count(*) AS n_tracks FROM q GROUP BY 1""")
def vertex_budget(spark, sf_dir):
    q = src.boxes(spark, sf_dir).groupBy((F.col("frame") % 50).alias("track")).agg((F.percentile(F.expr("(x2 - x1) * (y2 - y1)"), F.lit(0.999)) / (200.0 * 150)).alias("occ"))
    return q.groupBy(geo.vertex_budget(F.col("occ")).cast("long").alias("vertices")).agg(F.count("*").alias("n_tracks"))


@query("area_quantiles", f"""
WITH {B} SELECT label, round(quantile_cont((x2 - x1) * (y2 - y1), 0.5), 6) AS p50, round(quantile_cont((x2 - x1) * (y2 - y1), 0.9), 6) AS p90, round(quantile_cont((x2 - x1) * (y2 - y1), 0.99), 6) AS p99 FROM boxes GROUP BY label""")
def area_quantiles(spark, sf_dir):
    p = F.percentile(F.expr("(x2 - x1) * (y2 - y1)"), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return src.boxes(spark, sf_dir).groupBy("label").agg(p.alias("p")).select("label", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@query("worst_frames", f"""
WITH {AREAS}, u AS (SELECT frame, idx, round(i / (ra + pa - i), 9) AS iou FROM j) SELECT frame, idx, iou FROM u WHERE iou > 0 ORDER BY iou, frame, idx LIMIT 25""")
def worst_frames(spark, sf_dir):
    j = pair_areas(spark, sf_dir).withColumn("iou", F.round(F.expr("i / (ra + pa - i)"), 9)).where("iou > 0")
    return j.orderBy("iou", "frame", "idx").limit(25).select("frame", "idx", "iou")


@query("class_policy_routing", f"""
WITH {B} SELECT label, CAST(CASE label WHEN 'A' THEN 2 WHEN 'N' THEN 4 ELSE 3 END AS BIGINT) AS keyframe_interval, count(*) AS n, count(DISTINCT frame) AS frames FROM boxes GROUP BY 1, 2""")
def class_policy_routing(spark, sf_dir):
    from framelode.operators.classwise import load_policy, route

    policy = load_policy('{"schema_version": 1, "default": {"keyframe_interval": 3}, "classes": {"A": {"keyframe_interval": 2}, "N": {"keyframe_interval": 4}}}')
    return route(src.boxes(spark, sf_dir), policy).groupBy("label", "keyframe_interval").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("frames"))


