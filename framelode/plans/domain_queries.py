"""Queries of grouped operators that SQL doesn't state: trackers, masks, contours and compression."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from framelode.functions import shapes
from framelode.operators import evaluate, keyframes, nms, privacy, track, tracks
from framelode.sources import adapters as src

from .registry import query
from .track_queries import seen


def scened(spark, sf_dir):
    """Boxes as a video: an order's customer is the video, its orders the frames, in scenes of 200 days."""
    o = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("video"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("day"))
    b = src.boxes(spark, sf_dir).withColumnRenamed("frame", "order").join(o, "order")
    return b.select("video", F.floor(F.col("day") / 200).alias("scene"), F.floor(F.col("day") / 10).alias("frame"), (F.col("order") * 100 + F.col("idx")).alias("idx"), "x1", "y1", "x2", "y2", "score", "label")


def rectangles(boxes):
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    return boxes.withColumn("polygons", F.array(ring))


@query("greedy_tracking")
def greedy_tracking(spark, sf_dir):
    return track.track_boxes(scened(spark, sf_dir)).select("video", "frame", "idx", "track")


@query("two_stage_tracking")
def two_stage_tracking(spark, sf_dir):
    return track.track_faces(scened(spark, sf_dir)).select("video", "scene", "frame", "idx", "raw_track", "stage")


@query("two_stage_summaries")
def two_stage_summaries(spark, sf_dir):
    return track.track_faces(scened(spark, sf_dir), summaries=True)


@query("mask_nms")
def mask_nms(spark, sf_dir):
    return nms.mask_nms(rectangles(src.boxes(spark, sf_dir)), ["frame"]).select("frame", "idx", "label", "score")


@query("component_nms")
def component_nms(spark, sf_dir):
    masks = rectangles(src.boxes(spark, sf_dir)).select("frame", "idx", "score", "label", "polygons")
    return nms.component_nms(masks, ["frame"]).select("frame", "idx", "label", "hint_area")


@query("exact_mask_quality")
def exact_mask_quality(spark, sf_dir):
    b = rectangles(src.boxes(spark, sf_dir)).withColumnRenamed("idx", "track")
    moved = rectangles(src.boxes(spark, sf_dir).withColumn("x1", F.col("x1") + 2).withColumn("x2", F.col("x2") + 2)).withColumnRenamed("idx", "track")
    return evaluate.metrics(evaluate.mask_areas(b, moved))


@query("keyframe_compression")
def keyframe_compression(spark, sf_dir):
    s = tracks.gap_segments(seen(spark, sf_dir).withColumn("one", F.lit(1)), 30, "one")
    return keyframes.compress(s.select("track", "segment", "frame", "value"), ["value"])


@query("contour_simplification")
def contour_simplification(spark, sf_dir):
    def run(batches):
        for b in batches:
            rows = []
            for ring in b.column(1).to_pylist():
                p = shapes.ring([[q["x"], q["y"]] for q in ring])
                rows.append((abs(shapes.signed_area(p)), abs(shapes.signed_area(shapes.simplify_rdp(p, 14))), abs(shapes.signed_area(shapes.simplify_area(p, 14))), shapes.is_simple(p)))
            cols = [pa.array([r[k] for r in rows]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["frame", "area", "rdp_area", "small_area", "simple"])

    return src.rings(spark, sf_dir).select("frame", "ring").mapInArrow(run, "frame long, area double, rdp_area double, small_area double, simple boolean")


@query("privacy_masks")
def privacy_masks(spark, sf_dir):
    b = src.boxes(spark, sf_dir)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    eye = lambda k: F.struct((cx + k * w / 5).alias("x"), (cy - h / 8).alias("y"), F.lit("Eye").alias("class_name"), F.col("score").alias("confidence"), F.lit(True).alias("valid"))
    o = b.select((F.col("frame") * 100 + F.col("idx")).alias("observation_id"), F.array(cx, cy, h / 2, w / 2, F.lit(1.5707963267948966)).alias("ellipse"), F.array(eye(-1), eye(1)).alias("keypoints"))
    m = privacy.privacy_masks(o)
    return m.select("observation_id", "mask.derivation", "mask.cx", "mask.cy", "mask.half_width", "mask.half_height", "mask.theta", F.size("mask.polygon").alias("points"))


@query("aligned_densification")
def aligned_densification(spark, sf_dir):
    from framelode.operators import rings

    r = src.rings(spark, sf_dir).select("track", F.lit(0).alias("scene"), "frame", F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("polygons"))
    return rings.densify_rings(r, aligned=True, max_span=20).select("track", "frame", "is_key", F.size(F.col("polygons")[0]).alias("points"))


@query("face_privacy_masks")
def face_privacy_masks(spark, sf_dir):
    from framelode.operators import faces

    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    eye = lambda k: F.struct((cx + k * w / 5).alias("x"), (cy - h / 8).alias("y"), F.lit("Eye").alias("class_name"), F.col("score").alias("confidence"), F.lit(True).alias("valid"))
    o = scened(spark, sf_dir).withColumn("face_score", F.col("score")).withColumn("ellipse", F.array(cx, cy, h / 2, w / 2, F.lit(1.5707963267948966))).withColumn("keypoints", F.array(eye(-1), eye(1)))
    return faces.face_masks(o).drop("derivation")
