"""Scans of inference stores: flat tables joined and nested again into detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqlite_source import SqliteDataSource


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Canonical records, one JSON object a line; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def open_store(spark: SparkSession, path: str, tables: list[str], partitions: int = 8) -> dict[str, DataFrame]:
    spark.dataSource.register(SqliteDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return {t: spark.read.format("sqlite_table").option("path", path).option("table", t).option("partitions", str(partitions)).load() for t in tables}


def scan_raw(store: dict[str, DataFrame]) -> DataFrame:
    """Raw masks in frame order's columns, JSON decoded: (frame, idx, mask_id, label, class_name, score, polygons, bbox_xyxy)."""
    m = store["masks"]
    polygons = F.coalesce(F.from_json("polygons", "array<array<array<double>>>"), F.transform(F.from_json("polygons", "array<array<double>>"), flat_points))
    return m.select("frame", F.col("detection_index").alias("idx"), "mask_id", "label", "class_name", F.col("score").cast("double").alias("score"), polygons.alias("polygons"), F.from_json("bbox_xyxy", "array<double>").alias("bbox_xyxy"))


def flat_points(p):
    """[x, y, x, y, ...] as points."""
    return F.transform(F.sequence(F.lit(0), (F.size(p) / 2 - 1).cast("int")), lambda i: F.array(F.element_at(p, 2 * i + 1), F.element_at(p, 2 * i + 2)))


def scan_unified(store: dict[str, DataFrame]) -> DataFrame:
    """Detections of a unified store with their rings: points, polygons, segmentations, detections and frames joined,
    classes attached where there are any, points nested in order twice. Frames without detections are kept."""
    points = store["segmentation_points"].groupBy("polygon_id").agg(F.sort_array(F.collect_list(F.struct("point_index", "x", "y"))).alias("p"))
    ring = F.transform("p", lambda q: F.array(q["x"], q["y"]))
    rings = store["segmentation_polygons"].join(points, F.col("id") == F.col("polygon_id")).select("detection_id", "polygon_index", ring.alias("ring"))
    rings = rings.groupBy("detection_id").agg(F.sort_array(F.collect_list(F.struct("polygon_index", "ring"))).alias("r")).select(F.col("detection_id").alias("rd"), F.transform("r", lambda q: q["ring"]).alias("polygons"))
    cls = store["classifications"].select(F.col("detection_id").alias("cd"), F.col("class_name").alias("named"), F.col("score").alias("class_score"))
    d = store["detections"].join(rings, F.col("id") == F.col("rd")).join(cls, F.col("id") == F.col("cd"), "left")
    label = F.coalesce(F.nullif("named", F.lit("")), "class_name")
    d = d.select("frame_id", F.col("id").alias("source_detection_id"), label.alias("label"), F.col("score"), "class_score", F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy"), "polygons")
    frames = store["frames"].select(F.col("id").alias("f"), F.col("frame_index").alias("frame"), "timestamp_sec", "width", "height")
    return frames.join(d, F.col("f") == F.col("frame_id"), "left").drop("f", "frame_id")


def scan_faces(store: dict[str, DataFrame]) -> DataFrame:
    """Face observations with their keypoints in order: (observation_id, frame, face_score, ellipse, keypoints)."""
    k = store["face_keypoints"].groupBy("observation_id").agg(F.sort_array(F.collect_list(F.struct("point_index", "x", "y", "class_name", "confidence", F.col("valid").cast("boolean").alias("valid")))).alias("keypoints"))
    o = store["face_observations"].join(store["detections"].select(F.col("id").alias("d"), "frame_id"), F.col("anchor_detection_id") == F.col("d"))
    o = o.join(store["frames"].select(F.col("id").alias("f"), F.col("frame_index").alias("frame")), F.col("frame_id") == F.col("f"))
    ellipse = F.array("ellipse_cx", "ellipse_cy", "ellipse_major_radius", "ellipse_minor_radius", "ellipse_theta_radians")
    return o.join(k, F.col("id") == F.col("observation_id"), "left").select(F.col("id").alias("observation_id"), "frame", "face_score", ellipse.alias("ellipse"), "keypoints")
