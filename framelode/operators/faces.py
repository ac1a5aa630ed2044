"""Face observations to privacy masks: gates, tracks, derivation, short tracks out, gaps interpolated, merged with others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions.geometry import angle_lerp

from . import privacy, track

#: Lowest head and face scores, and the longest gap that is filled.
GATE, MAX_FILL = 0.55, 3


def fill_gaps(masks: DataFrame, keys: list[str], max_gap: int = MAX_FILL, kind: str = "derivation") -> DataFrame:
    """Rows between neighbours of the same ``kind`` at most ``max_gap`` frames apart: centre and extents linear, angle the
    short way round, confidence the lower. Adds ``interpolated``; what is there is never replaced."""
    w = Window.partitionBy(*keys).orderBy("frame")
    cols = ("frame", "cx", "cy", "half_width", "half_height", "theta", "confidence", kind)
    n = masks.select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in cols])
    gap = n.where((F.col(f"n_{kind}") == F.col(kind)) & (F.col("n_frame") - F.col("frame") - 1).between(1, max_gap)).withColumn("at", F.explode(F.sequence(F.col("frame") + 1, F.col("n_frame") - 1)))
    t = (F.col("at") - F.col("frame")) / (F.col("n_frame") - F.col("frame"))
    line = lambda c: (F.col(c) + (F.col(f"n_{c}") - F.col(c)) * t).alias(c)
    fresh = {"frame": F.col("at").alias("frame"), "theta": angle_lerp(F.col("theta"), F.col("n_theta"), t).alias("theta"), "confidence": F.least("confidence", "n_confidence").alias("confidence")}
    fresh |= {c: line(c) for c in ("cx", "cy", "half_width", "half_height")}
    made = gap.select([fresh.get(c, F.col(c)) for c in masks.columns] + [F.lit(True).alias("interpolated")])
    return masks.withColumn("interpolated", F.lit(False)).unionByName(made)


def face_masks(observations: DataFrame, target: str = "eyes", shape: str = "ellipse", gate: float = GATE, max_gap: int = MAX_FILL) -> DataFrame:
    """(video, scene, frame, track, cx, cy, half_width, half_height, theta, derivation, confidence, interpolated).

    ``observations``: (video, scene, frame, idx, x1, y1, x2, y2 of the head, score of the head, face_score, ellipse,
    keypoints). Heads below ``gate`` are not tracked; faces below it give no mask; tracks too short to keep give none.
    """
    heads = observations.where(F.col("score") >= gate)
    box = heads.select("video", "scene", "frame", "idx", "x1", "y1", "x2", "y2", "score")
    placed = track.track_faces(box).select("video", "scene", "frame", "idx", "raw_track")
    kept = track.track_faces(box, summaries=True).where("NOT removed").select("video", "raw_track")
    rows = heads.where(F.col("face_score") >= gate).join(placed, ["video", "scene", "frame", "idx"]).join(kept, ["video", "raw_track"])
    derived = privacy.privacy_masks(rows.select(F.struct("video", "scene", "frame", "raw_track").alias("observation_id"), "ellipse", "keypoints"), target, shape).where("mask IS NOT NULL")
    flat = derived.select("observation_id.video", "observation_id.scene", "observation_id.frame", F.col("observation_id.raw_track").alias("track"), *[f"mask.{c}" for c in ("cx", "cy", "half_width", "half_height", "theta", "derivation", "confidence")])
    return fill_gaps(flat, ["video", "scene", "track"], max_gap)


def merge_domains(main: DataFrame, faces: DataFrame) -> DataFrame:
    """Main and face masks in one table, face tracks as 'face:...'; keys that collide fail the job."""
    out = main.select("frame", F.col("track").cast("string").alias("track"), F.lit("main").alias("domain")).unionByName(faces.select("frame", F.when(F.col("track").startswith("face:"), F.col("track")).otherwise(F.concat(F.lit("face:"), "track")).alias("track"), F.lit("face_privacy").alias("domain")))
    n = F.count("*").over(Window.partitionBy("frame", "track"))
    return out.withColumn("n", n).withColumn("track", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two masks of track "), "track"))).otherwise(F.col("track"))).drop("n")
