"""Normalisation and filters of detections."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SCORE = 0.35
#: Spellings of a policy's lowest score, tried in this order.
SCORE_KEYS = ("score_min", "min_score", "score_threshold", "threshold", "score")


def load_score_policy(text: str) -> dict:
    """{"default": score, "classes": {name: score}} from JSON; the first finite spelling counts."""

    def score(d: dict) -> float | None:
        for k in SCORE_KEYS:
            v = d.get(k)
            if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v):
                return float(v)
        return None

    raw = json.loads(text)
    found = {k.strip() or "unknown": score(v) for k, v in (raw.get("classes") or {}).items()}
    first = score(raw.get("default") or {})
    return {"default": DEFAULT_SCORE if first is None else first, "classes": {k: v for k, v in found.items() if v is not None}}


def score_policy(rows: DataFrame, policy: dict) -> DataFrame:
    """Rows whose finite score reaches the bound of their class name, else of their label, else the default. A missing
    score counts as 0."""
    classes = policy["classes"]
    bound = F.lit(policy["default"])
    for column in ("label", "class_name"):
        if column in rows.columns and classes:
            chain = None
            for name, least in classes.items():
                chain = (F if chain is None else chain).when(F.trim(column) == name, F.lit(least))
            bound = F.coalesce(chain, bound)
    s = F.coalesce(F.col("score"), F.lit(0.0))
    return rows.where(~F.isnan(s) & (F.abs(s) < float("inf")) & (s >= bound))


def box_chain(rows: DataFrame, score: float, labels: list[str], frame_area: float, ratio: float) -> DataFrame:
    """Score, class set and share of the frame, in one pushed-down predicate chain."""
    return rows.where((F.col("score") >= score) & F.col("label").isin(labels) & (F.expr("(x2 - x1) * (y2 - y1)") <= frame_area * ratio))


def complete_frames(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Every frame with its detections, empty frames kept."""
    return frames.join(detections, "frame", "left")


def orphans(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections of frames that don't exist: must be empty."""
    return detections.join(frames, "frame", "left_anti")


def normalise_records(records: DataFrame) -> DataFrame:
    """One row per detection from one row per frame, whatever dialect the record is in.

    Understands frame_index or frame_idx, detections or instances, bbox_xyxy or bbox (x, y, width, height; negative
    sizes count as 0), score or cls_score; empty or missing names become 'unknown'; corners are put in order. A frame
    without detections stays, as one row of nulls.
    """
    cols = records.columns
    frame = F.col("frame_index" if "frame_index" in cols else "frame_idx").cast("long").alias("frame")
    d = records.select(frame, F.explode_outer("detections" if "detections" in cols else "instances").alias("d")).select("frame", F.col("d").isNotNull().alias("is_detection"), "d.*")
    have = set(d.columns)
    name = lambda c: F.when(~F.col("is_detection"), None).when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, F.trim(c)).otherwise(F.lit("unknown"))
    if "bbox_xyxy" in have:
        b = F.col("bbox_xyxy")
        box = F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))
    else:
        b = F.col("bbox")
        box = F.array(b[0], b[1], b[0] + F.greatest(b[2], F.lit(0.0)), b[1] + F.greatest(b[3], F.lit(0.0)))
    score = F.coalesce(*[F.col(c).cast("double") for c in ("score", "cls_score", "detector_score") if c in have], F.lit(None).cast("double"))
    label = F.col("label") if "label" in have else F.lit(None).cast("string")
    cls = F.col("class_name") if "class_name" in have else label
    ident = F.col("source_detection_id").cast("long") if "source_detection_id" in have else F.lit(None).cast("long")
    polygons = [F.col(c).alias("polygons") for c in ("polygons", "segmentation") if c in have][:1]
    return d.select("frame", ident.alias("source_detection_id"), name(cls).alias("class_name"), name(F.coalesce(label, cls)).alias("label"), score.alias("score"), F.when(F.col("is_detection"), box).alias("bbox_xyxy"), *polygons)
