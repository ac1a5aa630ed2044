"""As-of, nearest and band joins between rows and keyframes, without range joins.

Rows and keyframes of a track are merged in one ordered window: the last keyframe at or before a row and the first at
or after it come from running values, so the cost is one shuffle and sort by (track, frame).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bracket(rows: DataFrame, keys: DataFrame, value: str) -> DataFrame:
    """(track, frame, left, right, left_value, right_value, alpha) for distinct (track, frame) of ``rows``.

    ``left`` is the last keyframe at or before the frame, ``right`` the first at or after; null where there is none.
    """
    k = keys.select("track", "frame", F.struct(F.col("frame").alias("f"), F.col(value).alias("v")).alias("k"), F.lit(False).alias("ask"))
    r = rows.select("track", "frame").distinct().select("track", "frame", F.lit(None).cast(k.schema["k"].dataType).alias("k"), F.lit(True).alias("ask"))
    m = k.union(r)
    w = Window.partitionBy("track").orderBy("frame")
    back, ahead = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    m = m.withColumn("l", F.last("k", ignorenulls=True).over(back)).withColumn("r", F.first("k", ignorenulls=True).over(ahead)).where("ask")
    alpha = F.when(F.col("l.f") == F.col("r.f"), 0.0).otherwise((F.col("frame") - F.col("l.f")) / (F.col("r.f") - F.col("l.f")))
    return m.select("track", "frame", F.col("l.f").alias("left"), F.col("r.f").alias("right"), F.col("l.v").alias("left_value"), F.col("r.v").alias("right_value"), alpha.alias("alpha"))


def nearest(rows: DataFrame, keys: DataFrame, value: str) -> DataFrame:
    """(track, frame, nearest, distance, value): the closest keyframe, the earlier of two as close."""
    b = bracket(rows, keys, value)
    left = F.col("right").isNull() | (F.col("frame") - F.col("left") <= F.col("right") - F.col("frame"))
    left = F.coalesce(left & F.col("left").isNotNull(), F.lit(False))
    n = F.when(left, F.col("left")).otherwise(F.col("right"))
    return b.select("track", "frame", n.alias("nearest"), F.abs(F.col("frame") - n).alias("distance"), F.when(left, F.col("left_value")).otherwise(F.col("right_value")).alias("value"))


def densify(keys: DataFrame, columns: list[str], max_span: int | None = None, scene: str | None = None) -> DataFrame:
    """Every frame between neighbouring keyframes of a track, ``columns`` interpolated in float32; keyframes as they are.

    Never beyond the first or last keyframe, never across a change of ``scene``, never over spans above ``max_span``.
    """
    w = Window.partitionBy("track", *([scene] if scene else [])).orderBy("frame")
    k = keys.withColumn("next", F.lead("frame").over(w))
    for c in columns:
        k = k.withColumn(f"next_{c}", F.lead(c).over(w))
    stop = F.when(F.col("next").isNull(), F.col("frame")).otherwise(F.col("next") - 1)
    if max_span is not None:
        stop = F.when(F.col("next") - F.col("frame") > max_span, F.col("frame")).otherwise(stop)
    k = k.withColumn("at", F.explode(F.sequence("frame", stop)))
    alpha = ((F.col("at") - F.col("frame")).cast("double") / (F.col("next") - F.col("frame"))).cast("float")
    values = [F.when(F.col("at") == F.col("frame"), F.col(c).cast("float")).otherwise((F.col(c).cast("float") + (F.col(f"next_{c}").cast("float") - F.col(c).cast("float")) * alpha).cast("float")).alias(c) for c in columns]
    return k.select("track", *([scene] if scene else []), F.col("at").alias("frame"), *values, (F.col("at") == F.col("frame")).alias("is_key"))
