"""Tables of a result: segments, keyframes and their components with dense ids, checks, totals and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_table(spans: DataFrame, shape: str = "polygon") -> DataFrame:
    """(segment_id, track, start_frame, end_frame, shape_type) numbered by track and start."""
    n = F.row_number().over(Window.orderBy("track", "start_frame")).cast("long")
    return spans.select(n.alias("segment_id"), "track", "start_frame", "end_frame", F.lit(shape).alias("shape_type"))


def keyframe_table(keys: DataFrame, segments: DataFrame) -> DataFrame:
    """Keyframes (track, frame, ...) with the segment that holds them; ids dense by segment and frame."""
    held = keys.join(segments.select("segment_id", F.col("track").alias("t"), "start_frame", "end_frame"), (F.col("track") == F.col("t")) & F.col("frame").between(F.col("start_frame"), F.col("end_frame")))
    held = held.drop("t", "start_frame", "end_frame")
    return held.withColumn("keyframe_id", F.row_number().over(Window.orderBy("segment_id", "frame")).cast("long")).withColumn("keyframe_index", F.row_number().over(Window.partitionBy("segment_id").orderBy("frame")) - 1)


def outside_segments(keys: DataFrame, bounds: DataFrame, least: int) -> DataFrame:
    """Keyframes outside [lo, hi] of their track, or of tracks with fewer than ``least``."""
    return keys.join(bounds, "track").where(~F.col("frame").between(F.col("lo"), F.col("hi")) | (F.col("n") < least))


def compact(result: dict[str, DataFrame], dense: tuple[str, ...] = ("masks",)) -> dict[str, DataFrame]:
    """A result without its dense tables; they are rebuilt from keyframes by interpolation."""
    return {k: v for k, v in result.items() if k not in dense}


def capabilities(result: dict[str, DataFrame]) -> DataFrame:
    """(name, row_count, available) of every table."""
    out = None
    for name, df in sorted(result.items()):
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("name"), "row_count")
        out = one if out is None else out.union(one)
    return out.withColumn("available", F.col("row_count") > 0)


def totals(rows: DataFrame, kept: Column) -> DataFrame:
    """(n_in, frames, kept, dropped) of a filter, in one pass."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.agg(F.count("*").alias("n_in"), F.countDistinct("frame").alias("frames"), one(kept).alias("kept"), one(~kept).alias("dropped"))


def split_range(start: int, end: int, weights: list[float]) -> list[tuple[int, int]]:
    """[start, end] in contiguous parts sized by weight; parts that would be empty are left out."""
    whole, n, at, out, acc = sum(weights), end - start + 1, start, [], 0.0
    for w in weights:
        acc += w
        stop = start + round(n * acc / whole) - 1
        if stop >= at:
            out.append((at, stop))
            at = stop + 1
    return out
