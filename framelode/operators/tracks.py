"""Operators on tracks: resolution of labels, pruning, renumbering, scenes, runs and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Values of an ordering column that one task sums over.
BLOCK = 1 << 16


def running_sum(rows: DataFrame, order: str, value: F.Column, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of ``keys`` up to and with this one, by the integer ``order``.

    Rows are summed by blocks of the order's range, and only the sums of blocks are ordered in one task.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK)).withColumn("_value", value)
    up = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_block").eqNullSafe(F.col("_at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = rows.withColumn("_inside", F.sum("_value").over(up)).join(sums, same).withColumn(name, F.col("_before") + F.col("_inside"))
    return out.drop("_block", "_value", "_at", "_before", "_inside", *(f"_{k}" for k in keys))


def label_histogram(rows: DataFrame, order: str = "event_id") -> DataFrame:
    """(track, label, n, first_seen): how often and how early a track carries a label."""
    return rows.groupBy("track", "label").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def resolve(rows: DataFrame, order: str = "event_id", max_short: int = 10) -> DataFrame:
    """(track, length, label, n_labels, removed, final_id): majority label (ties: seen first), tracks of ``max_short``
    rows or fewer removed, the others numbered densely by track id.

    The histogram is one shuffle with map-side counts; the numbering orders tracks, not rows.
    """
    h = label_histogram(rows, order)
    t = h.groupBy("track").agg(F.sum("n").alias("length"), F.max_by("label", F.struct("n", -F.col("first_seen"))).alias("label"), F.count("*").alias("n_labels"))
    t = t.withColumn("removed", F.col("length") <= max_short)
    t = running_sum(t, "track", F.when(~F.col("removed"), 1).otherwise(0), "number")
    return t.withColumn("final_id", F.when(~F.col("removed"), F.col("number"))).drop("number")


def scene_of(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``scene``: the number of cuts at or before the row's frame (frame-complete input assumed), of the same video
    where both tables have a ``video``.

    Cuts and frames are merged in one ordered pass over distinct frames, which are few beside rows; the join back is
    by equality on the frame.
    """
    keys = ("video",) if "video" in rows.columns and "video" in cuts.columns else ()
    marks = rows.select(*keys, "frame").distinct().withColumn("cut", F.lit(0)).union(cuts.select(*keys, "frame", F.lit(1).alias("cut")))
    marks = marks.groupBy(*keys, "frame").agg(F.max("cut").alias("cut"))
    scenes = running_sum(marks, "frame", F.col("cut"), "scene", keys).drop("cut")
    return rows.join(scenes, [*keys, "frame"])


def runs(rows: DataFrame, keys: list[str], extra_break: str | None = None) -> DataFrame:
    """Adds ``run``: contiguous frames of ``keys`` share it; a break is a frame that isn't one more, or a change of
    ``extra_break``."""
    w = Window.partitionBy(*keys).orderBy("frame")
    same = F.col("frame") == F.lag("frame").over(w) + 1
    if extra_break:
        same = same & F.col(extra_break).eqNullSafe(F.lag(extra_break).over(w))
    return rows.withColumn("brk", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("brk")


def gap_segments(rows: DataFrame, max_gap: int, same: str) -> DataFrame:
    """Adds ``gap`` (missing frames since the row before) and ``segment``: a segment goes on over gaps of up to
    ``max_gap`` frames while ``same`` holds its value, and splits otherwise."""
    w = Window.partitionBy("track").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(w) - 1
    keep = (gap <= max_gap) & (F.col(same) == F.lag(same).over(w))
    rows = rows.withColumn("gap", gap).withColumn("brk", F.when(keep, 0).otherwise(1))
    return rows.withColumn("segment", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("brk")


def chunks(rows: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """Cuts long runs in chunks of at most ``size`` rows that overlap by ``overlap`` on each side.

    Adds ``chunk`` and ``emit``; a row is emitted by one chunk and only read by those whose halo it falls in. The
    overlap is cut to (size - 1) / 2.
    """
    overlap = min(overlap, (size - 1) // 2)
    stride = size - 2 * overlap
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("frame")) - 1
    rows = rows.withColumn("rn", rn).withColumn("last", F.floor((F.count("*").over(Window.partitionBy(*keys)) - 1) / stride))
    own = F.floor(F.col("rn") / stride)
    low = F.greatest(F.lit(0), F.floor((F.col("rn") - overlap) / stride))
    high = F.least("last", F.floor((F.col("rn") + overlap) / stride))
    return rows.withColumn("chunk", F.explode(F.sequence(low, high))).withColumn("emit", F.col("chunk") == own).drop("rn", "last")


def refractory(events: DataFrame, keys: list[str], min_gap: int) -> DataFrame:
    """Keeps an event only if its frame is more than ``min_gap`` after the last one kept: a fold over each key's sorted
    frames. A key holds its events of interest only (cuts of a video), so the array is short."""
    fold = F.aggregate(
        F.sort_array("fs"), F.array().cast("array<bigint>"),
        lambda kept, f: F.when((F.size(kept) == 0) | (f - F.element_at(kept, -1) > min_gap), F.concat(kept, F.array(f))).otherwise(kept),
    )
    g = events.groupBy(*keys).agg(F.collect_set(F.col("frame").cast("bigint")).alias("fs"))
    return g.select(*keys, F.explode(fold).alias("frame"))
