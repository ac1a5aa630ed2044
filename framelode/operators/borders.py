"""Masks that touch the edge of the picture are drawn past it, so that nothing shows at the border."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distance of a mask's box to the edge that starts expansion, share of the box's size to expand by, its
#: bounds, and how far inside the edge points are still moved.
TRIGGER, SHARE, LEAST, MOST, INFLUENCE = 10.0, 0.10, 6.0, 16.0, 16.0


def _smooth(t: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t * t * (3 - 2 * t)


def expand(rows: DataFrame, frame: tuple[float, float, float, float], column: str = "ring") -> DataFrame:
    """Moves points of ``column`` (array of struct<x,y>) outwards near the edges of ``frame`` (x1, y1, x2, y2).

    An edge acts on a ring whose box comes within TRIGGER of it. The shift is a share of the box's extent across the
    edge, within bounds, and fades to nothing over INFLUENCE with a smooth step.
    """
    xs, ys = F.transform(column, lambda p: p["x"]), F.transform(column, lambda p: p["y"])
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    amount = lambda size: F.greatest(F.lit(LEAST), F.least(F.lit(MOST), size * SHARE))
    push = lambda near, size: F.when(near, amount(size)).otherwise(0.0)
    rows = rows.withColumn("_l", push(x1 - frame[0] <= TRIGGER, x2 - x1)).withColumn("_r", push(frame[2] - x2 <= TRIGGER, x2 - x1))
    rows = rows.withColumn("_t", push(y1 - frame[1] <= TRIGGER, y2 - y1)).withColumn("_b", push(frame[3] - y2 <= TRIGGER, y2 - y1))
    fade = lambda d: _smooth(1 - d / INFLUENCE)

    def moved(p):
        x = p["x"] - F.col("_l") * fade(p["x"] - frame[0]) + F.col("_r") * fade(frame[2] - p["x"])
        y = p["y"] - F.col("_t") * fade(p["y"] - frame[1]) + F.col("_b") * fade(frame[3] - p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return rows.withColumn(column, F.transform(column, moved)).drop("_l", "_r", "_t", "_b")
