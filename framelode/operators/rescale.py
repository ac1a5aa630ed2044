"""Coordinates from a proxy resolution back to the source's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rescale(rows: DataFrame, proxy: tuple[int, int], source: tuple[int, int], x: list[str], y: list[str], lengths: list[str] | None = None, rings: list[str] | None = None) -> DataFrame:
    """Multiplies every geometry column; widths and heights must scale alike.

    ``rings`` are columns array<struct<x,y>>; ``lengths`` are radii and the like.
    """
    sx, sy = source[0] / proxy[0], source[1] / proxy[1]
    if abs(sx - sy) > 1e-9:
        raise ValueError(f"the scale is not uniform: {sx} and {sy}")
    for c in [*x, *y, *(lengths or ())]:
        rows = rows.withColumn(c, F.col(c) * sx)
    for c in rings or ():
        rows = rows.withColumn(c, F.transform(c, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y"))))
    return rows
