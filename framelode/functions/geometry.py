"""Column expressions for boxes, rings, angles and percentiles. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def box_overlap(a: str, b: str) -> Column:
    """Intersection area of boxes in columns ``{a}x1`` .. and ``{b}x1`` .."""
    c = F.col
    w = F.least(c(f"{a}x2"), c(f"{b}x2")) - F.greatest(c(f"{a}x1"), c(f"{b}x1"))
    h = F.least(c(f"{a}y2"), c(f"{b}y2")) - F.greatest(c(f"{a}y1"), c(f"{b}y1"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def box_iou(a: str, b: str, floor: float = 0.0) -> Column:
    """Intersection over union; 0 where the union isn't positive, or over at least ``floor`` if given."""
    area = lambda p: box_area(*(F.col(f"{p}{k}") for k in ("x1", "y1", "x2", "y2")))
    both = box_overlap(a, b)
    union = area(a) + area(b) - both
    if floor:
        return both / F.greatest(union, F.lit(floor))
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def canonical_box(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """Corners in order, whichever way the box was drawn."""
    return [F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2")]


def signed_area(ring: Column) -> Column:
    """Shoelace area of an array of struct<x,y>; positive when counter-clockwise in a y-up plane."""
    turned = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2


def vertex_mean(ring: Column, axis: str) -> Column:
    return F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(ring)


def ring_box(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]


def oriented(ring: Column) -> Column:
    """The ring, reversed if clockwise."""
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def ring_lerp(a: Column, b: Column, alpha: Column) -> Column:
    """Index-wise interpolation of equally long rings in float32."""
    t = alpha.cast("float")
    mid = lambda p, q: (p.cast("float") + (q.cast("float") - p.cast("float")) * t).cast("float")
    return F.zip_with(a, b, lambda p, q: F.struct(mid(p["x"], q["x"]).alias("x"), mid(p["y"], q["y"]).alias("y")))


def ellipse_ring(cx: Column, cy: Column, a: Column, b: Column, theta: Column, n: int = 96) -> Column:
    """Polygon of ``n`` points on an ellipse."""
    def point(i):
        t = i * (TAU / n)
        u, v = a * F.cos(t), b * F.sin(t)
        return F.struct((cx + u * F.cos(theta) - v * F.sin(theta)).alias("x"), (cy + u * F.sin(theta) + v * F.cos(theta)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def angle_lerp(a: Column, b: Column, alpha: Column, period: float = TAU) -> Column:
    """From ``a`` towards ``b`` the short way round; ``period`` 2 pi for directions, pi for axes."""
    d = b - a
    d = d - period * F.floor((d + period / 2) / period)
    return a + d * alpha


def percentile(column: str, q: float) -> Column:
    """Linear interpolation between the two nearest ranks."""
    return F.percentile(column, F.lit(q))


def floor_percentile(column: str, q: float) -> Column:
    """The value at index min(n - 1, floor(n * q)) of the sorted values."""
    s = F.sort_array(F.collect_list(column))
    return F.element_at(s, (F.least(F.size(s) - 1, F.floor(F.size(s) * F.lit(q))) + 1).cast("int"))


def vertex_budget(occupancy: Column) -> Column:
    """Vertices that a mask of this share of the frame gets."""
    return F.when(occupancy <= 0.03, 14).when(occupancy <= 0.10, 16).when(occupancy <= 0.25, 18).otherwise(20)


def canonical_ellipse(a: Column, b: Column, degrees: Column) -> list[Column]:
    """Radii with the larger first and the angle in [-90, 90)."""
    turned = F.when(b > a, degrees + 90).otherwise(degrees) + 90
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (turned - 180 * F.floor(turned / 180) - 90).alias("theta")]


#: Corners beyond this are left to Python, so that areas and pixel counts below are exact in double precision.
PIXEL_LIMIT = float(1 << 22)


def pixel_box(mask: Column, inline: bool = False) -> Column:
    """struct<x0,y0,x1,y1,whole> of array<array<array<double>>>: the pixels, both ends counted, of a mask that is one
    rectangle along the axes once its corners are rounded (``whole``: they were whole already). A mask without rings has
    x1 < x0. Null for any other."""
    # as a lambda, as its generated code can be a method too large to be compiled; inline where that is measured to be faster
    if inline:
        return _pixel_box(mask)
    return F.get(F.transform(F.array(mask), _pixel_box), 0)


def _pixel_box(polygons: Column) -> Column:
    at = lambda i, k: F.get(F.get(F.get(polygons, 0), i), k)
    p = [[F.rint(at(i, k)) for k in (0, 1)] for i in range(4)]
    level = (p[0][1] == p[1][1]) & (p[1][0] == p[2][0]) & (p[2][1] == p[3][1]) & (p[3][0] == p[0][0])
    upright = (p[0][0] == p[1][0]) & (p[1][1] == p[2][1]) & (p[2][0] == p[3][0]) & (p[3][1] == p[0][1])
    bounded = (F.abs(p[0][0]) <= PIXEL_LIMIT) & (F.abs(p[0][1]) <= PIXEL_LIMIT) & (F.abs(p[2][0]) <= PIXEL_LIMIT) & (F.abs(p[2][1]) <= PIXEL_LIMIT)
    ring, shaped = F.get(polygons, 0), (F.size(polygons) == 1) & (F.size(F.get(polygons, 0)) == 4)
    for i in range(4):
        shaped = shaped & (F.size(F.get(ring, i)) == 2)
    whole = F.lit(True)
    for i in range(4):
        for k in (0, 1):
            whole = whole & (at(i, k) == p[i][k])
    ends = [F.least(p[0][0], p[2][0]), F.least(p[0][1], p[2][1]), F.greatest(p[0][0], p[2][0]), F.greatest(p[0][1], p[2][1]), whole]
    none = [F.lit(v) for v in (PIXEL_LIMIT, PIXEL_LIMIT, -PIXEL_LIMIT, -PIXEL_LIMIT, True)]
    made = lambda cols: F.struct(*[c.alias(n) for c, n in zip(cols, ("x0", "y0", "x1", "y1", "whole"), strict=True)])
    return F.when(F.size(polygons) == 0, made(none)).when(shaped & bounded & (level | upright), made(ends))


def box_pixels(b: Column) -> Column:
    return F.when(b["x1"] < b["x0"], 0.0).otherwise((b["x1"] - b["x0"] + 1) * (b["y1"] - b["y0"] + 1))


def common_box_pixels(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]) + 1
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) + 1
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
