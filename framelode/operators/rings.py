"""Dense contours from keyframed ones, and keyframes enlarged until they cover what was observed.

Groups are (track, scene): nothing is drawn across a cut or beyond the first and last keyframe.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelode.functions import raster, shapes

from .grouped import per_group

_RINGS = pa.list_(pa.list_(pa.list_(pa.float64())))


def between(a: list, b: list, alpha: float, aligned: bool = False) -> list:
    """Contours of one key on the way to another's: index by index where they have as many points, else (or if
    ``aligned``) resampled to the larger number and turned to fit. Another number of contours: the nearer key's."""
    if len(a) != len(b):
        return a if alpha < 0.5 else b
    p, q = [shapes.ring(r) for r in a], [shapes.ring(r) for r in b]
    if aligned:
        q = shapes.match_contours(p, q)
    out = []
    for x, y in zip(p, q, strict=True):
        if aligned or len(x) != len(y):
            n = max(len(x), len(y))
            x = shapes.resample(x, n)
            y = shapes.align(x, shapes.resample(y, n))
        x, y, t = x.astype(np.float32), y.astype(np.float32), np.float32(alpha)
        out.append((x + (y - x) * t).astype(np.float64).tolist())
    return out


def densify_rings(keys: DataFrame, aligned: bool = False, max_span: int | None = None) -> DataFrame:
    """(track, scene, frame, polygons, is_key): every frame from the first to the last key of a (track, scene); spans
    longer than ``max_span`` stay open."""

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("frame")
        frames, rings = g["frame"].to_pylist(), g["polygons"].to_pylist()
        out = []
        for k, (f, r) in enumerate(zip(frames, rings, strict=True)):
            out.append((f, r, True))
            if k + 1 < len(frames) and (max_span is None or frames[k + 1] - f <= max_span):
                out += [(m, between(r, rings[k + 1], (m - f) / (frames[k + 1] - f), aligned), False) for m in range(f + 1, frames[k + 1])]
        head = {c: g[c].take(pa.array([0] * len(out))) for c in ("track", "scene")}
        return pa.table(head | {"frame": pa.array([o[0] for o in out], pa.int64()), "polygons": pa.array([o[1] for o in out], _RINGS), "is_key": pa.array([o[2] for o in out])})

    kinds = dict(keys.dtypes)
    shape = f"track {kinds['track']}, scene {kinds['scene']}, frame long, polygons array<array<array<double>>>, is_key boolean"
    return per_group(keys.select("track", "scene", "frame", "polygons"), ["track", "scene"], run, shape)


def cover(polygons: list, target: list, floor: float = 0.97, step: float = 0.01, most: float = 1.05) -> list:
    """``polygons`` scaled around their centres by the least step that covers ``floor`` of the target's pixels; by
    ``most`` if none does."""
    goal = raster.crop_mask(target, union=True)
    if not goal.pixels:
        return polygons
    factor = 1.0
    while True:
        grown = [shapes.scale_around(shapes.ring(r), factor).tolist() for r in polygons] if factor > 1 else polygons
        if raster.common_pixels(goal, raster.crop_mask(grown, union=True)) >= floor * goal.pixels or factor >= most:
            return grown
        factor = min(most, factor + step)


def repair_recall(keys: DataFrame, observed: DataFrame, floor: float = 0.97, most: float = 1.05) -> DataFrame:
    """(frame, track, polygons): keys enlarged to cover what was observed in their frame; others as they are."""
    j = keys.select("frame", "track", "polygons").join(observed.select("frame", "track", observed["polygons"].alias("seen")), ["frame", "track"], "left")

    def run(batches):
        for b in batches:
            out = [cover(p, s, floor, most=most) if p and s else p for p, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _RINGS)], names=["frame", "track", "polygons"])

    kinds = dict(j.dtypes)
    return j.mapInArrow(run, f"frame {kinds['frame']}, track {kinds['track']}, polygons array<array<array<double>>>")
