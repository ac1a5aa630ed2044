"""Suppression of overlapping detections: greedy over boxes, over exact masks, and over mask components.

Suppression is sequential inside a frame and independent between frames. A frame's detections are one small group, so
frames are dealt by key and each group is resolved in one Arrow call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import geometry, raster

from .grouped import per_group

#: Size bands: (largest area, IoU threshold, largest ratio of a contained pair).
BANDS = ((2000.0, 0.05, 5.0), (5000.0, 0.10, 5.0), (float("inf"), 0.20, 8.0))
#: Detections of a frame up to which rectangles are resolved in the JVM, whose work grows faster with their number.
FOLDED = 32


def band(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.where(size <= BANDS[0][0], 0, np.where(size <= BANDS[1][0], 1, 2))
    return np.array([b[1] for b in BANDS])[k], np.array([b[2] for b in BANDS])[k]


def greedy(order: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """Mask of kept items: in ``order`` each kept item suppresses later ones it clashes with (matrix)."""
    alive = np.ones(len(order), bool)
    for k, i in enumerate(order):
        if alive[i]:
            later = order[k + 1 :]
            alive[later[clash[i, later]]] = False
    return alive


def box_clashes(b: np.ndarray, margin: float = 2.0) -> np.ndarray:
    """Pairs of boxes (rows x1, y1, x2, y2) of which one suppresses the other."""
    w, h = np.maximum(0, b[:, 2] - b[:, 0]), np.maximum(0, b[:, 3] - b[:, 1])
    area = w * h
    iw = np.minimum(b[:, None, 2], b[None, :, 2]) - np.maximum(b[:, None, 0], b[None, :, 0])
    ih = np.minimum(b[:, None, 3], b[None, :, 3]) - np.maximum(b[:, None, 1], b[None, :, 1])
    both = np.maximum(0, iw) * np.maximum(0, ih)
    union = area[:, None] + area[None, :] - both
    iou = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
    small, large = np.minimum(area[:, None], area[None, :]), np.maximum(area[:, None], area[None, :])
    limit, ratio = band(small)
    inside = (b[:, None, 0] - margin <= b[None, :, 0]) & (b[:, None, 1] - margin <= b[None, :, 1]) & (b[:, None, 2] + margin >= b[None, :, 2]) & (b[:, None, 3] + margin >= b[None, :, 3])
    contained = (inside | inside.T) & (small > 0) & (large <= ratio * np.where(small > 0, small, 1))
    return contained | (iou >= limit)


def _contested(boxes: DataFrame, keys: list[str], margin: float = 2.0) -> DataFrame:
    """Keys of frames in which any two boxes come within ``margin`` of each other; all others keep everything, and
    never leave the JVM."""
    a, b = boxes.select(*keys, F.struct("idx", "x1", "y1", "x2", "y2").alias("a")), boxes.select(*keys, F.struct("idx", "x1", "y1", "x2", "y2").alias("b"))
    near = F.expr(f"a.idx < b.idx AND a.x1 - {margin} <= b.x2 AND b.x1 - {margin} <= a.x2 AND a.y1 - {margin} <= b.y2 AND b.y1 - {margin} <= a.y2")
    return a.join(b, keys).where(near).select(*keys).distinct()


def _resolve(boxes: DataFrame, keys: list[str], run) -> DataFrame:
    hot = _contested(boxes, keys)
    return boxes.join(hot, keys, "left_anti").select(boxes.columns).unionByName(per_group(boxes.join(hot, keys, "left_semi").select(boxes.columns), keys, run, boxes.schema))


def box_nms(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Detections (keys, idx, x1, y1, x2, y2, score) kept by greedy suppression; ties of score go to the lower idx.

    A missing score counts as 0.
    """

    def run(t: pa.Table) -> pa.Table:
        cols = {c: t[c].to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2", "score", "idx")}
        score = np.nan_to_num(cols["score"].astype(float), nan=0.0)
        order = np.lexsort((cols["idx"], -score))
        keep = greedy(order, box_clashes(np.stack([cols[c] for c in ("x1", "y1", "x2", "y2")], axis=1).astype(float)))
        return t.filter(pa.array(keep))

    return _resolve(boxes, keys, run)


def top_per_frame(kept: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of each frame by score, then idx."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "idx")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def class_nms(boxes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Plain IoU suppression within (frame, label), then the ``k`` best of each frame."""

    def run(t: pa.Table) -> pa.Table:
        b = np.stack([t[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
        area = np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])
        iw = np.minimum(b[:, None, 2], b[None, :, 2]) - np.maximum(b[:, None, 0], b[None, :, 0])
        ih = np.minimum(b[:, None, 3], b[None, :, 3]) - np.maximum(b[:, None, 1], b[None, :, 1])
        both = np.maximum(0, iw) * np.maximum(0, ih)
        union = area[:, None] + area[None, :] - both
        clash = np.divide(both, union, out=np.zeros_like(both), where=union > 0) > threshold
        return t.filter(pa.array(greedy(np.lexsort((t["idx"].to_numpy(), -t["score"].to_numpy())), clash)))

    return top_per_frame(_resolve(boxes, ["frame", "label"], run), ["frame"], k)


def overlapping_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of one frame, the better first, whose boxes overlap: (frame, a, b, iou)."""
    w = Window.partitionBy("frame").orderBy(F.desc("score"), "idx")
    r = boxes.withColumn("place", F.row_number().over(w))
    left = r.select("frame", *[F.col(c).alias(f"a_{c}") for c in ("idx", "place", "x1", "y1", "x2", "y2")])
    right = r.select("frame", *[F.col(c).alias(f"b_{c}") for c in ("idx", "place", "x1", "y1", "x2", "y2")])
    meets = F.expr("a_place < b_place AND a_x1 < b_x2 AND b_x1 < a_x2 AND a_y1 < b_y2 AND b_y1 < a_y2")
    return left.join(right, "frame").where(meets).select("frame", F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), geometry.box_iou("a_", "b_").alias("iou"))


def mask_clashes(polygons: list[list], score_order: np.ndarray, coverage: float = 0.80) -> np.ndarray:
    """Pairs of masks of which one suppresses the other, by exact pixels; boxes that don't meet are not rasterised."""
    n = len(polygons)
    ends = [np.rint(np.concatenate([np.asarray(r, float).reshape(-1, 2) for r in p])) if p else np.full((1, 2), np.nan) for p in polygons]
    lo, hi = np.array([e.min(axis=0) for e in ends]).reshape(-1, 2), np.array([e.max(axis=0) for e in ends]).reshape(-1, 2)
    meets = np.all((lo[:, None] <= hi[None]) & (lo[None] <= hi[:, None]), axis=2)
    clash = np.zeros((n, n), bool)
    masks: dict[int, raster.Mask] = {}
    sizes: dict[int, float] = {}
    for i, j in zip(*np.nonzero(np.triu(meets, 1)), strict=True):
        for k in (i, j):
            if k not in masks:
                masks[k] = raster.crop_mask(polygons[k])
                sizes[k] = min(masks[k].box_area, raster.polygons_area(polygons[k]))
        both = raster.common_pixels(masks[i], masks[j])
        if both:
            a, b = masks[i].pixels, masks[j].pixels
            limit, ratio = band(np.array(min(sizes[i], sizes[j])))
            small, large = min(a, b), max(a, b)
            clash[i, j] = clash[j, i] = (both / small >= coverage and large / small <= ratio) or both / (a + b - both) >= limit
    return clash


def mask_nms(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy suppression by exact masks; ``polygons`` is array<array<array<double>>> inside the box x1 .. y2."""

    def run(t: pa.Table) -> pa.Table:
        score = np.nan_to_num(t["score"].to_numpy(zero_copy_only=False).astype(float), nan=0.0)
        order = np.lexsort((t["idx"].to_numpy(), -score))
        return t.filter(pa.array(greedy(order, mask_clashes(t["polygons"].to_pylist(), order))))

    return _resolve(detections, keys, run)


def split_components(polygons: list, hole_fill: bool = True, island_ratio: float = 0.01) -> tuple[list, list[list]]:
    """(main ring, island rings) of a mask: rings at odd depth are holes and filled; islands of at most
    ``island_ratio`` of the largest ring are dropped."""
    depth = raster.ring_depths(polygons)
    outer = [r for r, d in zip(polygons, depth, strict=True) if d % 2 == 0]
    if not outer:
        return [], []
    areas = [raster.ring_area(r) for r in outer]
    k = int(np.argmax(areas))
    return outer[k], [r for i, r in enumerate(outer) if i != k and areas[i] > island_ratio * areas[k]]


def component_nms(detections: DataFrame, keys: list[str], coverage: float = 0.80, island_to_main: float = 0.50) -> DataFrame:
    """Suppression over components: main parts against main parts (the loser's detection goes), then islands of
    different owners against each other, then islands against the main parts that are left. Islands that lose are
    cut out of ``polygons``; the area before cutting stays as ``hint_area`` for association.

    Frames of masks that are one whole-cornered rectangle each, or empty, are folded in the JVM if they are at most
    ``FOLDED``; others go to Python."""

    def run(t: pa.Table) -> pa.Table:
        polys = t["polygons"].to_pylist()
        score = np.nan_to_num(t["score"].to_numpy(zero_copy_only=False).astype(float), nan=0.0)
        order = np.lexsort((t["idx"].to_numpy(), -score))
        parts = [split_components(p) for p in polys]
        alive = greedy(order, mask_clashes([[m] if m else [] for m, _ in parts], order, coverage))
        islands = [(i, r) for i in order for r in parts[i][1] if alive[i]]
        kept: list[tuple[int, list, raster.Mask]] = []
        mains = {i: raster.crop_mask([parts[i][0]]) for i in range(len(parts)) if alive[i] and parts[i][0]}
        for i, r in islands:
            m = raster.crop_mask([r])
            lost = False
            for j, _, other in kept:
                both = raster.common_pixels(m, other)
                if j != i and both and (both / min(m.pixels, other.pixels) >= coverage or both / (m.pixels + other.pixels - both) >= float(band(np.array(min(m.box_area, other.box_area)))[0])):
                    lost = True
                    break
            for j, main in mains.items():
                if not lost and j != i and m.pixels and raster.common_pixels(m, main) / m.pixels >= coverage and m.pixels / main.pixels <= island_to_main:
                    lost = True
            if not lost:
                kept.append((i, r, m))
        out = [[parts[i][0], *(r for j, r, _ in kept if j == i)] if parts[i][0] else [] for i in range(len(parts))]
        at = t.schema.get_field_index("polygons")
        t = t.set_column(at, t.schema.field(at), pa.array(out, t.schema.field(at).type))
        t = t.append_column("hint_area", pa.array([raster.polygons_area(p) for p in polys], pa.float64()))
        return t.filter(pa.array(alive))

    schema = detections.withColumn("hint_area", F.lit(0.0)).schema
    b = geometry.pixel_box(F.col("polygons"))
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    w = Window.partitionBy(*keys).orderBy(F.desc("_score"), "idx")
    placed = detections.withColumn("_box", b).withColumn("_score", score).withColumn("_at", F.row_number().over(w))
    box = F.col("_box")
    area = F.when(box["x1"] < box["x0"], 0.0).otherwise((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]))
    its = F.struct(F.col("_at").alias("at"), *[box[n].alias(n) for n in ("x0", "y0", "x1", "y1")], geometry.box_pixels(box).alias("pixels"), area.alias("area"), F.coalesce(box["whole"], F.lit(False)).alias("plain"))
    placed = placed.withColumn("_its", its).withColumn("_all", F.collect_list("_its").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    hard = (F.size("_all") > FOLDED) | F.exists("_all", lambda d: ~d["plain"])
    # most clash with none, and need no fold
    met = F.exists("_all", lambda d: (d["at"] != F.col("_at")) & _box_clash(d, F.col("_its"), coverage))
    kept = F.aggregate(F.slice("_all", 2, F.size("_all")), F.slice("_all", 1, 1), lambda kept, y: F.when(F.exists(kept, lambda x: _box_clash(x, y, coverage)), kept).otherwise(F.concat(kept, F.array(y))))
    easy = placed.where(~hard).where(F.when(met, F.exists(kept, lambda d: d["at"] == F.col("_at"))).otherwise(True))
    easy = easy.select(*detections.columns, F.col("_its.area").alias("hint_area"))
    return easy.unionByName(per_group(placed.where(hard).select(detections.columns), keys, run, schema))


def _box_clash(x: Column, y: Column, coverage: float) -> Column:
    """:func:`mask_clashes` of two masks that are pixel boxes with their ``pixels`` and ``area``."""
    both, small, large, size = geometry.common_box_pixels(x, y), F.least(x["pixels"], y["pixels"]), F.greatest(x["pixels"], y["pixels"]), F.least(x["pixels"], y["pixels"], x["area"], y["area"])
    of = lambda k: F.when(size <= BANDS[0][0], BANDS[0][k]).when(size <= BANDS[1][0], BANDS[1][k]).otherwise(BANDS[2][k])
    meet = (x["x0"] <= y["x1"]) & (y["x0"] <= x["x1"]) & (x["y0"] <= y["y1"]) & (y["y0"] <= x["y1"])
    return meet & (((both / small >= coverage) & (large / small <= of(2))) | (both / (x["pixels"] + y["pixels"] - both) >= of(1)))
