"""Polygon masks on the pixel grid, in numpy: filling with inclusive edges, nesting, areas and overlaps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Mask:
    """Pixels cropped to their box, whose corner is (x, y)."""

    x: int
    y: int
    grid: np.ndarray

    @property
    def pixels(self) -> int:
        return int(self.grid.sum())

    @property
    def box_area(self) -> float:
        return float(self.grid.shape[0] * self.grid.shape[1])


def ring_area(ring: list) -> float:
    p = np.asarray(ring, float).reshape(-1, 2)
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def inside(point: np.ndarray, ring: np.ndarray) -> bool:
    """Even-odd test of one point."""
    a, b = ring, np.roll(ring, -1, axis=0)
    crosses = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[:, 0] + (point[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool(np.count_nonzero(crosses & (x > point[0])) % 2)


def _within(inner: np.ndarray, outer: np.ndarray) -> bool:
    """Whether all points of a ring lie in or on another; crossing rings are not nested."""
    for p in inner:
        on = np.any(np.all(np.isclose(outer, p), axis=1))
        if not on and not inside(p, outer):
            return False
    return True


def ring_depths(polygons: list) -> list[int]:
    """How many larger rings hold each ring: even depth is foreground, odd is a hole."""
    rings = [np.asarray(r, float).reshape(-1, 2) for r in polygons]
    areas = [ring_area(r) for r in rings]
    return [sum(1 for j, o in enumerate(rings) if j != i and (areas[j], -j) > (areas[i], -i) and _within(r, o)) for i, r in enumerate(rings)]


def polygons_area(polygons: list) -> float:
    """Continuous area: rings at even depth add, at odd depth subtract."""
    return float(sum((1 if d % 2 == 0 else -1) * ring_area(r) for r, d in zip(polygons, ring_depths(polygons), strict=True)))


def fill_ring(ring: np.ndarray, grid: np.ndarray, x0: int, y0: int, value: bool = True) -> None:
    """Sets the pixels of an integer ring: everything inside, and every pixel its edges pass."""
    p = ring - (x0, y0)
    q = np.roll(p, -1, axis=0)
    h, w = grid.shape
    ys = np.arange(h)
    edge, row = np.nonzero((p[:, 1, None] <= ys) != (q[:, 1, None] <= ys))
    x = p[edge, 0] + (row - p[edge, 1]) * (q[edge, 0] - p[edge, 0]) / (q[edge, 1] - p[edge, 1])
    # a pixel is inside if an odd number of edges cross its row at or before it
    flips = np.zeros((h, w + 1), np.int32)
    np.add.at(flips, (row, np.clip(np.ceil(x), 0, w).astype(int)), 1)
    grid[(np.cumsum(flips, axis=1)[:, :w] % 2).astype(bool)] = value
    # every edge, a pixel a step
    steps = np.maximum(np.abs(q - p).max(axis=1), 1).astype(int) + 1
    of = np.repeat(np.arange(len(p)), steps)
    share = (np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)) / (steps - 1)[of]
    at = np.rint(p[of] + (q - p)[of] * share[:, None]).astype(int)
    at = at[((at >= 0) & (at < (w, h))).all(axis=1)]
    grid[at[:, 1], at[:, 0]] = value


def crop_mask(polygons: list, union: bool = False, snap=np.rint) -> Mask:
    """Mask of rings: by nesting depth, or painted one over the other as a union."""
    rings = [snap(np.asarray(r, float).reshape(-1, 2)).astype(int) for r in polygons if len(r) >= 3]
    if not rings:
        return Mask(0, 0, np.zeros((0, 0), bool))
    every = np.concatenate(rings)
    (x0, y0), (x1, y1) = every.min(axis=0), every.max(axis=0)
    grid = np.zeros((y1 - y0 + 1, x1 - x0 + 1), bool)
    depth = [0] * len(rings) if union or len(rings) == 1 else ring_depths(rings)
    for d in sorted(set(depth)):
        for r, its in zip(rings, depth, strict=True):
            if its == d:
                fill_ring(r, grid, x0, y0, d % 2 == 0)
    return Mask(int(x0), int(y0), grid)


def common_pixels(a: Mask, b: Mask) -> int:
    x0, y0 = max(a.x, b.x), max(a.y, b.y)
    x1 = min(a.x + a.grid.shape[1], b.x + b.grid.shape[1])
    y1 = min(a.y + a.grid.shape[0], b.y + b.grid.shape[0])
    if x1 <= x0 or y1 <= y0:
        return 0
    return int((a.grid[y0 - a.y : y1 - a.y, x0 - a.x : x1 - a.x] & b.grid[y0 - b.y : y1 - b.y, x0 - b.x : x1 - b.x]).sum())
