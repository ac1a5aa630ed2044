"""Contours in numpy: resampling, alignment, simplification, similarity fits, simplicity, assignment."""

from __future__ import annotations

import heapq
import math

import numpy as np


def ring(points) -> np.ndarray:
    """Points (n, 2) without a repeated last one."""
    p = np.asarray(points, float).reshape(-1, 2)
    return p[:-1] if len(p) > 1 and np.array_equal(p[0], p[-1]) else p


def signed_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def ccw(p: np.ndarray) -> np.ndarray:
    return p[::-1] if signed_area(p) < 0 else p


def resample(p: np.ndarray, n: int) -> np.ndarray:
    """``n`` points at equal steps along a closed contour, from its first point."""
    p, n = ring(p), max(3, n)
    if len(p) < 2:
        return np.repeat(p, n, axis=0) if len(p) else np.zeros((0, 2))
    closed = np.concatenate([p, p[:1]])
    at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(closed, axis=0).T))])
    if at[-1] <= 1e-6:
        return np.repeat(p[:1], n, axis=0)
    s = np.arange(n) * (at[-1] / n)
    return np.stack([np.interp(s, at, closed[:, k]) for k in (0, 1)], axis=1)


def align(reference: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The winding and start of ``p`` with the least mean square distance to a reference of as many points; the first
    of equals, counter-clockwise before clockwise."""
    p = ccw(ring(p))
    if len(reference) != len(p):
        return p
    shifts = (np.arange(len(p))[:, None] + np.arange(len(p))) % len(p)
    both = np.concatenate([p[shifts], p[::-1][shifts]])
    return both[((both - reference) ** 2).sum(axis=(1, 2)).argmin()]


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest one-to-one assignment; -1 for rows left over (more rows than columns).

    Shortest augmenting paths over potentials, a row at a time.
    """
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.full(len(cost), -1)
    if cost.shape[0] > cost.shape[1]:
        of = np.full(cost.shape[0], -1)
        back = assign(cost.T)
        of[back] = np.arange(cost.shape[1])
        return of
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)
    for i in range(n):
        owner[m], j0 = i, m
        low, prev, done = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while owner[j0] != n:
            done[j0] = True
            r = owner[j0]
            free = ~done[:m]
            slack = cost[r] - u[r] - v[:m]
            better = free & (slack < low[:m])
            low[:m][better], prev[:m][better] = slack[better], j0
            j1 = int(np.where(free, low[:m], np.inf).argmin())
            delta = low[j1]
            u[owner[done]] += delta
            v[done] -= delta
            low[:m][free] -= delta
            j0 = j1
        while j0 != m:
            owner[j0] = owner[prev[j0]]
            j0 = prev[j0]
    out = np.full(n, -1)
    taken = owner[:m] < n
    out[owner[:m][taken]] = np.flatnonzero(taken)
    return out


def match_contours(before: list[np.ndarray], now: list[np.ndarray]) -> list[np.ndarray]:
    """Contours in the order of those before them: least sum of centre distance and 8 times the log of the area ratio."""
    now = sorted((ccw(ring(p)) for p in now), key=lambda p: (-abs(signed_area(p)), -len(p)))
    if len(before) != len(now):
        return now
    area = lambda p: max(abs(signed_area(p)), 1e-6)
    cost = np.array([[math.dist(a.mean(axis=0), b.mean(axis=0)) + 8 * abs(math.log(area(b) / area(a))) for b in now] for a in before])
    return [now[j] for j in assign(cost)]


def similarity(src: np.ndarray, dst: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(scale, angle, translation) that takes ``src`` nearest to ``dst``; as complex numbers, one ratio."""
    a, b = src @ (1, 1j), dst @ (1, 1j)
    if not len(a) or not len(b):
        return 1.0, 0.0, np.zeros(2)
    da, db = a - a.mean(), b - b.mean()
    spread = float((abs(da) ** 2).sum())
    z = (np.conj(da) * db).sum() / spread if len(a) > 1 and spread / len(a) > 1e-9 else 1.0 + 0j
    if abs(z) <= 1e-9:
        z = 1.0 + 0j
    shift = b.mean() - z * a.mean()
    return float(abs(z)), float(np.angle(z)), np.array([shift.real, shift.imag])


def motion(src: np.ndarray, dst: np.ndarray) -> dict[str, float]:
    """Translation, similarity and affine parts of a step between equally long contours, with what each leaves."""
    rms = lambda d: float(np.sqrt((d**2).sum(axis=1).mean()))
    step = dst.mean(axis=0) - src.mean(axis=0)
    scale, angle, shift = similarity(src, dst)
    c, s = scale * math.cos(angle), scale * math.sin(angle)
    turned = src @ np.array([[c, s], [-s, c]]) + shift
    basis = np.concatenate([src, np.ones((len(src), 1))], axis=1)
    affine = basis @ np.linalg.lstsq(basis, dst, rcond=None)[0]
    return {"dx": float(step[0]), "dy": float(step[1]), "scale": scale, "angle": angle, "rms_translation": rms(dst - src - step), "rms_similarity": rms(dst - turned), "rms_affine": rms(dst - affine)}


def simplify_rdp(p: np.ndarray, k: int) -> np.ndarray:
    """``k`` vertices of a contour, the farthest from the chords first, starting from its two most distant ones."""
    p = ccw(ring(p))
    k = max(3, k)
    if len(p) < k:
        p = resample(p, max(4 * k, 32))
    if k >= len(p):
        return p
    n = len(p)
    far = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    a, b = sorted(divmod(int(far.argmax()), n))
    heap: list[tuple] = []

    def split(i: int, j: int) -> None:
        inner = np.arange(i + 1, j if j > i else j + n) % n
        if len(inner):
            chord = p[j] - p[i]
            length = math.hypot(*chord)
            off = p[inner] - p[i]
            d = abs(chord[0] * off[:, 1] - chord[1] * off[:, 0]) / length if length > 0 else np.hypot(*off.T)
            heapq.heappush(heap, (-float(d.max()), i, j, int(inner[d.argmax()])))

    chosen = {a, b}
    split(a, b)
    split(b, a)
    while len(chosen) < k:
        _, i, j, m = heapq.heappop(heap)
        chosen.add(m)
        split(i, m)
        split(m, j)
    return p[sorted(chosen)]


def simplify_area(p: np.ndarray, k: int) -> np.ndarray:
    """``k`` vertices left after removing, again and again, the one whose triangle with its neighbours is smallest."""
    p = ccw(ring(p))
    alive, k = list(range(len(p))), max(3, k)
    while len(alive) > k:
        q = p[alive]
        a, b = np.roll(q, 1, axis=0), np.roll(q, -1, axis=0)
        size = abs((q[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]) - (q[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))
        alive.pop(int(size.argmin()))
    return p[alive]


def is_simple(p: np.ndarray) -> bool:
    """Whether no two edges of a contour that aren't neighbours meet."""
    p = ring(p)
    n = len(p)
    if n < 4:
        return n == 3
    q = np.roll(p, -1, axis=0)
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    i, j = i[keep], j[keep]
    side = lambda a, b, c: np.sign((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    o1, o2, o3, o4 = side(p[i], q[i], p[j]), side(p[i], q[i], q[j]), side(p[j], q[j], p[i]), side(p[j], q[j], q[i])
    lies = lambda a, b, c: np.all((np.minimum(a, b) <= c) & (c <= np.maximum(a, b)), axis=1)
    hit = (o1 != o2) & (o3 != o4)
    touch = ((o1 == 0) & lies(p[i], q[i], p[j])) | ((o2 == 0) & lies(p[i], q[i], q[j])) | ((o3 == 0) & lies(p[j], q[j], p[i])) | ((o4 == 0) & lies(p[j], q[j], q[i]))
    return not bool((hit | touch).any())


def principal_axes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, axes as rows, longest first)."""
    c = p.mean(axis=0)
    return c, np.linalg.svd(p - c, full_matrices=False)[2]


def scale_around(p: np.ndarray, factor: float) -> np.ndarray:
    c = p.mean(axis=0)
    return c + (p - c) * factor


def point_budget(areas: list[float], total: int, least: int = 3) -> list[int]:
    """Points for each contour of a mask by area: ``least`` each, the rest by largest remainder."""
    keep = sorted(range(len(areas)), key=lambda i: -areas[i])[: max(1, total // least)]
    spare, whole = total - least * len(keep), sum(areas[i] for i in keep) or 1.0
    share = {i: spare * areas[i] / whole for i in keep}
    out = {i: least + int(share[i]) for i in keep}
    for i in sorted(keep, key=lambda i: -(share[i] - int(share[i])))[: total - sum(out.values())]:
        out[i] += 1
    return [out.get(i, 0) for i in range(len(areas))]
