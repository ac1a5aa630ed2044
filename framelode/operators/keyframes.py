"""Selection and editing of keyframes, per segment.

A segment's samples are one bounded group (long runs are cut with :func:`framelode.operators.tracks.chunks`), so the
dynamic programmes run in one Arrow call per segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tracks
from .grouped import per_group


def fixed_interval(rows: DataFrame, interval: int) -> DataFrame:
    """Keyframes of contiguous runs: every ``interval``-th frame from the start, and both ends.

    (track, run, frame, keyframe_index, reason): 'segment_endpoint' for the ends, 'fixed_interval' for the others.
    """
    r = tracks.runs(rows, ["track"])
    w = Window.partitionBy("track", "run")
    r = r.withColumn("lo", F.min("frame").over(w)).withColumn("hi", F.max("frame").over(w))
    end = (F.col("frame") == F.col("lo")) | (F.col("frame") == F.col("hi"))
    k = r.where(end | ((F.col("frame") - F.col("lo")) % interval == 0)).withColumn("reason", F.when(end, "segment_endpoint").otherwise("fixed_interval"))
    return k.withColumn("keyframe_index", F.row_number().over(w.orderBy("frame")) - 1).drop("lo", "hi")


def interval_errors(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared error of interpolating q (n, d) between samples i < j, for all pairs, from prefix sums."""
    n = len(t)
    s = lambda x: np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    one, st, stt = s(np.ones(n)), s(t.astype(float)), s(t.astype(float) ** 2)
    sq, stq, sqq = s(q), s(t[:, None] * q), s((q**2).sum(axis=1))
    out = np.full((n, n), np.inf)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        slope = (q[j] - q[i]) / (t[j] - t[i])[:, None]
        base = q[i] - slope * t[i]
        c, ct, ctt = one[j + 1] - one[i], st[j + 1] - st[i], stt[j + 1] - stt[i]
        cq, ctq, cqq = sq[j + 1] - sq[i], stq[j + 1] - stq[i], sqq[j + 1] - sqq[i]
        out[i, j] = np.maximum(0, cqq - 2 * (base * cq + slope * ctq).sum(axis=1) + ((base**2).sum(axis=1) * c + 2 * (base * slope).sum(axis=1) * ct + (slope**2).sum(axis=1) * ctt))
    return out


def exact_k_path(t: np.ndarray, cost: np.ndarray, k: int, max_gap: int) -> list[int]:
    """The cheapest path of ``k`` samples from the first to the last with steps of at most ``max_gap`` frames; more
    samples if ``k`` can't span them."""
    n = len(t)
    cost = np.where(t[None, :] - t[:, None] > max_gap, np.inf, cost)
    # a step between neighbours is always allowed
    cost[np.arange(n - 1), np.arange(1, n)] = np.where(np.isfinite(cost[np.arange(n - 1), np.arange(1, n)]), cost[np.arange(n - 1), np.arange(1, n)], 0)
    best, back = np.full(n, np.inf), []
    best[0] = 0
    for step in range(1, n):
        total = best[:, None] + cost
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
        if step >= k - 1 and np.isfinite(best[-1]):
            break
    path = [n - 1]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def penalised_path(cost: np.ndarray, penalty: float) -> list[int]:
    n = len(cost)
    best, back = np.full(n, np.inf), np.zeros(n, int)
    best[0] = 0
    for j in range(1, n):
        total = best[:j] + cost[:j, j] + penalty
        back[j] = int(total.argmin())
        best[j] = total[back[j]]
    path = [n - 1]
    while path[-1]:
        path.append(int(back[path[-1]]))
    return path[::-1]


def path_of_size(cost: np.ndarray, target: int, steps: int = 12, most: float = 1024.0) -> list[int]:
    """Penalised path whose size comes nearest to ``target``, by halving the penalty's range."""
    scale = float(np.max(cost[np.isfinite(cost)], initial=0.0)) or 1.0
    lo, hi, found = 0.0, most * scale, penalised_path(cost, 0.0)
    for _ in range(steps):
        mid = (lo + hi) / 2
        path = penalised_path(cost, mid)
        if abs(len(path) - target) < abs(len(found) - target) or (abs(len(path) - target) == abs(len(found) - target) and len(path) < len(found)):
            found = path
        if len(path) > target:
            lo = mid
        else:
            hi = mid
    return found


def candidates(t: np.ndarray, q: np.ndarray, cost: np.ndarray, interval: int = 6, radius: int = 1, peak: float = 1.2) -> np.ndarray:
    """Samples worth considering: ends, a surrogate path and its neighbours, saliency peaks, and a grid."""
    n = len(t)
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    keep[::interval] = True
    for p in path_of_size(cost, max(2, n // interval + 1)):
        keep[max(0, p - radius) : p + radius + 1] = True
    if n > 2:
        bend = np.linalg.norm(q[2:] - 2 * q[1:-1] + q[:-2], axis=1)
        keep[1:-1] |= bend > peak * max(bend.mean(), 1e-12)
    return np.flatnonzero(keep)


def pair_vote(t: np.ndarray, q: np.ndarray, path: list[int], sweeps: int = 2) -> np.ndarray:
    """Values at the keys of ``path`` after least squares on each interval, averaged where intervals meet by length."""
    values = q[path].astype(float)
    for _ in range(sweeps):
        total, weight = np.zeros_like(values), np.zeros(len(path))
        for s, (a, b) in enumerate(zip(path[:-1], path[1:], strict=True)):
            u = (t[a : b + 1] - t[a]) / (t[b] - t[a])
            basis = np.stack([1 - u, u], axis=1)
            fit = np.linalg.lstsq(basis, q[a : b + 1], rcond=None)[0]
            for k, row in ((s, fit[0]), (s + 1, fit[1])):
                total[k] += row * (b - a)
                weight[k] += b - a
        values = total / np.maximum(weight, 1)[:, None]
    return values


def compress(samples: DataFrame, columns: list[str], interval: int = 6, max_gap: int = 30) -> DataFrame:
    """(track, segment, frame, keyframe_index, columns): keyframes of each (track, segment) by an exact-size path over
    candidates, values refined by pair votes, ends as observed."""

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("frame")
        t, q = g["frame"].to_numpy().astype(float), np.stack([g[c].to_numpy().astype(float) for c in columns], axis=1)
        if len(t) < 3:
            path, values = list(range(len(t))), q
        else:
            cost = interval_errors(t, q)
            pick = candidates(t, q, cost, interval)
            k = max(2, min(len(pick), -(-int(t[-1] - t[0]) // interval) + 1))
            path = [int(pick[i]) for i in exact_k_path(t[pick], cost[np.ix_(pick, pick)], k, max_gap)]
            values = pair_vote(t, q, path)
            values[0], values[-1] = q[0], q[-1]
        n = len(path)
        out = {"track": g["track"].slice(0, 1).take(pa.array([0] * n)), "segment": g["segment"].slice(0, 1).take(pa.array([0] * n)), "frame": g["frame"].take(pa.array(path)), "keyframe_index": pa.array(range(n), pa.int32())}
        return pa.table(out | {c: pa.array(values[:, i]) for i, c in enumerate(columns)})

    kinds = dict(samples.dtypes)
    shape = f"track {kinds['track']}, segment {kinds['segment']}, frame {kinds['frame']}, keyframe_index int, " + ", ".join(f"{c} double" for c in columns)
    return per_group(samples.select("track", "segment", "frame", *columns), ["track", "segment"], run, shape)


def provenance_violations(used: DataFrame, keys: DataFrame) -> DataFrame:
    """Frames of ``used`` (segment, frame) that keyframes of their segment don't bracket: bounds instead of a range join."""
    span = keys.groupBy("segment").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    return used.join(span, "segment", "left").where("lo IS NULL OR frame < lo OR frame > hi").select("segment", "frame")
