"""Trackers: greedy association of boxes and masks, and two-stage assignment of faces.

A scene cut clears all state, so scenes are tracked independently: one Arrow call per (video, scene), with state for
active tracks only. Numbers given inside a scene become the sequential counter's by ordering scenes afterwards. The
same trackers run over a stream in :mod:`framelode.streaming.trackers`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions.shapes import assign

from .grouped import per_group

#: Fixed values of greedy association by mean box area: (up to, IoU, centre distance, area ratio low, high, log aspect,
#: score). Masks are compared in the last band only.
GATES = np.array([
    (2000.0, 0.01, 1.00, 0.10, 7.0, 1.70, 0.12),
    (5000.0, 0.03, 0.80, 0.20, 6.0, 1.50, 0.15),
    (np.inf, 0.06, 0.50, 0.20, 5.0, 1.30, 0.20),
])
FILL_GATE, MASK_RATIO, MAX_GAP = 0.67, (0.25, 4.0), 15


def _pairs(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of all pairs of boxes (rows x1, y1, x2, y2)."""
    wa, ha = np.maximum(0, a[:, 2] - a[:, 0]), np.maximum(0, a[:, 3] - a[:, 1])
    wb, hb = np.maximum(0, b[:, 2] - b[:, 0]), np.maximum(0, b[:, 3] - b[:, 1])
    iw = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    ih = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.maximum(0, iw) * np.maximum(0, ih)
    sa, sb = wa * ha, wb * hb
    ca, cb = a[:, :2] + np.stack([wa, ha], axis=1) / 2, b[:, :2] + np.stack([wb, hb], axis=1) / 2
    d = np.hypot(cb[None, :, 0] - ca[:, None, 0], cb[None, :, 1] - ca[:, None, 1])
    diagonal = 0.5 * (np.hypot(wa, ha)[:, None] + np.hypot(wb, hb)[None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        aspect = np.abs(np.log((wb / hb)[None, :] / (wa / ha)[:, None]))
        ratio = sb[None, :] / sa[:, None]
    return {"iou": both / np.maximum(sa[:, None] + sb[None, :] - both, 1e-6), "distance": d, "diagonal": diagonal, "area": 0.5 * (sa[:, None] + sb[None, :]), "ratio": ratio, "aspect": aspect, "real": (sa[:, None] > 0) & (sb[None, :] > 0)}


def greedy_scores(tracks: np.ndarray, boxes: np.ndarray, track_mask: np.ndarray | None = None, mask: np.ndarray | None = None) -> np.ndarray:
    """Score of every (track, detection), nan where a gate shuts. ``mask`` are areas of masks, nan if unknown."""
    m = _pairs(tracks, boxes)
    g = GATES[np.searchsorted(GATES[:, 0], m["area"])]
    iou_min, far, low, high, bend, least = (g[..., k] for k in range(1, 7))
    distance = m["distance"] / (m["diagonal"] + 1e-6)
    with np.errstate(invalid="ignore"):
        ok = m["real"] & ((m["iou"] >= iou_min) | (distance <= far)) & (m["ratio"] >= low) & (m["ratio"] <= high) & (m["aspect"] <= bend)
    fill = np.full(m["iou"].shape, 0.5)
    if mask is not None and track_mask is not None:
        size = lambda b: np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.abs((mask / size(boxes))[None, :] - (track_mask / size(tracks))[:, None])
            share = mask[None, :] / np.maximum(track_mask[:, None], 1e-6)
        known = np.isfinite(gap) & (m["area"] > GATES[1, 0])
        ok &= ~(known & ((gap > FILL_GATE) | (share < MASK_RATIO[0]) | (share > MASK_RATIO[1])))
        fill = np.where(known, np.maximum(0, 1 - gap / FILL_GATE), fill)
    with np.errstate(invalid="ignore"):
        score = 0.5 * m["iou"] + 0.3 * np.maximum(0, 1 - distance / far) + 0.15 * np.maximum(0, 1 - m["aspect"] / bend) + 0.05 * fill
    return np.where(ok & (score >= least), score, np.nan)


@dataclass
class GreedyTracker:
    """Tracks of one scene. Pairs are taken best first; of equal scores the larger track, then the later detection."""

    max_gap: int = MAX_GAP
    next_id: int = 1
    ids: list = field(default_factory=list)
    last: list = field(default_factory=list)
    boxes: list = field(default_factory=list)
    masks: list = field(default_factory=list)

    def step(self, frame: int, boxes: np.ndarray, masks: np.ndarray) -> list[int]:
        """Ids of a frame's detections, given in order."""
        keep = [i for i, f in enumerate(self.last) if frame - f <= self.max_gap]
        self.ids, self.last, self.boxes, self.masks = ([x[i] for i in keep] for x in (self.ids, self.last, self.boxes, self.masks))
        out = [0] * len(boxes)
        if self.ids and len(boxes):
            score = greedy_scores(np.array(self.boxes), boxes, np.array(self.masks), masks)
            t, d = np.nonzero(~np.isnan(score))
            busy: set[int] = set()
            for k in np.lexsort((d, np.array(self.ids)[t], score[t, d]))[::-1]:
                i, j = int(t[k]), int(d[k])
                if not out[j] and i not in busy:
                    busy.add(i)
                    out[j] = self.ids[i]
                    self.last[i], self.boxes[i], self.masks[i] = frame, boxes[j].tolist(), float(masks[j])
        for j, mine in enumerate(out):
            if not mine:
                out[j] = self.next_id
                self.ids.append(self.next_id)
                self.last.append(frame)
                self.boxes.append(boxes[j].tolist())
                self.masks.append(float(masks[j]))
                self.next_id += 1
        return out


#: Fixed values of face tracking.
FACE = {"max_gap": 5, "high": 0.50, "low": 0.05, "iou": 0.08, "distance": 0.85, "ratio": (0.20, 5.0), "score": 0.18, "short_hits": 2, "keep_score": 0.90}


def face_scores(tracks: np.ndarray, boxes: np.ndarray, c: dict = FACE) -> np.ndarray:
    m = _pairs(tracks, boxes)
    distance = m["distance"] / np.maximum(m["diagonal"], 1e-6)
    area = lambda b: np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])
    ratio = area(boxes)[None, :] / np.maximum(area(tracks)[:, None], 1e-6)
    ok = ((m["iou"] >= c["iou"]) | (distance <= c["distance"])) & (ratio >= c["ratio"][0]) & (ratio <= c["ratio"][1])
    score = 0.65 * m["iou"] + 0.25 * np.maximum(0, 1 - distance / c["distance"]) + 0.10 * np.exp(-np.abs(np.log(np.maximum(ratio, 1e-6))))
    return np.where(ok & (score >= c["score"]), score, np.nan)


@dataclass
class FaceTracker:
    """Two stages: confident observations first, then weak ones against tracks left; anything unmatched starts a track."""

    config: dict = field(default_factory=lambda: dict(FACE))
    next_serial: int = 1
    active: list = field(default_factory=list)

    def _summary(self, t: dict, reason: str) -> dict:
        removed = t["hits"] <= self.config["short_hits"] and t["top"] < self.config["keep_score"]
        return {"serial": t["serial"], "start": t["start"], "end": t["last"], "hits": t["hits"], "top": t["top"], "mean": t["total"] / t["hits"], "removed": removed, "reason": reason}

    def finish(self, reason: str = "end_of_stream") -> list[dict]:
        out = [self._summary(t, reason) for t in self.active]
        self.active = []
        return out

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray) -> tuple[list[tuple[int, str]], list[dict]]:
        """((serial, stage) for each observation, summaries of tracks that ended)."""
        c = self.config
        ended = [self._summary(t, "max_gap") for t in self.active if frame - t["last"] > c["max_gap"]]
        self.active = [t for t in self.active if frame - t["last"] <= c["max_gap"]]
        out: list = [None] * len(boxes)
        left, fresh = list(self.active), []
        for name, rows in (("high", np.flatnonzero(scores >= c["high"])), ("low", np.flatnonzero((scores >= c["low"]) & (scores < c["high"])))):
            taken: set[int] = set()
            if left and len(rows):
                s = face_scores(np.array([t["box"] for t in left]), boxes[rows], c)
                for i, j in enumerate(assign(np.where(np.isnan(s), 1e6, 1 - s))):
                    if j >= 0 and not np.isnan(s[i, j]):
                        t, r = left[i], int(rows[j])
                        t["last"], t["box"], t["hits"] = frame, boxes[r].tolist(), t["hits"] + 1
                        t["total"] += float(scores[r])
                        t["top"] = max(t["top"], float(scores[r]))
                        out[r] = (t["serial"], name)
                        taken.add(i)
            left = [t for i, t in enumerate(left) if i not in taken]
            fresh += [(int(r), f"new_{name}") for r in rows if out[r] is None]
        fresh += [(int(r), "new_below_low") for r in np.flatnonzero(scores < c["low"])]
        for r, stage in fresh:
            s = float(scores[r])
            self.active.append({"serial": self.next_serial, "start": frame, "last": frame, "box": boxes[r].tolist(), "hits": 1, "total": s, "top": s})
            out[r] = (self.next_serial, stage)
            self.next_serial += 1
        return out, ended


def _frames(t: pa.Table):
    """(frame, rows of it) in order of frames, rows by idx."""
    frame, idx = t["frame"].to_numpy(), t["idx"].to_numpy()
    order = np.lexsort((idx, frame))
    edges = np.flatnonzero(np.diff(frame[order])) + 1
    for rows in np.split(order, edges) if len(order) else ():
        yield int(frame[rows[0]]), rows


def _boxes(t: pa.Table) -> np.ndarray:
    return np.stack([t[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2")], axis=1)


def track_boxes(detections: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Adds ``track`` to detections (video, scene, frame, idx, x1, y1, x2, y2, optional mask_area): greedy association.

    Numbers are those of one counter over a video: tracks by their first frame, then idx.
    """
    rows = detections if "mask_area" in detections.columns else detections.withColumn("mask_area", F.lit(None).cast("double"))

    def run(t: pa.Table) -> pa.Table:
        tracker, local = GreedyTracker(max_gap), np.zeros(len(t), np.int64)
        boxes, masks = _boxes(t), np.array(t["mask_area"].to_pylist(), float)
        for frame, rows in _frames(t):
            local[rows] = tracker.step(frame, boxes[rows], masks[rows])
        return t.append_column("local", pa.array(local))

    got = per_group(rows, ["video", "scene"], run, rows.withColumn("local", F.lit(0).cast("long")).schema)
    firsts = got.groupBy("video", "scene", "local").agg(F.min(F.struct("frame", "idx")).alias("first"))
    firsts = firsts.withColumn("track", F.row_number().over(Window.partitionBy("video").orderBy("first.frame", "first.idx")).cast("long"))
    return got.join(firsts.select("video", "scene", "local", "track"), ["video", "scene", "local"]).select(*detections.columns, "track")


def track_faces(observations: DataFrame, summaries: bool = False) -> DataFrame:
    """Two-stage tracking of observations (video, scene, frame, idx, x1, y1, x2, y2, score).

    Adds ``raw_track`` 'face:raw:{scene}:{serial}' and ``stage``; or, with ``summaries``, a row for each track with its
    span, hits, scores, whether it is too short to keep, and why it ended ('cut' unless the scene is the last).
    Serials count over the scenes of a video.
    """
    tail = {"serial": "long", "start": "long", "end": "long", "hits": "long", "top": "double", "mean": "double", "removed": "boolean", "reason": "string"}

    def run(t: pa.Table) -> pa.Table:
        tracker, boxes, score = FaceTracker(), _boxes(t), np.array(t["score"].to_pylist(), float)
        serial, stage, ended = np.zeros(len(t), np.int64), [""] * len(t), []
        for frame, rows in _frames(t):
            got, done = tracker.step(frame, boxes[rows], score[rows])
            ended += done
            for r, (s, name) in zip(rows, got, strict=True):
                serial[r], stage[r] = s, name
        if not summaries:
            return t.append_column("serial", pa.array(serial)).append_column("stage", pa.array(stage, pa.string()))
        ended += tracker.finish()
        head = {c: t[c].slice(0, 1).take(pa.array([0] * len(ended))) for c in ("video", "scene")}
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        return pa.table(head | {c: pa.array([e[c] for e in ended], kinds[k]) for c, k in tail.items()})

    if summaries:
        kinds = dict(observations.dtypes)
        shape = f"video {kinds['video']}, scene {kinds['scene']}, " + ", ".join(f"{c} {k}" for c, k in tail.items())
        got = per_group(observations, ["video", "scene"], run, shape)
    else:
        got = per_group(observations, ["video", "scene"], run, observations.withColumn("serial", F.lit(0).cast("long")).withColumn("stage", F.lit("")).schema)
    counts = got.groupBy("video", "scene").agg(F.max("serial").alias("n"))
    w = Window.partitionBy("video").orderBy("scene")
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("is_last", F.lead("scene").over(w).isNull())
    out = got.join(counts.drop("n"), ["video", "scene"]).withColumn("raw_track", F.concat_ws(":", F.lit("face:raw"), F.col("scene").cast("string"), (F.col("serial") + F.col("before")).cast("string")))
    if summaries:
        return out.withColumn("reason", F.when((F.col("reason") == "end_of_stream") & ~F.col("is_last"), "cut").otherwise(F.col("reason"))).drop("serial", "before", "is_last")
    return out.drop("serial", "before", "is_last")
