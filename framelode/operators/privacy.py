"""Masks that hide a face or its eyes, from a face ellipse and keypoints.

Works on one observation at a time, in Arrow batches. All lengths follow the face's size.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

#: Half extents of the eye mask as shares of the whole face, by what is known.
PAIR = {"width": (0.38, 0.59, 0.97), "height": (0.112, 0.235, 0.405)}
ALONE = {"width": 0.495, "height": 0.162, "height_max": 0.31}
NEAR, EYE_CONFIDENCE, FACE_POINTS, EYE_POINTS = 1.45, 0.35, 96, 64


def ellipse_points(cx: float, cy: float, a: float, b: float, theta: float, n: int) -> list[list[float]]:
    c, s = math.cos(theta), math.sin(theta)
    turn = [2 * math.pi * k / n for k in range(n)]
    return [[cx + a * math.cos(t) * c - b * math.sin(t) * s, cy + a * math.cos(t) * s + b * math.sin(t) * c] for t in turn]


def rectangle_points(cx: float, cy: float, a: float, b: float, theta: float) -> list[list[float]]:
    c, s = math.cos(theta), math.sin(theta)
    return [[cx + u * c - v * s, cy + u * s + v * c] for u, v in ((-a, -b), (a, -b), (a, b), (-a, b))]


class Face:
    """A face's own frame: ``local`` turns image points into shares of its half width and half height."""

    def __init__(self, ellipse: list[float], points: list[dict]):
        self.cx, self.cy, self.major, self.minor, theta = ellipse
        down = (math.cos(theta), math.sin(theta))
        lower = [p for p in points if p["valid"] and p["class_name"].lower() in ("nose", "mouth") and math.isfinite(p["x"] + p["y"])]
        if lower:  # nose and mouth lie below the centre
            lean = sum((p["x"] - self.cx) * down[0] + (p["y"] - self.cy) * down[1] for p in lower)
        else:
            lean = down[1]
        self.down = (-down[0], -down[1]) if lean < 0 else down
        self.across = (self.down[1], -self.down[0])

    def local(self, p: dict) -> tuple[float, float]:
        x, y = p["x"] - self.cx, p["y"] - self.cy
        return (x * self.across[0] + y * self.across[1]) / self.minor, (x * self.down[0] + y * self.down[1]) / self.major

    def place(self, u: float, v: float) -> tuple[float, float]:
        u, v = u * self.minor, v * self.major
        return self.cx + u * self.across[0] + v * self.down[0], self.cy + u * self.across[1] + v * self.down[1]


def _clamp(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


def derive(ellipse: list[float] | None, points: list[dict] | None, target: str = "eyes", shape: str = "ellipse", confidence: float = EYE_CONFIDENCE) -> dict | None:
    """Mask of a face or of its eyes; None without a finite ellipse of positive radii (cx, cy, major, minor, theta)."""
    if ellipse is None or None in ellipse or not all(map(math.isfinite, ellipse)) or min(ellipse[2:4]) <= 0:
        return None
    cx, cy, major, minor, theta = ellipse
    if target == "face":
        return {"target": "face", "polygon": ellipse_points(cx, cy, major, minor, theta, FACE_POINTS), "cx": cx, "cy": cy, "half_width": major, "half_height": minor, "theta": theta, "derivation": "face-ellipse", "confidence": 1.0}
    points = points or []
    face, width, height = Face(ellipse, points), 2 * minor, 2 * major
    eyes = [p for p in points if p["valid"] and p["class_name"].lower() == "eye" and math.isfinite(p["x"] + p["y"] + p["confidence"]) and p["confidence"] >= confidence]
    eyes.sort(key=lambda p: -p["confidence"])
    inside = lambda p: math.hypot(*face.local(p)) <= NEAR
    pair = eyes[:2] if len(eyes) > 1 else None
    if pair:
        dx, dy = pair[1]["x"] - pair[0]["x"], pair[1]["y"] - pair[0]["y"]
        apart = math.hypot(dx, dy)
        level = apart > 0 and abs(dx * face.across[0] + dy * face.across[1]) / apart >= 0.50
        if not (0.15 * width <= apart <= 1.10 * width and level and all(map(inside, pair))):
            pair = None
    if pair:
        low, high, by = PAIR["width"]
        a = _clamp(by * apart, low * width, high * width)
        low, high, by = PAIR["height"]
        b = _clamp(by * apart, low * height, high * height)
        at, theta = ((pair[0]["x"] + pair[1]["x"]) / 2, (pair[0]["y"] + pair[1]["y"]) / 2), math.atan2(dy, dx)
        how, sure = "eye-keypoints", min(p["confidence"] for p in pair)
    else:
        seen = [face.local(p) for p in eyes if inside(p)]
        mean = lambda k: sum(s[k] for s in seen) / len(seen)
        u, v = (_clamp(mean(0), -0.35, 0.35), _clamp(mean(1), -0.65, 0.40)) if seen else (0.0, -0.32)
        at, theta = face.place(u, v), math.atan2(face.across[1], face.across[0])
        a, b = ALONE["width"] * width, ALONE["height"] * height
        a_max, b_max = 1.08 * minor, ALONE["height_max"] * height
        if seen:
            a = min(a_max, max(a, max(abs(s[0] - u) for s in seen) * minor + 0.11 * width))
            b = min(b_max, max(b, max(abs(s[1] - v) for s in seen) * major + 0.06 * height))
            reach = max(math.hypot((s[0] - u) * minor / a, (s[1] - v) * major / b) for s in seen) / 0.88
            if shape == "ellipse" and reach > 1:
                a, b = min(a_max, a * reach), min(b_max, b * reach)
        how, sure = "ellipse-fallback", 0.0
    ring = ellipse_points(*at, a, b, theta, EYE_POINTS) if shape == "ellipse" else rectangle_points(*at, a, b, theta)
    return {"target": "eyes", "polygon": ring, "cx": at[0], "cy": at[1], "half_width": a, "half_height": b, "theta": theta, "derivation": how, "confidence": sure}


_MASK = pa.struct([("target", pa.string()), ("polygon", pa.list_(pa.list_(pa.float64()))), ("cx", pa.float64()), ("cy", pa.float64()), ("half_width", pa.float64()), ("half_height", pa.float64()), ("theta", pa.float64()), ("derivation", pa.string()), ("confidence", pa.float64())])


def privacy_masks(observations: DataFrame, target: str = "eyes", shape: str = "ellipse", confidence: float = EYE_CONFIDENCE) -> DataFrame:
    """(observation_id, mask struct) of observations (observation_id, ellipse array<double>, keypoints
    array<struct<x,y,class_name,confidence,valid>>); null where no mask can be derived."""
    if target not in ("face", "eyes") or shape not in ("ellipse", "rectangle") or not 0 <= confidence <= 1:
        raise ValueError("target is face or eyes, shape ellipse or rectangle, confidence from 0 to 1")

    def run(batches):
        for b in batches:
            got = [derive(e, k, target, shape, confidence) for e, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, _MASK)], names=["observation_id", "mask"])

    kind = dict(observations.dtypes)["observation_id"]
    shape_sql = "struct<target:string,polygon:array<array<double>>,cx:double,cy:double,half_width:double,half_height:double,theta:double,derivation:string,confidence:double>"
    return observations.select("observation_id", "ellipse", "keypoints").mapInArrow(run, f"observation_id {kind}, mask {shape_sql}")
