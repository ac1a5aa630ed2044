"""Settings by class: a small table joined to the rows, so that nothing has to be split and merged again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FALLBACK = {"keyframe_interval": 6}
_KNOWN = frozenset(("keyframe_interval", "shape"))


def load_policy(text: str) -> dict:
    """Policy of schema version 1 or 2. Unknown keys and shapes other than polygons are refused."""
    raw = json.loads(text)
    if raw.get("schema_version") not in (1, 2):
        raise ValueError("unsupported schema_version")
    if extra := set(raw) - {"schema_version", "default", "classes"}:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    out = {"default": raw.get("default") or {}, "classes": raw.get("classes") or {}}
    for name, s in [("default", out["default"]), *out["classes"].items()]:
        if extra := set(s) - _KNOWN:
            raise ValueError(f"unknown keys of {name}: {sorted(extra)}")
        if s.get("shape", "polygon") != "polygon":
            raise ValueError(f"{name}: only polygons are supported")
        if not 1 <= int(s.get("keyframe_interval", 1)) <= 1000:
            raise ValueError(f"{name}: keyframe_interval is out of range")
    return out


def route(rows: DataFrame, policy: dict, label: str = "label") -> DataFrame:
    """Adds ``keyframe_interval``: of the row's class, else the default, else the fallback."""
    first = policy["default"].get("keyframe_interval", FALLBACK["keyframe_interval"])
    chain = None
    for name, s in policy["classes"].items():
        if "keyframe_interval" in s:
            chain = (F if chain is None else chain).when(F.col(label) == name, F.lit(int(s["keyframe_interval"])))
    value = F.lit(int(first)) if chain is None else chain.otherwise(F.lit(int(first)))
    return rows.withColumn("keyframe_interval", value.cast("long"))


def uncovered(tracks: DataFrame, routed: DataFrame) -> DataFrame:
    """Tracks that no route took: must be empty."""
    return tracks.join(routed, "track", "left_anti")


def merge(routes: list[DataFrame]) -> DataFrame:
    """Rows of disjoint routes together; :func:`collisions` of them must be empty."""
    out = routes[0]
    for r in routes[1:]:
        out = out.unionByName(r)
    return out


def collisions(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("frame", "track")) -> DataFrame:
    return a.join(b, list(keys), "left_semi").select(*keys)
