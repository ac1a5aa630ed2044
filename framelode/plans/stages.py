"""Stages over named tables: what each needs and makes, checked before anything runs, planned lazily as one job."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    requires: tuple[str, ...]
    provides: tuple[str, ...]
    run: Callable[[Tables, Mapping], Tables]


_STAGES: dict[str, Callable[[], Stage]] = {}


def register(name: str, factory: Callable[[], Stage]) -> None:
    if name in _STAGES:
        raise ValueError(f"stage {name} is registered already")
    _STAGES[name] = factory


def resolve(name: str) -> Stage:
    """A registered stage, or ``module:attribute``."""
    if name in _STAGES:
        return _STAGES[name]()
    if ":" in name:
        module, attribute = name.split(":", 1)
        return getattr(importlib.import_module(module), attribute)
    raise KeyError(f"no stage {name}; there are {sorted(_STAGES)}")


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...]

    def check(self, have: set[str]) -> None:
        have = set(have)
        for s in self.stages:
            if missing := set(s.requires) - have:
                raise ValueError(f"stage {s.name} needs {sorted(missing)}")
            if twice := set(s.provides) & have:
                raise ValueError(f"stage {s.name} would replace {sorted(twice)}")
            have |= set(s.provides)

    def plan(self, sources: Tables, options: Mapping | None = None) -> dict[str, DataFrame]:
        """All tables, lazily: Catalyst sees through the stages."""
        self.check(set(sources))
        out = dict(sources)
        for s in self.stages:
            made = s.run(out, (options or {}).get(s.name, {}))
            if set(made) != set(s.provides):
                raise ValueError(f"stage {s.name} made {sorted(made)}, not {sorted(s.provides)}")
            out |= made
        return out

    def manifest(self) -> list[dict]:
        return [{"name": s.name, "requires": list(s.requires), "provides": list(s.provides)} for s in self.stages]


def _score(t: Tables, o: Mapping) -> Tables:
    from framelode.operators.filters import DEFAULT_SCORE, score_policy

    return {"scored": score_policy(t["detections"], o.get("policy", {"default": DEFAULT_SCORE, "classes": {}}))}


def _nms(t: Tables, o: Mapping) -> Tables:
    from framelode.operators.nms import box_nms

    return {"kept": box_nms(t["scored"], ["video", "frame"])}


def _scene(t: Tables, o: Mapping) -> Tables:
    from framelode.operators.tracks import scene_of

    return {"placed": scene_of(t["kept"], t["cuts"])}


def _track(t: Tables, o: Mapping) -> Tables:
    from framelode.operators.track import track_boxes

    return {"tracked": track_boxes(t["placed"], o.get("max_gap", 15))}


def _resolve_tracks(t: Tables, o: Mapping) -> Tables:
    from framelode.operators.tracks import resolve

    from pyspark.sql import functions as F

    ids = t["tracked"].withColumn("order", F.col("frame") * 1_000_000 + F.col("idx"))
    return {"tracks": resolve(ids, "order", o.get("max_short", 10))}


for _name, _args in {
    "score_policy": (("detections",), ("scored",), _score),
    "nms": (("scored",), ("kept",), _nms),
    "scene": (("kept", "cuts"), ("placed",), _scene),
    "tracking": (("placed",), ("tracked",), _track),
    "resolution": (("tracked",), ("tracks",), _resolve_tracks),
}.items():
    register(_name, lambda n=_name, a=_args: Stage(n, *a))


def default_pipeline() -> Pipeline:
    return Pipeline(tuple(resolve(n) for n in ("score_policy", "nms", "scene", "tracking", "resolution")))
