"""Trackers and windows over streams.

State is a tracker of one (video, scene): active tracks only. Frames of a key must come in order; a frame older than
the last one seen is late and its detections start no match (they come back with track 0).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelode.operators.track import GreedyTracker


def track_stream(detections: DataFrame, max_gap: int = 15) -> DataFrame:
    """(video, scene, frame, idx, track): greedy tracking of a stream, numbered within its scene."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last = pickle.loads(state.get[0]) if state.exists else (GreedyTracker(max_gap), -1)
        rows = pd.concat(list(parts)).sort_values(["frame", "idx"])
        for frame, g in rows.groupby("frame", sort=True):
            ids = [0] * len(g)
            if frame > last:
                ids = tracker.step(int(frame), g[["x1", "y1", "x2", "y2"]].to_numpy(float), np.full(len(g), np.nan))
                last = int(frame)
            yield pd.DataFrame({"video": key[0], "scene": key[1], "frame": g["frame"].to_numpy(), "idx": g["idx"].to_numpy(), "track": ids})
        state.update((pickle.dumps((tracker, last)),))

    return detections.groupBy("video", "scene").applyInPandasWithState(run, "video long, scene long, frame long, idx long, track long", "tracker binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, size: str, late: str, keys: list[str], value: str) -> DataFrame:
    """(window_start, keys, n, total) by tumbling event-time windows; rows later than ``late`` are left out."""
    g = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """(key, start, end, n): sessions of a known identity that close after ``gap`` without events."""
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
