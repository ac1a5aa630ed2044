"""Scene cuts from per-frame difference features. A cut is the first frame of a new scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tracks import refractory


def frame_diff_cuts(frames: DataFrame, threshold: float = 18.0, min_gap: int = 15) -> DataFrame:
    """(video, frame): frames whose difference reaches ``threshold``, more than ``min_gap`` after the last cut."""
    return refractory(frames.where(F.col("diff") >= threshold), ["video"], min_gap)


def high_precision_cuts(frames: DataFrame, min_gap: int = 45) -> DataFrame:
    """(video, frame): as above, with middling differences confirmed by histogram correlation and structure.

    From 70 a difference is a cut; from 45 if corr <= 0.98 and ssim <= 0.55; from 30 if corr <= 0.96 and ssim <= 0.45.
    """
    is_cut = (
        F.when(F.col("diff") < 30, False)
        .when(F.col("diff") >= 70, True)
        .when(F.col("diff") >= 45, (F.col("corr") <= 0.98) & (F.col("ssim") <= 0.55))
        .otherwise((F.col("corr") <= 0.96) & (F.col("ssim") <= 0.45))
    )
    return refractory(frames.where(is_cut), ["video"], min_gap)
