"""Summaries of ordered resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions.geometry import floor_percentile


def summary(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, count, minimum, maximum, mean, p50, p95) with floor-index percentiles."""
    return samples.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("mean"), floor_percentile(value, 0.5).alias("p50"), floor_percentile(value, 0.95).alias("p95"))


def slope_per_hour(samples: DataFrame, keys: list[str], seconds: str, value: str) -> DataFrame:
    """Least-squares slope per hour; null under three samples or without spread in time."""
    return samples.groupBy(*keys).agg(F.when(F.count(value) >= 3, F.regr_slope(value, seconds) * 3600).alias("slope"))


def quarter_change(samples: DataFrame, keys: list[str], seconds: str, value: str) -> DataFrame:
    """Median of the first and of the last quarter of each series, and the change in per cent.

    Places come from a window by series; a quarter is floor(n / 4) samples, one at least.
    """
    w = Window.partitionBy(*keys)
    s = samples.withColumn("k", F.row_number().over(w.orderBy(seconds, value))).withColumn("n", F.count("*").over(w))
    part = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    g = s.groupBy(*keys).agg(F.median(F.when(F.col("k") <= part, F.col(value))).alias("first"), F.median(F.when(F.col("k") > F.col("n") - part, F.col(value))).alias("last"))
    return g.withColumn("change", F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first") * 100))


def stable_tail(samples: DataFrame, keys: list[str], seconds: str, share: float = 0.4, least: int = 20) -> DataFrame:
    """The last ``share`` of series of at least ``least`` samples; shorter series whole."""
    w = Window.partitionBy(*keys)
    s = samples.withColumn("k", F.row_number().over(w.orderBy(seconds))).withColumn("n", F.count("*").over(w))
    return s.where((F.col("n") < least) | (F.col("k") > F.col("n") - F.floor(F.col("n") * share))).drop("k", "n")


def phase(rules: list[tuple[str, Column]], other: str = "idle") -> Column:
    """The first rule that holds names the phase."""
    chain = None
    for name, rule in rules:
        chain = (F if chain is None else chain).when(rule, name)
    return chain.otherwise(other)


def by_job(samples: DataFrame, text: str, pattern: str) -> DataFrame:
    """A row for each distinct job id that a sample's text names: samples may belong to several jobs."""
    return samples.withColumn("job", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))))


def active_intervals(samples: DataFrame, keys: list[str], order: str, active: Column) -> DataFrame:
    """(keys, intervals, returns): times a series becomes active, and times it becomes idle again."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = samples.withColumn("a", active).withColumn("p", F.coalesce(F.lag("a").over(w), F.lit(False)))
    return s.groupBy(*keys).agg(F.sum(F.when(F.col("a") & ~F.col("p"), 1).otherwise(0)).alias("intervals"), F.sum(F.when(~F.col("a") & F.col("p"), 1).otherwise(0)).alias("returns"))


def regressions(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, regressions): samples below the one before them by more than 1e-9."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = samples.withColumn("p", F.lag(value).over(w))
    return s.groupBy(*keys).agg(F.sum(F.when(F.col(value) + 1e-9 < F.col("p"), 1).otherwise(0)).alias("regressions"))


def parse_lines(lines: DataFrame, column: str, data: str) -> DataFrame:
    """Adds ``level``, ``job`` and ``data`` from lines like ``[WARN] job=7 @@json {...}``; nulls where absent."""
    part = lambda p: F.nullif(F.regexp_extract(column, p, 1), F.lit(""))
    return lines.withColumn("level", F.lower(part(r"^\[(\w+)\]"))).withColumn("job", part(r"\bjob=(\d+)").cast("long")).withColumn("data", F.from_json(part(r"@@json (\{.*\})"), data))
