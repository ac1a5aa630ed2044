"""Contract rules: each is a table that must be empty. A report counts what violates them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) over all rules in one plan."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def mask_rules(masks: DataFrame, cuts: DataFrame, declared_cuts: DataFrame) -> dict[str, DataFrame]:
    """Rules of a mask table (frame, track, polygons) and of the declared number of cuts (cut_count)."""
    counted = cuts.agg(F.count("*").alias("n"))
    return {
        "frame_not_negative": masks.where("frame < 0"),
        "track_not_empty": masks.where("track IS NULL OR trim(CAST(track AS STRING)) = ''"),
        "polygons_present": masks.where("polygons IS NULL"),
        "key_unique": masks.groupBy("frame", "track").count().where("count > 1"),
        "cut_count_matches": declared_cuts.crossJoin(F.broadcast(counted)).where("cut_count <> n"),
    }


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key the parent table lacks (null keys aside)."""
    p = parent.select(F.col(parent_key).alias("pk"))
    return child.where(F.col(child_key).isNotNull()).join(p, F.col(child_key) == p.pk, "left_anti")


def group_size(rows: DataFrame, keys: list[str], least: int, most: int | None = None) -> DataFrame:
    """Groups whose number of rows is out of bounds."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(~F.col("n").between(least, least if most is None else most))


def either_key(rows: DataFrame, other: DataFrame, keys: tuple[str, str], other_key: str) -> DataFrame:
    """Rows that meet ``other`` on one key OR the other, as two equality joins and a union (an OR join would be a
    nested loop)."""
    a = rows.join(other, F.col(keys[0]) == F.col(other_key))
    b = rows.where(F.col(keys[0]).isNull() | F.col(keys[1]).isNull() | (F.col(keys[0]) != F.col(keys[1]))).join(other, F.col(keys[1]) == F.col(other_key))
    return a.unionByName(b)
