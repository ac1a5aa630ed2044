"""Set operations and changes of tables, as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; a null in ``new`` leaves the old value."""
    o, n = old.select(F.struct("*").alias("o"), *keys), new.select(F.struct("*").alias("n"), *keys)
    j = o.join(n, keys, "full")
    return j.select([F.col(c) if c in keys else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, one of each key: the first by ``order``."""
    first = Window.partitionBy(*keys).orderBy(order)
    fresh = new.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k").join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, repeats counted, over the columns both have; ``side`` says which."""
    cols = [c for c in a.columns if c in b.columns]
    a, b = a.select(cols), b.select(cols)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def renumber(rows: DataFrame, keys: list[str], offset: int = 0) -> DataFrame:
    """(keys, new_id): dense ids in key order, after ``offset``; ids of an import on top of those there."""
    k = rows.select(*keys).distinct()
    return k.withColumn("new_id", F.row_number().over(Window.orderBy(*keys)) + offset)


def run_ledger(ledger: DataFrame, run: DataFrame) -> DataFrame:
    """Ledger rows (kind, config_sha, ...) replaced by those of ``run`` with the same kind and config."""
    return delete_keys(ledger, run, ["kind", "config_sha"]).unionByName(run)


def config_sha(*columns: str) -> F.Column:
    """Digest of the canonical JSON of some columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
