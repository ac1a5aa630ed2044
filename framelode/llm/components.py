"""Connected components of a link table by alternating large-star and small-star joins.

Links and labels stay in tables: every round is two grouped minimums joined back to the links, written to the
shared folder. A pass of union-find inside each partition first thins the links to a forest per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

_LINK = "u long, v long"
#: Links, thinned, up to which one task finishes: rounds of joins cost more than so many rows.
FEW_LINKS = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    us = [x for x in parent if find(x) != x]
    for at in range(0, len(us), 50_000):
        part = us[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())


def connected_components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """``links`` (u long, v long), any direction, repeats and self-links allowed -> (node long, root long).

    ``root`` is the smallest node reachable from ``node``. Nodes without a link to another node are left out;
    rows with a null end are ignored; an empty input gives an empty result. Up to ``few`` links that are left by the
    union-find in each partition go through one more in a single task, more through rounds of joins.
    """
    links = links.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialise(links.mapInArrow(_forest, _LINK).distinct(), "links")
    seen = _signature(e)
    if 0 < seen[0] <= few:
        whole = materialise(e.coalesce(1).mapInArrow(_forest, _LINK), "whole")
        discard(e)
        e = whole
    rounds = seen[0] > few
    while rounds:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minimums are written before they are joined, so that Spark can split the links of a hub
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = materialise(both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least.hint("merge"), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        small = materialise(small.distinct(), "small-star")
        now = _signature(small)
        discard(e, large, low, least)
        e, done = small, now == seen
        seen, rounds = now, not done
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


__all__ = ["connected_components"]
