"""Many small groups in few Arrow batches.

``applyInArrow`` sends one stream for each group, which costs more than the work where groups are frames of a dozen
boxes. Here rows are dealt and sorted by key, batches hold thousands of groups, and groups are cut apart in Python. A group
is held whole, as it would be there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def edges(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where a row's keys differ from those of the row before it; nulls are equal."""
    change = np.zeros(max(0, len(t) - 1), bool)
    for k in keys:
        c = t[k].combine_chunks()
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        change |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(change) + 1


def per_group(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: StructType | str) -> DataFrame:
    """``run`` of every group's table, as ``rows.groupBy(keys).applyInArrow(run, schema)`` would give."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in parts:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            if held:
                t = pa.concat_tables([*held, t])
            cut = edges(t, keys)
            out = [run(t.slice(x, y - x)) for x, y in zip([0, *cut[:-1]], cut, strict=True)] if len(cut) else []
            held = [t.slice(cut[-1]) if len(cut) else t]
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
        if held:
            yield from run(pa.concat_tables(held)).combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(batches, schema)
