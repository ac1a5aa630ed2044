"""Nested JSON metadata as (path, value, type) rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(value, path: str = "") -> Iterator[tuple[str, str, str]]:
    """Leaves of a JSON value with dotted paths: text and type. Empty containers and nulls are leaves of their own type, with
    an empty text; booleans are 1 and 0."""
    if isinstance(value, dict):
        if not value:
            yield path, "", "empty_mapping"
        for k, v in value.items():
            yield from entries(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        if not value:
            yield path, "", "empty_sequence"
        for i, v in enumerate(value):
            yield from entries(v, f"{path}.{i}" if path else str(i))
    elif value is None:
        yield path, "", "null"
    elif isinstance(value, bool):
        yield path, "1" if value else "0", "bool"
    elif isinstance(value, (int, float)):
        yield path, repr(value), type(value).__name__
    else:
        yield path, str(value), "str"


def flatten(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value, value_type) for every leaf of the JSON in ``column``; null JSON has none."""

    def run(batches):
        for b in batches:
            ks, ps, vs, ts = [], [], [], []
            for k, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p, v, t in entries(json.loads(doc)) if doc is not None else ():
                    ks.append(k)
                    ps.append(p)
                    vs.append(v)
                    ts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ks, b.schema.field(0).type), pa.array(ps, pa.string()), pa.array(vs, pa.string()), pa.array(ts, pa.string())], names=[key, "path", "value", "value_type"])

    return rows.select(key, F.col(column).alias("doc")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, path string, value string, value_type string")
