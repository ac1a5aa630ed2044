"""SQLite tables as a Spark data source, read in parallel by ranges of an integer column, and an atomic writer.

Register with ``spark.dataSource.register(SqliteDataSource)`` and read with ``spark.read.format("sqlite_table")`` and the
options ``path``, ``table``, and optionally ``range`` (an integer column, rowid by default) and ``partitions``. Filters
that compare a column with a value reach SQLite.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

_KINDS = (("INT", LongType()), ("CHAR", StringType()), ("TEXT", StringType()), ("CLOB", StringType()), ("BLOB", BinaryType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()), ("NUM", DoubleType()))
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextmanager
def connect(path: str) -> Iterator[sqlite3.Connection]:
    c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        yield c
    finally:
        c.close()


def columns(path: str, table: str) -> StructType:
    with connect(path) as c:
        rows = c.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not rows:
        raise ValueError(f"no table {table} in {path}")
    kind = lambda t: next((k for word, k in _KINDS if word in t.upper()), StringType())
    return StructType([StructField(r[1], kind(r[2] or ""), True) for r in rows])


class Range(InputPartition):
    """Rows between two values; all rows without any; those that have no value where only ``high`` is given."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.conditions: list[tuple[str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            sign = _SIGNS.get(type(f))
            if sign and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.conditions.append((f"{quoted(f.attribute[0])} {sign} ?", f.value))
            else:
                yield f

    def partitions(self):
        n = int(self.options.get("partitions", "8"))
        key = self.options.get("range", "rowid")
        with connect(self.options["path"]) as c:
            low, high = c.execute(f"SELECT min({key if key == 'rowid' else quoted(key)}), max({key if key == 'rowid' else quoted(key)}) FROM {quoted(self.options['table'])}").fetchone()
        if low is None:
            return [Range(None, None)]
        step = max(1, -(-(high - low + 1) // n))
        return [*(Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)), *([] if key == "rowid" else [Range(None, high)])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        key = self.options.get("range", "rowid")
        where, values = [c for c, _ in self.conditions], [v for _, v in self.conditions]
        if part.low is not None:
            where.append(f"{key if key == 'rowid' else quoted(key)} BETWEEN ? AND ?")
            values += [part.low, part.high]
        elif part.high is not None:
            where.append(f"{quoted(key)} IS NULL")
        names = self.schema.fieldNames()
        sql = f"SELECT {', '.join(map(quoted, names))} FROM {quoted(self.options['table'])}" + (f" WHERE {' AND '.join(where)}" if where else "")
        kinds = [{"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string()) for f in self.schema.fields]
        with connect(self.options["path"]) as c:
            cursor = c.execute(sql, values)
            while rows := cursor.fetchmany(4096):
                cols = list(zip(*rows, strict=True))
                out = [pa.array([None if v is None else str(v) if pa.types.is_string(k) else v for v in col], k) for col, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(out, names=names)


class SqliteDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        return columns(self.options["path"], self.options["table"])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def kind(path: str) -> str:
    """What a store holds, by its tables: 'tracked', 'raw_detection' or 'unified_inference'."""
    with connect(path) as c:
        tables = {r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        has = lambda t: {r[1] for r in c.execute(f"PRAGMA table_info({quoted(t)})")} if t in tables else set()
        if {"detections", "segmentations", "segmentation_points"} <= tables:
            return "unified_inference"
        if "track_id" in has("masks"):
            return "tracked"
        if {"mask_id", "detection_index"} <= has("masks"):
            return "raw_detection"
    raise ValueError(f"unknown store {path}")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Publish a small result store: written beside the target, checked, then moved in place in one step.

    Rows stream through the driver one partition at a time; large results belong in Parquet.
    """
    temp = f"{path}.{os.getpid()}.tmp"
    if os.path.exists(temp):
        os.remove(temp)
    c = sqlite3.connect(temp)
    try:
        for name, df in tables.items():
            decl = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
            c.execute(f"CREATE TABLE {quoted(name)} ({', '.join(f'{quoted(n)} {decl.get(t, 'TEXT')}' for n, t in df.dtypes)})")
            c.executemany(f"INSERT INTO {quoted(name)} VALUES ({', '.join('?' * len(df.columns))})", (tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.toLocalIterator()))
        c.commit()
        if c.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
            raise OSError(f"{temp} is damaged")
    finally:
        c.close()
    os.replace(temp, path)
