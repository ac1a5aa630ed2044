"""Queries look up every row of their tables."""

import duckdb
import pytest

from framelode.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bracketing_keyframes", "seek_anchor"])
def test_all_ship_dates_are_looked_up(spark, name):
    sql = f"SELECT DISTINCT o_custkey, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) FROM '{DIR}/lineitem.parquet' JOIN '{DIR}/orders.parquet' ON l_orderkey = o_orderkey"
    want = sorted(duckdb.sql(sql).fetchall())
    got = sorted(map(tuple, catalog.QUERIES[name](spark, DIR).select("track", "frame").collect()))
    assert got == want


def test_all_lines_meet_on_either_key(spark):
    s = {r[0] for r in duckdb.sql(f"SELECT s_suppkey FROM '{DIR}/supplier.parquet'").fetchall()}
    want = {}
    for order, part, supplier in duckdb.sql(f"SELECT l_orderkey, l_partkey % 1000, l_suppkey % 1000 FROM '{DIR}/lineitem.parquet'").fetchall():
        for k in {part, supplier} & s:
            want[order, k] = want.get((order, k), 0) + 1
    got = {(r[0], r[1]): r[2] for r in catalog.QUERIES["or_key_join"](spark, DIR).select("l_orderkey", "s_suppkey", "n").collect()}
    assert got == want


def test_all_tracks_are_exported(spark):
    from framelode.sources import adapters

    want = {str(r.track): r["count"] for r in adapters.tracks(spark, DIR).groupBy("track").count().collect()}
    assert {r.track_id: r.masks for r in catalog.QUERIES["legacy_export"](spark, DIR).collect()} == want


def test_sessions_end_at_gaps_of_exactly_six_hours(spark, tmp_path):
    seen = "(1, 1, '2024-01-01 00:00:00'), (2, 1, '2024-01-01 06:00:00'), (3, 1, '2024-01-01 11:59:59.5'), (4, 1, NULL), (5, 1, NULL), (6, NULL, '2024-01-01 00:00:00'), (7, 2, '2024-01-01 00:00:00'), (8, 2, '2024-01-01 00:00:00')"
    duckdb.sql(f"COPY (SELECT CAST(i AS BIGINT) AS event_id, CAST(u AS BIGINT) AS user_id, CAST(t AS TIMESTAMP) AS ts, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM (VALUES {seen}) v(i, u, t)) TO '{tmp_path}/events.parquet'")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(c.sql(f"SELECT track, start, last, n FROM ({catalog.ORACLES['session_windows']})").fetchall(), key=str)
    got = catalog.QUERIES["session_windows"](spark, str(tmp_path)).select("track", "start", "last", "n")
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == 6
