"""Stores, stages and streams."""

import json
import sqlite3

import pytest

from framelode.plans import stages
from framelode.sources import inference, sqlite_source


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "s.sqlite")
    df = spark.createDataFrame([(i, f"n{i}", i / 2) for i in range(100)], "id long, name string, v double")
    sqlite_source.write_tables({"t": df, "empty": df.limit(0)}, path)
    store = inference.open_store(spark, path, ["t", "empty"], 3)
    assert store["t"].rdd.getNumPartitions() == 3 and store["empty"].count() == 0
    assert sorted(map(tuple, store["t"].where("id >= 90 AND v < 48").collect())) == [(i, f"n{i}", i / 2) for i in range(90, 96)]


def test_rows_without_a_range_value_are_read(spark, tmp_path):
    path = str(tmp_path / "n.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (k INTEGER, v TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(5, "a"), (None, "b"), (9, "c"), (None, "d"), (6, None)])
    spark.dataSource.register(sqlite_source.SqliteDataSource)
    df = spark.read.format("sqlite_table").options(path=path, table="t", range="k", partitions="2").load()
    assert sorted(((r.k, r.v) for r in df.collect()), key=str) == sorted([(5, "a"), (None, "b"), (9, "c"), (None, "d"), (6, None)], key=str)


def test_raw_store(spark, tmp_path):
    """Two detections in one frame, a gap, a ring with a hole, one without a class."""
    path = str(tmp_path / "raw.sqlite")
    square, hole = [30, 40, 90, 40, 90, 100, 30, 100], [50, 60, 70, 60, 70, 80]
    rows = [
        (3, "m-7", 0, "cat", "animal", 0.61, [30, 40, 90, 100], [square, hole]),
        (3, "m-8", 1, "dog", None, 0.32, [0, 0, 20, 10], [[0, 0, 20, 0, 20, 10]]),
        (11, "m-9", 0, "cat", "animal", None, [1.5, 2.5, 8, 9], [[1.5, 2.5, 8, 2.5, 8, 9, 1.5, 9]]),
    ]
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE masks (frame INTEGER, mask_id TEXT, detection_index INTEGER, label TEXT, class_name TEXT, score REAL, bbox_xyxy TEXT, polygons TEXT)")
        c.executemany("INSERT INTO masks VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(*r[:6], json.dumps(r[6]), json.dumps(r[7])) for r in rows])
    assert sqlite_source.kind(path) == "raw_detection"
    got = inference.scan_raw(inference.open_store(spark, path, ["masks"])).orderBy("frame", "bbox_xyxy").collect()
    assert [r.frame for r in got] == [3, 3, 11] and [r.bbox_xyxy for r in got] == [[0, 0, 20, 10], [30, 40, 90, 100], [1.5, 2.5, 8, 9]]
    assert got[1].polygons == [[[30, 40], [90, 40], [90, 100], [30, 100]], [[50, 60], [70, 60], [70, 80]]]


def test_unified_store(spark, tmp_path):
    """Frames 2 and 5 of two runs of detections: one with two rings, one unclassified, one frame empty."""
    path = str(tmp_path / "u.sqlite")
    tables = {
        "frames (id INTEGER, run_id INTEGER, frame_index INTEGER, timestamp_sec REAL, width INTEGER, height INTEGER)": [(70, 4, 2, 0.08, 320, 200), (71, 4, 5, 0.2, 320, 200), (72, 4, 6, 0.24, 320, 200)],
        "detections (id INTEGER, frame_id INTEGER, class_id INTEGER, class_name TEXT, score REAL, x1 REAL, y1 REAL, x2 REAL, y2 REAL)": [(1, 70, 3, "box", 0.5, 10, 20, 60, 80), (2, 71, 3, "box", 0.4, 100, 20, 130, 44)],
        "classifications (detection_id INTEGER, class_id INTEGER, class_name TEXT, score REAL)": [(1, 9, "crate", 0.8)],
        "segmentations (detection_id INTEGER, encoding TEXT)": [(1, "polygon"), (2, "polygon")],
        "segmentation_polygons (id INTEGER, detection_id INTEGER, polygon_index INTEGER)": [(31, 1, 0), (32, 1, 1), (33, 2, 0)],
        "segmentation_points (polygon_id INTEGER, point_index INTEGER, x REAL, y REAL)": [
            *((31, i, x, y) for i, (x, y) in enumerate(((10, 20), (60, 20), (60, 80), (10, 80)))),
            *((32, i, x, y) for i, (x, y) in enumerate(((20, 30), (40, 30), (30, 50)))),
            *((33, i, x, y) for i, (x, y) in enumerate(((100, 20), (130, 20), (115, 44)))),
        ],
    }
    with sqlite3.connect(path) as c:
        for shape, rows in tables.items():
            c.execute(f"CREATE TABLE {shape}")
            c.executemany(f"INSERT INTO {shape.split(' ')[0]} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    assert sqlite_source.kind(path) == "unified_inference"
    store = inference.open_store(spark, path, ["frames", "detections", "classifications", "segmentation_polygons", "segmentation_points"])
    got = inference.scan_unified(store).orderBy("frame").collect()
    assert [r.frame for r in got] == [2, 5, 6] and got[2].label is None
    assert (got[0].label, got[0].score, got[0].class_score) == ("crate", 0.5, 0.8) and got[0].polygons == [[[10, 20], [60, 20], [60, 80], [10, 80]], [[20, 30], [40, 30], [30, 50]]]
    assert got[1].polygons == [[[100, 20], [130, 20], [115, 44]]]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"frame_index": 0, "detections": []}\n\n{"frame_index": 1, "detections": [{"label": "A", "bbox_xyxy": [4, 4, 1, 1], "score": 0.5}]}\n')
    from framelode.operators.filters import normalise_records

    df = inference.read_jsonl(spark, str(path), "frame_index long, detections array<struct<label:string,bbox_xyxy:array<double>,score:double>>")
    empty, one = normalise_records(df).orderBy("frame").collect()
    assert one.bbox_xyxy == [1, 1, 4, 4] and (empty.frame, empty.bbox_xyxy, empty.class_name, empty.label) == (0, None, None, None)


def test_default_pipeline(spark):
    p = stages.default_pipeline()
    with pytest.raises(ValueError):
        p.check({"detections"})
    rows = [(0, f, i, 10.0 * i * i + f, 5.0, 10.0 * i * i + f + 60, 90.0, 0.9, "A") for f in range(20) for i in (0, 5)]
    d = spark.createDataFrame(rows, "video long, frame long, idx long, x1 double, y1 double, x2 double, y2 double, score double, label string")
    out = p.plan({"detections": d, "cuts": spark.createDataFrame([(12,)], "frame long")})
    got = out["tracks"].orderBy("track").collect()
    assert [r.length for r in got] == [12, 12, 8, 8] and [r.final_id for r in got] == [1, 2, None, None]
    with pytest.raises(ValueError):
        stages.Pipeline((p.stages[0], p.stages[0])).check({"detections"})


def test_stream_agrees_with_batch(spark, tmp_path):
    from framelode.operators import track
    from framelode.streaming import trackers

    kind = "video long, scene long, frame long, idx long, x1 double, y1 double, x2 double, y2 double, score double"
    rows = [(v, 0, f, i, 200.0 * i + 3 * f, 10.0, 200.0 * i + 3 * f + 80, 90.0, 0.9) for v in (1, 2) for f in range(6) for i in (0, 1)]
    src = tmp_path / "in"
    for k, part in enumerate((rows[::1][:0], [r for r in rows if r[2] < 3], [r for r in rows if r[2] >= 3])):
        if part:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(src))
            q = (
                trackers.track_stream(spark.readStream.schema(kind).parquet(str(src)))
                .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            )
            q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("video", "frame", "idx", "track").collect()))
    want = sorted(map(tuple, track.track_boxes(spark.createDataFrame(rows, kind)).select("video", "frame", "idx", "track").collect()))
    assert got == want


def test_windowed_stream(spark, tmp_path):
    from framelode.streaming import trackers

    src = tmp_path / "ev"
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id * 10 AS INT), 0) AS ts, id % 2 AS k, 1.0D AS v FROM range(12)").write.parquet(str(src))
    s = spark.readStream.schema("ts timestamp, k long, v double").parquet(str(src))
    q = trackers.windowed_counts(s, "ts", "1 hour", "10 minutes", ["k"], "v").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.n) for r in spark.sql("SELECT * FROM wc").collect()} == {(0, 3), (1, 3)}
