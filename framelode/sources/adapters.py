"""Projections of general tables onto the annotation model, as DataFrames and as SQL for another engine.

``tracks``     events: an identity (user) seen at an hour with a label and a value
``boxes``      line items: scored boxes of a frame (order), in a total order ``idx``
``keyframes``  orders: sparse samples of a track (customer) by day
``rings``      embeddings: polygons of 32 points
``frames``     events by hour: a signal with scene changes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> F.Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("track"), F.floor(seconds("ts") / 3600).cast("long").alias("frame"), F.col("event_type").alias("label"), "value", "props", seconds("ts").alias("t"))


TRACKS = """tracks AS (
  SELECT event_id, user_id AS track, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, event_type AS label, value, props,
         CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity") * 10, (F.col("l_partkey") % 400).cast("double")
    b = i.select(
        F.col("l_orderkey").alias("frame"), x.alias("x1"), y.alias("y1"), (x + 20 + F.col("l_suppkey") % 40).alias("x2"), (y + 20 + F.col("l_linenumber") * 5).alias("y2"),
        (F.floor(F.col("l_extendedprice") * 1000000 / 105000) / 1000000).alias("score"), F.col("l_returnflag").alias("label"),
    ).distinct()
    return b.withColumn("idx", F.row_number().over(Window.partitionBy("frame").orderBy("x1", "y1", "x2", "y2", "score", "label")).cast("long") - 1)


BOXES = """boxes AS (
  SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x1, y1, x2, y2, score, label) - 1 AS idx FROM (
    SELECT DISTINCT l_orderkey AS frame, l_quantity * 10 AS x1, CAST(l_partkey % 400 AS DOUBLE) AS y1,
           l_quantity * 10 + 20 + l_suppkey % 40 AS x2, CAST(l_partkey % 400 AS DOUBLE) + 20 + l_linenumber * 5 AS y2,
           floor(l_extendedprice * 1000000 / 105000) / 1000000 AS score, l_returnflag AS label FROM lineitem))"""


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    k = o.select(F.col("o_custkey").alias("track"), day.alias("frame"), F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 1000).cast("double").alias("y"), "o_orderkey")
    return k.groupBy("track", "frame").agg(F.min_by(F.struct("x", "y"), "o_orderkey").alias("g")).select("track", "frame", "g.x", "g.y")


KEYFRAMES = """keyframes AS (
  SELECT o_custkey AS track, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS frame,
         arg_min(o_totalprice, o_orderkey) AS x, CAST(arg_min(o_orderkey % 1000, o_orderkey) AS DOUBLE) AS y FROM orders GROUP BY 1, 2)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    point = lambda i: F.struct((F.element_at(v, 2 * i + 1).cast("double") * 100).alias("x"), (F.element_at(v, 2 * i + 2).cast("double") * 100).alias("y"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(31)), point)
    return e.select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("track"), ring.alias("ring"))


RINGS = """rings AS (
  SELECT vec_id AS frame, CAST(label AS BIGINT) AS track,
         list_transform(range(0, 32), lambda i: {'x': CAST(embedding[2 * i + 1] AS DOUBLE) * 100, 'y': CAST(embedding[2 * i + 2] AS DOUBLE) * 100}) AS ring FROM embeddings)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each hour: a difference signal, a correlation and a similarity, made of the events in it."""
    t = tracks(spark, sf_dir)
    f = t.groupBy("frame").agg(F.max("value").alias("peak"), F.count("*").alias("n"), F.countDistinct("track").alias("who"))
    return f.select("frame", (F.col("peak") / 4).alias("diff"), (F.col("n") / (F.col("n") + 1)).alias("corr"), (F.col("who") / (F.col("n") * 2)).alias("ssim"))


FRAMES = """frames AS (
  SELECT frame, max(value) / 4 AS diff, count(*) / (count(*) + 1) AS corr, count(DISTINCT track) / (count(*) * 2) AS ssim FROM tracks GROUP BY frame)"""


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First frames of scenes: hours that hold a signup of 60 or more."""
    return tracks(spark, sf_dir).where("label = 'signup' AND value >= 60").select("frame").distinct()


CUTS = "cuts AS (SELECT DISTINCT frame FROM tracks WHERE label = 'signup' AND value >= 60)"
