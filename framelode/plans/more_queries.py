"""Smaller queries: ranges, examples, stratified picks, ids, log lines, polygon edits and result tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelode.functions import geometry as geo
from framelode.operators import borders, keyframes, results, telemetry, tracks
from framelode.sources import adapters as src

from .registry import query
from .track_queries import SEEN, seen

T, B, K = src.TRACKS, src.BOXES, src.KEYFRAMES
SPANS = f"{T}, {SEEN}, b AS (SELECT *, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM seen), spans AS (SELECT track, min(frame) AS s, max(frame) AS e, count(*) AS n, min(label) AS label FROM b GROUP BY track, g)"


def spans(spark, sf_dir):
    return tracks.runs(seen(spark, sf_dir), ["track"]).groupBy("track", "run").agg(F.min("frame").alias("s"), F.max("frame").alias("e"), F.count("*").alias("n"), F.min("label").alias("label")).drop("run")


@query("frame_range_overlap", f"WITH {SPANS} SELECT track, s, e FROM spans WHERE e >= 473500 AND s <= 473600")
def frame_range_overlap(spark, sf_dir):
    return spans(spark, sf_dir).where("e >= 473500 AND s <= 473600").select("track", "s", "e")


@query("domain_filter", f"WITH {T} SELECT t.event_id, t.track FROM tracks t JOIN (SELECT DISTINCT track FROM tracks WHERE track % 3 = 0) d ON d.track = t.track")
def domain_filter(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    return t.join(t.where("track % 3 = 0").select("track").distinct(), "track", "left_semi").select("event_id", "track")


@query("source_inspection", f"WITH {B} SELECT label, count(DISTINCT frame) AS frames, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM boxes GROUP BY label")
def source_inspection(spark, sf_dir):
    return src.boxes(spark, sf_dir).groupBy("label").agg(F.countDistinct("frame").alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"))


@query("stratified_track_pick", f"""
WITH {SPANS}, l AS (SELECT track, max(n) AS n, arg_max(label, n * 1000000 - s) AS label FROM spans GROUP BY track),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, track) AS k FROM l)
SELECT track, n, label, row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, n DESC, track) AS place FROM p QUALIFY place <= 20""")
def stratified_track_pick(spark, sf_dir):
    s = spans(spark, sf_dir).groupBy("track").agg(F.max("n").alias("n"), F.max_by("label", F.struct("n", -F.col("s"))).alias("label"))
    k = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "track"))
    first = s.withColumn("later", (k != 1).cast("int")).orderBy("later", F.desc("n"), "track").limit(20)
    return first.select("track", "n", "label", F.row_number().over(Window.orderBy("later", F.desc("n"), "track")).cast("long").alias("place"))


@query("first_examples", f"WITH {T} SELECT label, min(event_id) AS first_event, arg_min(track, event_id) AS track, arg_min(frame, event_id) AS frame FROM tracks WHERE value >= 50 GROUP BY label")
def first_examples(spark, sf_dir):
    g = src.tracks(spark, sf_dir).where("value >= 50").groupBy("label")
    return g.agg(F.min("event_id").alias("first_event"), F.min_by("track", "event_id").alias("track"), F.min_by("frame", "event_id").alias("frame"))


@query("existence_probe", f"WITH {T} SELECT EXISTS (SELECT 1 FROM tracks WHERE value > 1e6) AS huge, EXISTS (SELECT 1 FROM tracks WHERE label = 'error') AS errors")
def existence_probe(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    has = lambda c, n: t.where(c).limit(1).agg((F.count("*") > 0).alias(n))
    return has("value > 1e6", "huge").crossJoin(has("label = 'error'", "errors"))


@query("two_best", f"WITH {T}, r AS (SELECT track, event_id, value, row_number() OVER (PARTITION BY track ORDER BY value DESC, event_id) AS k FROM tracks) SELECT track, k, event_id, value FROM r WHERE k <= 2")
def two_best(spark, sf_dir):
    w = Window.partitionBy("track").orderBy(F.desc("value"), "event_id")
    return src.tracks(spark, sf_dir).select("track", F.row_number().over(w).cast("long").alias("k"), "event_id", "value").where("k <= 2")


@query("busy_consistency", """
WITH p AS (SELECT o_custkey AS job, bool_or(o_orderstatus = 'P') AS busy, bool_or(o_totalprice > 400000) AS running FROM orders GROUP BY 1) SELECT job, running AND NOT busy AS inconsistent FROM p""")
def busy_consistency(spark, sf_dir):
    p = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("busy"), F.collect_list(F.col("o_totalprice") > 400000).alias("phases"))
    return p.select("job", (F.exists("phases", lambda x: x) & ~F.col("busy")).alias("inconsistent"))


@query("telemetry_log_lines", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'warn' ELSE 'info' END AS level, CAST(user_id AS BIGINT) AS job, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def telemetry_log_lines(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    line = F.concat(F.lit("["), F.when(F.col("event_type") == "error", "WARN").otherwise("INFO"), F.lit("] job="), F.col("user_id"), F.lit(" @@json "), F.col("props"))
    return telemetry.parse_lines(e.select("event_id", line.alias("line")), "line", "k bigint").select("event_id", "level", "job", F.col("data.k").alias("k"))


@query("track_id_templates", f"WITH {T} SELECT DISTINCT 'face:raw:' || (track % 4) || ':' || track AS raw_id, 'face:' || track AS final_id FROM tracks WHERE 'face:' || track LIKE 'face:1%'")
def track_id_templates(spark, sf_dir):
    t = src.tracks(spark, sf_dir).select("track").distinct()
    ids = t.select(F.concat_ws(":", F.lit("face:raw"), (F.col("track") % 4).cast("string"), F.col("track").cast("string")).alias("raw_id"), F.concat_ws(":", F.lit("face"), F.col("track").cast("string")).alias("final_id"))
    return ids.where("final_id LIKE 'face:1%'")


@query("safe_file_names", """
WITH n AS (SELECT c_custkey, regexp_replace(lower(c_mktsegment) || '#' || (c_custkey % 50), '[^a-z0-9]+', '_', 'g') AS base FROM customer)
SELECT c_custkey, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '_' || (row_number() OVER w) END AS name FROM n WINDOW w AS (PARTITION BY base ORDER BY c_custkey)""")
def safe_file_names(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(F.concat(F.lower("c_mktsegment"), F.lit("#"), F.col("c_custkey") % 50), "[^a-z0-9]+", "_").alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("c_custkey"))
    return c.withColumn("k", k).select("c_custkey", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string"))).alias("name"))


@query("polygon_rescale", f"""
WITH {src.RINGS} SELECT frame, round(list_sum(list_transform(ring, lambda p: p.x * 1.5)), 6) AS sx, round(list_max(list_transform(ring, lambda p: p.y * 1.5)), 9) AS top FROM rings""")
def polygon_rescale(spark, sf_dir):
    from framelode.operators.rescale import rescale

    r = rescale(src.rings(spark, sf_dir), (1280, 720), (1920, 1080), x=[], y=[], rings=["ring"])
    return r.select("frame", F.round(geo.vertex_mean(F.col("ring"), "x") * 32, 6).alias("sx"), F.round(F.array_max(F.transform("ring", lambda p: p["y"])), 9).alias("top"))


@query("ellipse_canonical", f"""
WITH {B}, e AS (SELECT frame, idx, x2 - x1 AS a, y2 - y1 AS b, x1 AS t FROM boxes),
s AS (SELECT frame, idx, greatest(a, b) AS a, least(a, b) AS b, CASE WHEN b > a THEN t + 90 ELSE t END + 90 AS u FROM e) SELECT frame, idx, a, b, u - 180 * floor(u / 180) - 90 AS theta FROM s""")
def ellipse_canonical(spark, sf_dir):
    b = src.boxes(spark, sf_dir)
    return b.select("frame", "idx", *geo.canonical_ellipse(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x1")))


@query("keyframe_arity", f"""
WITH {K}, s AS (SELECT track, min(frame) AS lo, max(frame) AS hi, count(*) AS n FROM keyframes GROUP BY track)
SELECT k.track, k.frame, s.n FROM keyframes k JOIN s ON s.track = k.track WHERE k.frame NOT BETWEEN s.lo + 30 AND s.hi OR s.n < 5""")
def keyframe_arity(spark, sf_dir):
    k = src.keyframes(spark, sf_dir)
    s = k.groupBy("track").agg((F.min("frame") + 30).alias("lo"), F.max("frame").alias("hi"), F.count("*").alias("n"))
    return results.outside_segments(k, s, 5).select("track", "frame", "n")


@query("keyframe_compaction", f"""
WITH {T}, {SEEN}, b AS (SELECT *, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM seen), r AS (SELECT *, min(frame) OVER (PARTITION BY track, g) AS lo, max(frame) OVER (PARTITION BY track, g) AS hi FROM b)
SELECT (SELECT count(*) FROM seen) AS dense, count(*) AS kept, round(1 - count(*) / (SELECT count(*) FROM seen), 6) AS saved FROM r WHERE frame IN (lo, hi) OR (frame - lo) % 6 = 0""")
def keyframe_compaction(spark, sf_dir):
    s = seen(spark, sf_dir)
    k = keyframes.fixed_interval(s, 6).agg(F.count("*").alias("kept"))
    return s.agg(F.count("*").alias("dense")).crossJoin(k).withColumn("saved", F.round(1 - F.col("kept") / F.col("dense"), 6))


@query("result_segments", f"""
WITH {SPANS} SELECT row_number() OVER (ORDER BY track, s) AS segment_id, track, s AS start_frame, e AS end_frame, 'polygon' AS shape_type FROM spans""")
def result_segments(spark, sf_dir):
    return results.segment_table(spans(spark, sf_dir).select("track", F.col("s").alias("start_frame"), F.col("e").alias("end_frame")))


@query("suppression_totals", f"""
WITH {B} SELECT count(*) AS n_in, count(DISTINCT frame) AS frames, CAST(sum(CASE WHEN score >= 0.35 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN score < 0.35 THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM boxes""")
def suppression_totals(spark, sf_dir):
    return results.totals(src.boxes(spark, sf_dir), F.col("score") >= 0.35)


@query("session_windows", f"""
WITH {T}, g AS (SELECT track, t, CASE WHEN t - lag(t) OVER (PARTITION BY track ORDER BY t) < 21600 THEN 0 ELSE 1 END AS brk FROM tracks),
s AS (SELECT *, sum(brk) OVER (PARTITION BY track ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT track, min(t) AS start, max(t) AS last, count(*) AS n FROM s GROUP BY track, k""")
def session_windows(spark, sf_dir):
    # not session_window(): it also joins events exactly six hours apart and leaves out those without a time
    w = Window.partitionBy("track").orderBy(F.asc_nulls_last("t"))
    t = src.tracks(spark, sf_dir).select("track", "t")
    g = t.withColumn("brk", F.when(F.col("t") - F.lag("t").over(w) < 21600, 0).otherwise(1))
    s = g.withColumn("k", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("track", "k").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.count("*").alias("n")).drop("k")


@query("grouping_sets", "SELECT c_mktsegment, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_name)")
def grouping_sets(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer").join(src.table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return c.cube("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("border_expansion")
def border_expansion(spark, sf_dir):
    return borders.expand(src.rings(spark, sf_dir), (-30.0, -30.0, 30.0, 30.0)).select("frame", "track", F.round(geo.signed_area(F.col("ring")), 6).alias("area"))
