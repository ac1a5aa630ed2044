"""Queries on tracks: resolution, runs, gaps, interpolation and ordered-sequence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelode.operators import tracks as ops
from framelode.sources import adapters as src

from .registry import query

T = src.TRACKS
#: One row of a track at a frame: the lowest event.
SEEN = "seen AS (SELECT track, frame, arg_min(label, event_id) AS label, arg_min(value, event_id) AS value FROM tracks GROUP BY track, frame)"


def seen(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    return t.groupBy("track", "frame").agg(F.min_by(F.struct("label", "value"), "event_id").alias("g")).select("track", "frame", "g.label", "g.value")


@query("track_resolution", f"""
WITH {T}, {src.CUTS},
h AS (SELECT track, label, count(*) AS n, min(event_id) AS first_seen FROM tracks GROUP BY track, label),
t AS (SELECT track, CAST(sum(n) AS BIGINT) AS length, arg_max(label, n * 1000000000 - first_seen) AS label, count(*) AS n_labels FROM h GROUP BY track),
k AS (SELECT *, row_number() OVER (ORDER BY track) AS final_id FROM t WHERE length > 60),
f AS (SELECT frame, (SELECT count(*) FROM cuts c WHERE c.frame <= d.frame) AS scene FROM (SELECT DISTINCT frame FROM tracks) d)
SELECT k.final_id, k.label, k.length, k.n_labels, f.scene, count(*) AS n_rows, min(r.frame) AS start_frame, max(r.frame) AS end_frame
FROM tracks r JOIN k ON r.track = k.track JOIN f ON r.frame = f.frame GROUP BY ALL""")
def track_resolution(spark, sf_dir):
    rows = src.tracks(spark, sf_dir)
    kept = ops.resolve(rows, max_short=60).where("NOT removed").select("track", F.col("final_id").cast("long").alias("final_id"), "label", "length", "n_labels")
    placed = ops.scene_of(rows.select("track", "frame"), src.cuts(spark, sf_dir)).join(kept, "track")
    g = placed.groupBy("final_id", "label", "length", "n_labels", F.col("scene").cast("long").alias("scene"))
    return g.agg(F.count("*").alias("n_rows"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))


@query("track_label_histogram", f"WITH {T} SELECT track, label, count(*) AS n, min(event_id) AS first_seen FROM tracks GROUP BY track, label")
def track_label_histogram(spark, sf_dir):
    return ops.label_histogram(src.tracks(spark, sf_dir))


@query("short_track_prune", f"WITH {T} SELECT track, count(*) AS length FROM tracks GROUP BY track HAVING count(*) > 65")
def short_track_prune(spark, sf_dir):
    return src.tracks(spark, sf_dir).groupBy("track").agg(F.count("*").alias("length")).where("length > 65")


@query("relabelled_rows", f"""
WITH {T}, h AS (SELECT track, label, count(*) AS n, min(event_id) AS f FROM tracks GROUP BY 1, 2),
m AS (SELECT track, arg_max(label, n * 1000000000 - f) AS label, count(*) AS k FROM h GROUP BY track)
SELECT (SELECT count(*) FROM tracks t JOIN m ON t.track = m.track WHERE t.label <> m.label) AS relabelled, (SELECT count(*) FROM m WHERE k > 1) AS mixed_tracks""")
def relabelled_rows(spark, sf_dir):
    r = ops.resolve(src.tracks(spark, sf_dir), max_short=0)
    h = ops.label_histogram(src.tracks(spark, sf_dir)).withColumnRenamed("label", "own")
    a = h.join(r.select("track", "label"), "track").where("own <> label").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("relabelled"))
    return a.join(r.agg(F.sum(F.when(F.col("n_labels") > 1, 1).otherwise(0)).alias("mixed_tracks")))


@query("contiguous_runs", f"""
WITH {T}, {SEEN}, b AS (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN 0 ELSE 1 END AS brk FROM seen WINDOW w AS (PARTITION BY track ORDER BY frame)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT track, CAST(run AS BIGINT) AS run, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n, max(value) AS top FROM r GROUP BY track, run""")
def contiguous_runs(spark, sf_dir):
    r = ops.runs(seen(spark, sf_dir), ["track"])
    return r.groupBy("track", "run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"), F.max("value").alias("top"))


@query("scene_split_runs", f"""
WITH {T}, {SEEN}, {src.CUTS}, s AS (SELECT seen.*, (SELECT count(*) FROM cuts c WHERE c.frame <= seen.frame) AS scene FROM seen),
b AS (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 AND scene = lag(scene) OVER w THEN 0 ELSE 1 END AS brk FROM s WINDOW w AS (PARTITION BY track ORDER BY frame)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT track, scene, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n FROM r GROUP BY track, scene, run""")
def scene_split_runs(spark, sf_dir):
    s = ops.scene_of(seen(spark, sf_dir), src.cuts(spark, sf_dir))
    r = ops.runs(s, ["track"], "scene")
    return r.groupBy("track", F.col("scene").cast("long").alias("scene"), "run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n")).drop("run")


@query("longest_run", f"""
WITH {T}, {SEEN}, b AS (SELECT *, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM seen),
r AS (SELECT track, min(frame) AS start_frame, count(*) AS n FROM b GROUP BY track, g)
SELECT track, start_frame, n FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, start_frame) AS k FROM r) WHERE k = 1""")
def longest_run(spark, sf_dir):
    r = ops.runs(seen(spark, sf_dir), ["track"]).groupBy("track", "run").agg(F.min("frame").alias("start_frame"), F.count("*").alias("n"))
    best = F.max_by(F.struct("start_frame", "n"), F.struct("n", -F.col("start_frame")))
    return r.groupBy("track").agg(best.alias("b")).select("track", "b.start_frame", "b.n")


@query("gap_segments", f"""
WITH {T}, {SEEN}, g AS (SELECT *, frame - lag(frame) OVER w - 1 AS gap, lag(label) OVER w AS prev FROM seen WINDOW w AS (PARTITION BY track ORDER BY frame)),
s AS (SELECT *, sum(CASE WHEN gap <= 15 AND label = prev THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT track, CAST(segment AS BIGINT) AS segment, label, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS observed,
       max(frame) - min(frame) + 1 - count(*) AS filled FROM s GROUP BY track, segment, label""")
def gap_segments(spark, sf_dir):
    s = ops.gap_segments(seen(spark, sf_dir), 15, "label")
    return s.groupBy("track", "segment", "label").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("observed"), (F.max("frame") - F.min("frame") + 1 - F.count("*")).alias("filled"))


@query("gap_interpolation", f"""
WITH {T}, {SEEN}, n AS (SELECT *, lead(frame) OVER w AS f2, lead(value) OVER w AS v2 FROM seen WINDOW w AS (PARTITION BY track ORDER BY frame)),
x AS (SELECT track, frame, value, f2, v2, unnest(range(frame, CASE WHEN f2 - frame - 1 BETWEEN 1 AND 3 THEN f2 ELSE frame + 1 END)) AS f FROM n)
SELECT track, f AS frame, round(CASE WHEN f = frame THEN value ELSE value + (v2 - value) * (CAST(f - frame AS DOUBLE) / (f2 - frame)) END, 6) AS value, f <> frame AS interpolated FROM x""")
def gap_interpolation(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("frame")
    n = seen(spark, sf_dir).withColumn("f2", F.lead("frame").over(w)).withColumn("v2", F.lead("value").over(w))
    stop = F.when((F.col("f2") - F.col("frame") - 1).between(1, 3), F.col("f2") - 1).otherwise(F.col("frame"))
    x = n.withColumn("f", F.explode(F.sequence("frame", stop)))
    lerp = F.col("value") + (F.col("v2") - F.col("value")) * ((F.col("f") - F.col("frame")).cast("double") / (F.col("f2") - F.col("frame")))
    return x.select("track", F.col("f").alias("frame"), F.round(F.when(F.col("f") == F.col("frame"), F.col("value")).otherwise(lerp), 6).alias("value"), (F.col("f") != F.col("frame")).alias("interpolated"))


@query("typed_gap_interpolation", f"""
WITH {T}, {SEEN}, a AS (SELECT track, frame, label, value, value / 80 AS theta FROM seen),
n AS (SELECT *, lead(frame) OVER w AS f2, lead(value) OVER w AS v2, lead(theta) OVER w AS t2, lead(label) OVER w AS l2 FROM a WINDOW w AS (PARTITION BY track ORDER BY frame)),
x AS (SELECT *, unnest(range(frame + 1, f2)) AS f FROM n WHERE l2 = label AND f2 - frame - 1 BETWEEN 1 AND 3),
y AS (SELECT *, CAST(f - frame AS DOUBLE) / (f2 - frame) AS alpha, t2 - theta AS d FROM x)
SELECT track, f AS frame, label, round(least(value, v2), 6) AS confidence,
       round(theta + (d - 6.283185307179586 * floor((d + 3.141592653589793) / 6.283185307179586)) * alpha, 9) AS theta FROM y""")
def typed_gap_interpolation(spark, sf_dir):
    from framelode.functions.geometry import angle_lerp

    w = Window.partitionBy("track").orderBy("frame")
    a = seen(spark, sf_dir).withColumn("theta", F.col("value") / 80)
    n = a.select("*", F.lead("frame").over(w).alias("f2"), F.lead("value").over(w).alias("v2"), F.lead("theta").over(w).alias("t2"), F.lead("label").over(w).alias("l2"))
    x = n.where((F.col("l2") == F.col("label")) & (F.col("f2") - F.col("frame") - 1).between(1, 3)).withColumn("f", F.explode(F.sequence(F.col("frame") + 1, F.col("f2") - 1)))
    alpha = (F.col("f") - F.col("frame")).cast("double") / (F.col("f2") - F.col("frame"))
    return x.select("track", F.col("f").alias("frame"), "label", F.round(F.least("value", "v2"), 6).alias("confidence"), F.round(angle_lerp(F.col("theta"), F.col("t2"), alpha), 9).alias("theta"))


@query("frame_transitions", f"""
WITH {T}, {SEEN}, n AS (SELECT *, lag(frame) OVER w AS f0, lag(label) OVER w AS l0, lag(value) OVER w AS v0 FROM seen WINDOW w AS (PARTITION BY track ORDER BY frame))
SELECT track, frame, round(value - v0, 6) AS delta FROM n WHERE frame = f0 + 1 AND label = l0""")
def frame_transitions(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("frame")
    n = seen(spark, sf_dir).select("*", F.lag("frame").over(w).alias("f0"), F.lag("label").over(w).alias("l0"), F.lag("value").over(w).alias("v0"))
    return n.where("frame = f0 + 1 AND label = l0").select("track", "frame", F.round(F.col("value") - F.col("v0"), 6).alias("delta"))


@query("direction_reversals", f"""
WITH {src.KEYFRAMES}, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM keyframes WINDOW w AS (PARTITION BY track ORDER BY frame)),
p AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM d WINDOW w AS (PARTITION BY track ORDER BY frame)),
c AS (SELECT *, sqrt(dx * dx + dy * dy) * sqrt(px * px + py * py) AS norm FROM p WHERE px IS NOT NULL)
SELECT track, frame, round((dx * px + dy * py) / norm, 6) AS cosine, round(sqrt((dx - px) * (dx - px) + (dy - py) * (dy - py)), 4) AS acceleration
FROM c WHERE norm > 0 AND (dx * px + dy * py) / norm < -0.25""")
def direction_reversals(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("frame")
    d = src.keyframes(spark, sf_dir).select("*", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
    p = d.select("*", F.lag("dx").over(w).alias("px"), F.lag("dy").over(w).alias("py")).where("px IS NOT NULL")
    p = p.withColumn("norm", F.expr("sqrt(dx * dx + dy * dy) * sqrt(px * px + py * py)")).where("norm > 0").withColumn("c", F.expr("(dx * px + dy * py) / norm"))
    return p.where("c < -0.25").select("track", "frame", F.round("c", 6).alias("cosine"), F.round(F.expr("sqrt((dx - px) * (dx - px) + (dy - py) * (dy - py))"), 4).alias("acceleration"))


@query("endpoint_extrapolation", f"""
WITH {src.KEYFRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame DESC) AS k FROM keyframes),
f AS (SELECT track, max(frame) AS last, regr_slope(x, frame) AS s, avg(x) - regr_slope(x, frame) * avg(frame) AS i FROM r WHERE k <= 10 GROUP BY track HAVING count(*) >= 3)
SELECT track, last + e AS frame, round(i + s * (last + e), 2) AS x FROM f, (SELECT unnest(range(1, 6)) AS e) WHERE abs(s) <= 1000""")
def endpoint_extrapolation(spark, sf_dir):
    k = src.keyframes(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("frame")))).where("k <= 10")
    f = k.groupBy("track").agg(F.max("frame").alias("last"), F.regr_slope("x", "frame").alias("s"), F.avg("x").alias("ax"), F.avg("frame").alias("af"), F.count("*").alias("n")).where("n >= 3 AND abs(s) <= 1000")
    return f.withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("frame", F.col("last") + F.col("e")).select("track", "frame", F.round(F.col("ax") - F.col("s") * F.col("af") + F.col("s") * F.col("frame"), 2).alias("x"))


@query("saliency", f"""
WITH {src.KEYFRAMES}, n AS (SELECT *, lag(x) OVER w AS x0, lead(x) OVER w AS x2 FROM keyframes WINDOW w AS (PARTITION BY track ORDER BY frame))
SELECT track, frame, round(abs(x2 - 2 * x + x0) + 0.5 * greatest(abs(x - x0), abs(x2 - x)), 4) AS saliency,
       x > x0 AND x > x2 AS peak FROM n WHERE x0 IS NOT NULL AND x2 IS NOT NULL""")
def saliency(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("frame")
    n = src.keyframes(spark, sf_dir).select("*", F.lag("x").over(w).alias("x0"), F.lead("x").over(w).alias("x2")).where("x0 IS NOT NULL AND x2 IS NOT NULL")
    return n.select("track", "frame", F.round(F.expr("abs(x2 - 2 * x + x0) + 0.5 * greatest(abs(x - x0), abs(x2 - x))"), 4).alias("saliency"), F.expr("x > x0 AND x > x2").alias("peak"))


@query("prefix_sums", f"""
WITH {src.KEYFRAMES} SELECT track, frame, round(sum(y) OVER w, 4) AS q, round(sum(frame * y) OVER w, 2) AS tq, round(sum(y * y) OVER w, 2) AS q2
FROM keyframes WINDOW w AS (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING)""")
def prefix_sums(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    k = src.keyframes(spark, sf_dir)
    return k.select("track", "frame", F.round(F.sum("y").over(w), 4).alias("q"), F.round(F.sum(F.col("frame") * F.col("y")).over(w), 2).alias("tq"), F.round(F.sum(F.col("y") * F.col("y")).over(w), 2).alias("q2"))


@query("interval_fit", f"""
WITH {src.KEYFRAMES} SELECT track, count(*) AS n, round(regr_slope(y, frame), 6) AS slope, round(regr_intercept(y, frame), 1) AS intercept
FROM keyframes GROUP BY track HAVING count(*) >= 3""")
def interval_fit(spark, sf_dir):
    k = src.keyframes(spark, sf_dir).groupBy("track")
    return k.agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "frame"), 6).alias("slope"), F.round(F.regr_intercept("y", "frame"), 1).alias("intercept")).where("n >= 3")


@query("long_run_chunks", f"""
WITH {T}, {SEEN}, r AS (SELECT track, frame, row_number() OVER (PARTITION BY track ORDER BY frame) - 1 AS rn, count(*) OVER (PARTITION BY track) - 1 AS last FROM seen),
x AS (SELECT *, unnest(range(CAST(greatest(0, floor((rn - 5) / 20)) AS BIGINT), CAST(least(floor(last / 20), floor((rn + 5) / 20)) AS BIGINT) + 1)) AS chunk FROM r)
SELECT track, chunk, count(*) AS n_read, sum(CASE WHEN chunk = floor(rn / 20) THEN 1 ELSE 0 END)::BIGINT AS n_emit, min(frame) AS first_frame, max(frame) AS last_frame FROM x GROUP BY track, chunk""")
def long_run_chunks(spark, sf_dir):
    c = ops.chunks(seen(spark, sf_dir), ["track"], 30, 5)
    return c.groupBy("track", "chunk").agg(F.count("*").alias("n_read"), F.sum(F.col("emit").cast("long")).alias("n_emit"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("refractory_filter", f"""
WITH RECURSIVE {T}, e AS (SELECT DISTINCT track, frame FROM tracks WHERE value >= 40),
k AS (SELECT track, min(frame) AS frame FROM e GROUP BY track
      UNION ALL SELECT k.track, (SELECT min(frame) FROM e WHERE e.track = k.track AND e.frame - k.frame > 24) FROM k WHERE k.frame IS NOT NULL)
SELECT track, frame FROM k WHERE frame IS NOT NULL""")
def refractory_filter(spark, sf_dir):
    return ops.refractory(src.tracks(spark, sf_dir).where("value >= 40").select("track", "frame"), ["track"], 24)


@query("segment_merge", f"""
WITH {T}, {SEEN}, b AS (SELECT *, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM seen),
r AS (SELECT track, min(frame) AS s, max(frame) AS e, min(label) AS label FROM b GROUP BY track, g),
m AS (SELECT *, CASE WHEN s - lag(e) OVER w - 1 <= 3 AND label = lag(label) OVER w THEN 0 ELSE 1 END AS brk FROM r WINDOW w AS (PARTITION BY track ORDER BY s)),
z AS (SELECT *, sum(brk) OVER (PARTITION BY track ORDER BY s ROWS UNBOUNDED PRECEDING) AS seg FROM m)
SELECT track, CAST(seg AS BIGINT) AS segment, min(s) AS start_frame, max(e) AS end_frame, count(*) AS merged, string_agg(CAST(s AS VARCHAR), '+' ORDER BY s) AS run_key FROM z GROUP BY track, seg""")
def segment_merge(spark, sf_dir):
    r = ops.runs(seen(spark, sf_dir), ["track"]).groupBy("track", "run").agg(F.min("frame").alias("s"), F.max("frame").alias("e"), F.min("label").alias("label"))
    w = Window.partitionBy("track").orderBy("s")
    ok = (F.col("s") - F.lag("e").over(w) - 1 <= 3) & (F.col("label") == F.lag("label").over(w))
    z = r.withColumn("brk", F.when(ok, 0).otherwise(1)).withColumn("segment", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keys = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x.cast("string")), "+")
    return z.groupBy("track", "segment").agg(F.min("s").alias("start_frame"), F.max("e").alias("end_frame"), F.count("*").alias("merged"), keys.alias("run_key"))


@query("area_zscores", f"""
WITH {T}, {SEEN} SELECT track, frame, round((value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0), 4) AS z,
  round((value - avg(value) OVER l) / nullif(stddev_pop(value) OVER l, 0), 4) AS local_z
FROM seen WINDOW p AS (PARTITION BY track), l AS (PARTITION BY track ORDER BY frame RANGE BETWEEN 48 PRECEDING AND 48 FOLLOWING)""")
def area_zscores(spark, sf_dir):
    p = Window.partitionBy("track")
    near = p.orderBy("frame").rangeBetween(-48, 48)
    z = lambda w: F.round((F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_pop("value").over(w), F.lit(0.0)), 4)
    return seen(spark, sf_dir).select("track", "frame", z(p).alias("z"), z(near).alias("local_z"))


@query("temporal_neighbourhood", f"""
WITH {T}, {SEEN} SELECT track, frame, count(*) OVER l AS support, min(value) OVER l AS low, max(value) OVER l AS high
FROM seen WINDOW l AS (PARTITION BY track ORDER BY frame RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING)""")
def temporal_neighbourhood(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("frame").rangeBetween(-12, 12)
    return seen(spark, sf_dir).select("track", "frame", F.count("*").over(w).alias("support"), F.min("value").over(w).alias("low"), F.max("value").over(w).alias("high"))


@query("monotone_progress", f"WITH {T} SELECT track, event_id, max(value) OVER (PARTITION BY track ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS progress FROM tracks")
def monotone_progress(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return src.tracks(spark, sf_dir).select("track", "event_id", F.max("value").over(w).alias("progress"))


@query("track_summary", f"""
WITH {T}, {SEEN}, {src.CUTS}, s AS (SELECT track, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS hits, max(value) AS max_score, round(avg(value), 6) AS mean_score FROM seen GROUP BY track)
SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM cuts c WHERE c.frame > s.end_frame) THEN 'cut' ELSE 'end_of_stream' END AS reason FROM s""")
def track_summary(spark, sf_dir):
    last = src.cuts(spark, sf_dir).agg(F.max("frame").alias("last_cut"))
    s = seen(spark, sf_dir).groupBy("track").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("hits"), F.max("value").alias("max_score"), F.round(F.avg("value"), 6).alias("mean_score"))
    return s.join(F.broadcast(last)).withColumn("reason", F.when(F.col("last_cut") > F.col("end_frame"), "cut").otherwise("end_of_stream")).drop("last_cut")


@query("cut_detection_frame_diff", f"""
WITH RECURSIVE {T}, {src.FRAMES}, e AS (SELECT frame FROM frames WHERE diff >= 18),
k AS (SELECT min(frame) AS frame FROM e UNION ALL SELECT (SELECT min(frame) FROM e WHERE e.frame - k.frame > 15) FROM k WHERE k.frame IS NOT NULL)
SELECT frame FROM k WHERE frame IS NOT NULL""")
def cut_detection_frame_diff(spark, sf_dir):
    from framelode.operators.cuts import frame_diff_cuts

    return frame_diff_cuts(src.frames(spark, sf_dir).withColumn("video", F.lit(0))).select("frame")


@query("cut_detection_high_precision", f"""
WITH RECURSIVE {T}, {src.FRAMES}, e AS (
  SELECT frame FROM frames WHERE diff >= 18 AND (diff >= 70 OR (diff >= 45 AND corr <= 0.98 AND ssim <= 0.55) OR (diff >= 30 AND diff < 45 AND corr <= 0.96 AND ssim <= 0.45))),
k AS (SELECT min(frame) AS frame FROM e UNION ALL SELECT (SELECT min(frame) FROM e WHERE e.frame - k.frame > 45) FROM k WHERE k.frame IS NOT NULL)
SELECT frame FROM k WHERE frame IS NOT NULL""")
def cut_detection_high_precision(spark, sf_dir):
    from framelode.operators.cuts import high_precision_cuts

    return high_precision_cuts(src.frames(spark, sf_dir).withColumn("video", F.lit(0))).select("frame")
