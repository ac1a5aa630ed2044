"""Queries on relations: joins, as-of joins, set operations, validation, exports and telemetry."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from framelode.functions import geometry as geo
from framelode.operators import asof, keyframes, merge, telemetry, tracks, validate
from framelode.sources import adapters as src

from .registry import ORACLES, query
from .track_queries import SEEN, seen

T, B, K = src.TRACKS, src.BOXES, src.KEYFRAMES


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("fk_chain_join", """
SELECT r_name, n_name, count(*) AS lines, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def fk_chain_join(spark, sf_dir):
    t = lambda n: src.table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("lines"), F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("classification_left_join", f"""
WITH {B}, c AS (SELECT frame, idx, label FROM boxes WHERE score >= 0.5)
SELECT b.frame, b.idx, coalesce(c.label, 'detector') AS class_name FROM boxes b LEFT JOIN c ON b.frame = c.frame AND b.idx = c.idx""")
def classification_left_join(spark, sf_dir):
    b = src.boxes(spark, sf_dir)
    c = b.where("score >= 0.5").select("frame", "idx", "label")
    return b.select("frame", "idx").join(c, ["frame", "idx"], "left").select("frame", "idx", F.coalesce("label", F.lit("detector")).alias("class_name"))


@query("nested_regroup", f"""
WITH {B} SELECT frame, count(*) AS n, string_agg(label, '' ORDER BY idx) AS labels, string_agg(CAST(CAST(x1 AS BIGINT) AS VARCHAR), ',' ORDER BY idx) AS lefts FROM boxes GROUP BY frame""")
def nested_regroup(spark, sf_dir):
    g = src.boxes(spark, sf_dir).groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("idx", "label", F.col("x1").cast("long").cast("string").alias("x")))).alias("d"))
    return g.select("frame", F.size("d").cast("long").alias("n"), F.array_join(F.transform("d", lambda s: s["label"]), "").alias("labels"), F.array_join(F.transform("d", lambda s: s["x"]), ",").alias("lefts"))


@query("audit_score_join", f"""
WITH {T}, {SEEN}, a AS (SELECT frame, track, max(value) AS score FROM tracks GROUP BY 1, 2)
SELECT s.track, s.frame, a.score, CASE WHEN s.frame % 2 = 0 THEN 'OBSERVED' ELSE 'GAP-FILL' END AS provenance FROM seen s LEFT JOIN a ON s.frame = a.frame AND s.track = a.track""")
def audit_score_join(spark, sf_dir):
    a = src.tracks(spark, sf_dir).groupBy("frame", "track").agg(F.max("value").alias("score"))
    s = seen(spark, sf_dir).withColumn("own", F.when(F.col("frame") % 2 == 0, F.col("value")))
    return s.join(a, ["frame", "track"], "left").select("track", "frame", "score", F.when(F.col("own").isNull(), "GAP-FILL").otherwise("OBSERVED").alias("provenance"))


@query("star_left_join", """
SELECT o_orderkey, c_mktsegment, n_name, CAST(coalesce(l.n, 0) AS BIGINT) AS returned_lines FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey""")
def star_left_join(spark, sf_dir):
    t = lambda n: src.table(spark, sf_dir, n)
    lines = t("lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    j = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey"), "left").join(t("nation"), F.expr("c_nationkey = n_nationkey AND n_regionkey = 1"), "left").join(lines, F.expr("l_orderkey = o_orderkey"), "left")
    return j.select("o_orderkey", "c_mktsegment", "n_name", F.coalesce("n", F.lit(0)).alias("returned_lines"))


@query("editable_view_join", f"""
WITH {K} SELECT k.track, c_name AS name, k.frame, round(k.x, 2) AS x, k.y FROM keyframes k JOIN customer ON c_custkey = k.track WHERE k.frame BETWEEN 100 AND 400""")
def editable_view_join(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track"), F.col("c_name").alias("name"))
    return src.keyframes(spark, sf_dir).where("frame BETWEEN 100 AND 400").join(c, "track").select("track", "name", "frame", F.round("x", 2).alias("x"), "y")


@query("selected_tracks_semi", f"WITH {T} SELECT track, frame, event_id FROM tracks WHERE track IN (SELECT track FROM tracks GROUP BY track HAVING max(value) > 100)")
def selected_tracks_semi(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    return t.join(t.groupBy("track").agg(F.max("value").alias("top")).where("top > 100"), "track", "left_semi").select("track", "frame", "event_id")


@query("unrouted_tracks_anti", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL")
def unrouted_tracks_anti(spark, sf_dir):
    o = src.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return src.table(spark, sf_dir, "customer").join(o, F.expr("o_custkey = c_custkey"), "left_anti").select("c_custkey")


@query("collision_probe", f"""
WITH {T}, a AS (SELECT DISTINCT frame, track FROM tracks WHERE label = 'view'), b AS (SELECT DISTINCT frame, track FROM tracks WHERE label = 'click') SELECT a.frame, a.track FROM a JOIN b ON a.frame = b.frame AND a.track = b.track""")
def collision_probe(spark, sf_dir):
    from framelode.operators.classwise import collisions

    t = src.tracks(spark, sf_dir).select("frame", "track", "label").distinct()
    return collisions(t.where("label = 'view'"), t.where("label = 'click'"))


@query("gap_fill_flag", f"""
WITH {T}, {SEEN}, e AS (SELECT DISTINCT track, frame FROM tracks WHERE value >= 20)
SELECT s.track, s.frame, NOT EXISTS (SELECT 1 FROM e WHERE e.track = s.track AND e.frame = s.frame) AS is_gap_filled FROM seen s""")
def gap_fill_flag(spark, sf_dir):
    e = src.tracks(spark, sf_dir).where("value >= 20").select("track", "frame").distinct().withColumn("hit", F.lit(True))
    return seen(spark, sf_dir).join(e, ["track", "frame"], "left").select("track", "frame", F.col("hit").isNull().alias("is_gap_filled"))


@query("or_key_join", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 1000 AS head, l_suppkey % 1000 AS face FROM lineitem)
SELECT l_orderkey, s_suppkey, count(*) AS n FROM p JOIN supplier ON s_suppkey = head OR s_suppkey = face GROUP BY 1, 2""")
def or_key_join(spark, sf_dir):
    p = src.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 1000).alias("head"), (F.col("l_suppkey") % 1000).alias("face"))
    return validate.either_key(p, src.table(spark, sf_dir, "supplier").select("s_suppkey"), ("head", "face"), "s_suppkey").groupBy("l_orderkey", "s_suppkey").agg(F.count("*").alias("n"))


# ---- as-of ---------------------------------------------------------------------------------------------------------

#: Frames to look up: all ship dates of a customer's orders, as days.
ASK = "ask AS (SELECT DISTINCT o_custkey AS track, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS frame FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def ask(spark, sf_dir):
    j = src.table(spark, sf_dir, "lineitem").join(src.table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    return j.select(F.col("o_custkey").alias("track"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("frame")).distinct()


@query("scene_of_frame", f"WITH {T}, {src.CUTS}, d AS (SELECT DISTINCT frame FROM tracks) SELECT d.frame, (SELECT count(*) FROM cuts c WHERE c.frame <= d.frame) AS scene FROM d")
def scene_of_frame(spark, sf_dir):
    d = src.tracks(spark, sf_dir).select("frame").distinct()
    return tracks.scene_of(d, src.cuts(spark, sf_dir)).select("frame", F.col("scene").cast("long").alias("scene"))


@query("bracketing_keyframes", f"""
WITH {K}, {ASK} SELECT a.track, a.frame, (SELECT max(frame) FROM keyframes k WHERE k.track = a.track AND k.frame <= a.frame) AS "left",
  (SELECT min(frame) FROM keyframes k WHERE k.track = a.track AND k.frame >= a.frame) AS "right" FROM ask a""")
def bracketing_keyframes(spark, sf_dir):
    return asof.bracket(ask(spark, sf_dir), src.keyframes(spark, sf_dir), "x").select("track", "frame", "left", "right")


@query("seek_anchor", f"""WITH {K}, {ASK} SELECT a.track, a.frame, max(k.frame) AS anchor FROM ask a LEFT JOIN keyframes k ON k.track = a.track AND k.frame <= a.frame GROUP BY 1, 2""")
def seek_anchor(spark, sf_dir):
    return asof.bracket(ask(spark, sf_dir), src.keyframes(spark, sf_dir), "x").select("track", "frame", F.col("left").alias("anchor"))


@query("asof_interpolation", f"""
WITH {K}, {ASK}, b AS (SELECT a.track, a.frame, (SELECT max(frame) FROM keyframes k WHERE k.track = a.track AND k.frame <= a.frame) AS l, (SELECT min(frame) FROM keyframes k WHERE k.track = a.track AND k.frame >= a.frame) AS r FROM ask a)
SELECT b.track, b.frame, round(p.y + (q.y - p.y) * CASE WHEN l = r THEN 0.0 ELSE CAST(b.frame - l AS DOUBLE) / (r - l) END, 6) AS y
FROM b JOIN keyframes p ON p.track = b.track AND p.frame = l JOIN keyframes q ON q.track = b.track AND q.frame = r""")
def asof_interpolation(spark, sf_dir):
    b = asof.bracket(ask(spark, sf_dir), src.keyframes(spark, sf_dir), "y").where("left IS NOT NULL AND right IS NOT NULL")
    return b.select("track", "frame", F.round(F.expr("left_value + (right_value - left_value) * alpha"), 6).alias("y"))


NEAR = f"""{K}, {ASK}, n AS (SELECT a.track, a.frame, k.frame AS nearest, abs(a.frame - k.frame) AS distance, k.y,
  row_number() OVER (PARTITION BY a.track, a.frame ORDER BY abs(a.frame - k.frame), k.frame) AS p FROM ask a JOIN keyframes k ON k.track = a.track)"""


@query("nearest_keyframe", f"WITH {NEAR} SELECT track, frame, nearest, distance, y FROM n WHERE p = 1")
def nearest_keyframe(spark, sf_dir):
    return asof.nearest(ask(spark, sf_dir), src.keyframes(spark, sf_dir), "y").where("nearest IS NOT NULL").withColumnRenamed("value", "y")


@query("keyframe_within_radius", f"WITH {NEAR} SELECT track, frame, distance <= 30 AS near FROM n WHERE p = 1")
def keyframe_within_radius(spark, sf_dir):
    n = asof.nearest(ask(spark, sf_dir), src.keyframes(spark, sf_dir), "y").where("nearest IS NOT NULL")
    return n.select("track", "frame", (F.col("distance") <= 30).alias("near"))


@query("interval_contains_cut", f"""
WITH {T}, {SEEN}, {src.CUTS}, n AS (SELECT track, frame, lag(frame) OVER (PARTITION BY track ORDER BY frame) AS f0 FROM seen)
SELECT track, frame, EXISTS (SELECT 1 FROM cuts c WHERE c.frame > n.f0 AND c.frame <= n.frame) AS crosses FROM n WHERE f0 IS NOT NULL""")
def interval_contains_cut(spark, sf_dir):
    s = tracks.scene_of(seen(spark, sf_dir), src.cuts(spark, sf_dir))
    s = s.withColumn("s0", F.lag("scene").over(Window.partitionBy("track").orderBy("frame"))).where("s0 IS NOT NULL")
    return s.select("track", "frame", (F.col("scene") != F.col("s0")).alias("crosses"))


@query("dense_materialisation", f"""
WITH {K}, n AS (SELECT *, lead(frame) OVER w AS f2, lead(y) OVER w AS y2 FROM keyframes WINDOW w AS (PARTITION BY track ORDER BY frame)),
x AS (SELECT *, unnest(range(frame, CASE WHEN f2 IS NULL OR f2 - frame > 60 THEN frame + 1 ELSE f2 END)) AS pos FROM n)
SELECT track, pos AS frame, CAST(CAST(y AS FLOAT) + CASE WHEN pos = frame THEN CAST(0 AS FLOAT) ELSE CAST((CAST(y2 AS FLOAT) - CAST(y AS FLOAT)) * CAST(CAST(pos - frame AS DOUBLE) / (f2 - frame) AS FLOAT) AS FLOAT) END AS DOUBLE) AS y, pos = frame AS is_key FROM x""")
def dense_materialisation(spark, sf_dir):
    d = asof.densify(src.keyframes(spark, sf_dir), ["y"], max_span=60)
    return d.select("track", "frame", F.col("y").cast("double").alias("y"), "is_key")


@query("keyframe_import", f"""
WITH {T}, {SEEN}, b AS (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN 0 ELSE 1 END AS brk FROM seen WINDOW w AS (PARTITION BY track ORDER BY frame)),
r AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM b),
e AS (SELECT *, min(frame) OVER (PARTITION BY track, run) AS lo, max(frame) OVER (PARTITION BY track, run) AS hi FROM r),
k AS (SELECT *, CASE WHEN frame IN (lo, hi) THEN 'segment_endpoint' ELSE 'fixed_interval' END AS reason FROM e WHERE frame IN (lo, hi) OR (frame - lo) % 3 = 0)
SELECT track, run, frame, reason, row_number() OVER (PARTITION BY track, run ORDER BY frame) - 1 AS keyframe_index FROM k""")
def keyframe_import(spark, sf_dir):
    return keyframes.fixed_interval(seen(spark, sf_dir), 3).select("track", "run", "frame", "reason", F.col("keyframe_index").cast("long").alias("keyframe_index"))


@query("identity_segments", f"""
WITH {T}, {SEEN}, {src.CUTS}, s AS (SELECT *, (SELECT count(*) FROM cuts c WHERE c.frame <= seen.frame) AS scene FROM seen)
SELECT track, scene, label, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n, row_number() OVER (PARTITION BY track ORDER BY scene, label) - 1 AS segment FROM s GROUP BY 1, 2, 3""")
def identity_segments(spark, sf_dir):
    s = tracks.scene_of(seen(spark, sf_dir), src.cuts(spark, sf_dir)).groupBy("track", F.col("scene").cast("long").alias("scene"), "label").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"))
    return s.withColumn("segment", F.row_number().over(Window.partitionBy("track").orderBy("scene", "label")).cast("long") - 1)


# ---- sets and changes ----------------------------------------------------------------------------------------------


@query("upsert_rows", f"""
WITH {T}, o AS (SELECT user_id AS track, max(value) AS top, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1),
w AS (SELECT user_id AS track, CASE WHEN max(value) > 60 THEN max(value) END AS top, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(o.track, w.track) AS track, coalesce(w.top, o.top) AS top, coalesce(w.n, o.n) AS n FROM o FULL JOIN w ON o.track = w.track""")
def upsert_rows(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    o = t.where("label = 'view'").groupBy("track").agg(F.max("value").alias("top"), F.count("*").alias("n"))
    w = t.where("label = 'error'").groupBy("track").agg(F.when(F.max("value") > 60, F.max("value")).alias("top"), F.count("*").alias("n"))
    return merge.upsert(o, w, ["track"])


@query("insert_ignore", f"""
WITH {T}, o AS (SELECT DISTINCT track, frame, 'old' AS origin FROM tracks WHERE label = 'view'), w AS (SELECT track, frame, min(event_id) AS e FROM tracks WHERE label <> 'view' GROUP BY 1, 2)
SELECT * FROM o UNION ALL SELECT track, frame, 'new' FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.track = w.track AND o.frame = w.frame)""")
def insert_ignore(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    o = t.where("label = 'view'").select("track", "frame").distinct().select("track", "frame", F.lit("old").alias("origin"), F.lit(None).cast("long").alias("e"))
    w = t.where("label <> 'view'").select("track", "frame", F.lit("new").alias("origin"), F.col("event_id").alias("e"))
    return merge.insert_ignore(o, w, ["track", "frame"], "e").drop("e")


@query("delete_by_key", f"WITH {T} SELECT event_id, track FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM tracks e WHERE e.label = 'error' AND e.track = t.track AND e.frame = t.frame)")
def delete_by_key(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    return merge.delete_keys(t, t.where("label = 'error'"), ["track", "frame"]).select("event_id", "track")


@query("update_by_key", f"""
WITH {T}, s AS (SELECT track, max(value) AS top FROM tracks GROUP BY track HAVING max(value) > 80) SELECT t.event_id, CASE WHEN s.track IS NULL THEN t.value ELSE s.top END AS value FROM tracks t LEFT JOIN s ON s.track = t.track""")
def update_by_key(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    s = t.groupBy("track").agg(F.max("value").alias("top")).where("top > 80")
    return t.join(s, "track", "left").select("event_id", F.coalesce("top", "value").alias("value"))


@query("disjoint_union", f"WITH {T} SELECT 'main' AS domain, track, frame FROM tracks WHERE label <> 'error' UNION ALL SELECT 'face', track, frame FROM tracks WHERE label = 'error'")
def disjoint_union(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    part = lambda d, c: t.where(c).select(F.lit(d).alias("domain"), "track", "frame")
    return part("main", "label <> 'error'").unionByName(part("face", "label = 'error'"))


@query("key_set_operations", f"""
WITH {T}, a AS (SELECT DISTINCT track, frame FROM tracks WHERE label = 'view'), b AS (SELECT DISTINCT track, frame FROM tracks WHERE label = 'click')
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_union, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_left""")
def key_set_operations(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    a, b = (t.where(F.col("label") == x).select("track", "frame") for x in ("view", "click"))
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(a.union(b).distinct(), "n_union").crossJoin(n(a.intersect(b), "n_both")).crossJoin(n(a.subtract(b), "n_left"))


@query("table_differences", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 97 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def table_differences(spark, sf_dir):
    a = src.table(spark, sf_dir, "lineitem")
    b = a.withColumn("l_quantity", F.when(F.col("l_partkey") % 97 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    cols = ["l_orderkey", "l_linenumber", "l_quantity"]
    return merge.differences(a.select(cols), b.select(cols))


@query("distinct_frames", f"WITH {B} SELECT DISTINCT frame FROM boxes WHERE frame BETWEEN 1000 AND 9000")
def distinct_frames(spark, sf_dir):
    return src.boxes(spark, sf_dir).where("frame BETWEEN 1000 AND 9000").select("frame").distinct()


@query("id_remapping", "SELECT c_custkey AS old_id, row_number() OVER (ORDER BY c_custkey) + 5000 AS new_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def id_remapping(spark, sf_dir):
    return merge.renumber(src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("old_id")), ["old_id"], 5000).withColumn("new_id", F.col("new_id").cast("long"))


@query("run_ledger_upsert", """
WITH l AS (SELECT o_orderpriority AS kind, sha256(o_orderstatus) AS config_sha, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT kind, config_sha, n + 1000000 AS n FROM l WHERE kind IN ('1-URGENT', '5-LOW'))
SELECT * FROM l WHERE kind NOT IN ('1-URGENT', '5-LOW') UNION ALL SELECT * FROM r""")
def run_ledger_upsert(spark, sf_dir):
    o = src.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.sha2("o_orderstatus", 256).alias("config_sha")).agg(F.count("*").alias("n"))
    return merge.run_ledger(o, o.where("kind IN ('1-URGENT', '5-LOW')").withColumn("n", F.col("n") + 1000000))


@query("top_tracks", f"WITH {T} SELECT track, count(*) AS n FROM tracks GROUP BY track ORDER BY n DESC, track LIMIT 10")
def top_tracks(spark, sf_dir):
    return src.tracks(spark, sf_dir).groupBy("track").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "track").limit(10)


@query("row_and_track_counts", f"WITH {T} SELECT count(*) AS n_rows, count(DISTINCT track) AS n_tracks, min(frame) AS first_frame, max(frame) AS last_frame FROM tracks")
def row_and_track_counts(spark, sf_dir):
    return src.tracks(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.countDistinct("track").alias("n_tracks"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("natural_id_order", """
WITH i AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer)
SELECT id, row_number() OVER (ORDER BY try_cast(id AS BIGINT) IS NULL, try_cast(id AS BIGINT), id) AS place FROM i""")
def natural_id_order(spark, sf_dir):
    i = src.table(spark, sf_dir, "customer").select(F.expr("CASE WHEN c_custkey % 7 = 0 THEN concat('x', c_custkey) ELSE CAST(c_custkey AS STRING) END").alias("id"))
    n = F.expr("try_cast(id AS BIGINT)")
    return i.select("id", F.row_number().over(Window.orderBy(n.isNull(), n, "id")).cast("long").alias("place"))


@query("legacy_export", f"""
WITH {T}, m AS (SELECT track, frame, CASE WHEN value > 5 THEN label END AS label, event_id FROM tracks),
f AS (SELECT track, arg_min(label, frame * 1000000 + event_id) FILTER (WHERE label IS NOT NULL) AS label FROM m GROUP BY track)
SELECT CAST(f.track AS VARCHAR) AS track_id, coalesce(nullif(f.label, ''), 'unknown') AS label, count(*) AS masks FROM m JOIN f ON m.track = f.track GROUP BY 1, 2""")
def legacy_export(spark, sf_dir):
    m = src.tracks(spark, sf_dir).withColumn("l", F.when(F.col("value") > 5, F.col("label")))
    g = m.groupBy("track").agg(F.min_by("l", F.when(F.col("l").isNotNull(), F.struct("frame", "event_id"))).alias("label"), F.count("*").alias("masks"))
    return g.select(F.col("track").cast("string").alias("track_id"), F.coalesce(F.nullif("label", F.lit("")), F.lit("unknown")).alias("label"), "masks")


@query("label_fallback", f"""
WITH {T}, d AS (SELECT user_id AS track, CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 4 = 1 THEN NULL ELSE 'subject' END AS label FROM events GROUP BY user_id)
SELECT d.track, coalesce(nullif(d.label, ''), max(nullif(t.label, '')), '') AS label FROM d JOIN tracks t ON t.track = d.track GROUP BY d.track, d.label""")
def label_fallback(spark, sf_dir):
    g = src.tracks(spark, sf_dir).groupBy("track").agg(F.max(F.nullif("label", F.lit(""))).alias("seen"))
    own = F.expr("CASE WHEN track % 4 = 0 THEN '' WHEN track % 4 = 1 THEN NULL ELSE 'subject' END")
    return g.select("track", F.coalesce(F.nullif(own, F.lit("")), "seen", F.lit("")).alias("label"))


# ---- validation ----------------------------------------------------------------------------------------------------


@query("mask_contract", f"""
WITH {T}, {src.CUTS} SELECT 'frame_not_negative' AS rule, count(*) AS violations FROM tracks WHERE frame - 473400 < 0
UNION ALL SELECT 'track_not_empty', count(*) FROM tracks WHERE track IS NULL UNION ALL SELECT 'polygons_present', count(*) FROM tracks WHERE value < 1
UNION ALL SELECT 'key_unique', count(*) FROM (SELECT frame, track FROM tracks GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'cut_count_matches', CASE WHEN (SELECT count(*) FROM cuts) = 3 THEN 0 ELSE 1 END""")
def mask_contract(spark, sf_dir):
    masks = src.tracks(spark, sf_dir).select((F.col("frame") - 473400).alias("frame"), "track", F.when(F.col("value") >= 1, "[]").alias("polygons"))
    return validate.report(validate.mask_rules(masks, src.cuts(spark, sf_dir), spark.range(3, 4).select(F.col("id").alias("cut_count"))))


@query("referential_checks", """
SELECT 'orders_without_customer' AS rule, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'lines_without_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)
UNION ALL SELECT 'customers_without_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def referential_checks(spark, sf_dir):
    t = lambda n: src.table(spark, sf_dir, n)
    return validate.report({
        "orders_without_customer": validate.missing_parents(t("orders"), t("customer").where("c_acctbal > 0"), "o_custkey", "c_custkey"),
        "lines_without_part": validate.missing_parents(t("lineitem"), t("part").where("p_size > 3"), "l_partkey", "p_partkey"),
        "customers_without_nation": validate.missing_parents(t("customer"), t("nation"), "c_nationkey", "n_nationkey"),
    })


@query("group_size_checks", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) NOT BETWEEN 2 AND 6")
def group_size_checks(spark, sf_dir):
    return validate.group_size(src.table(spark, sf_dir, "lineitem"), ["l_orderkey"], 2, 6)


@query("provenance_bracket", f"""
WITH {K}, {ASK} SELECT a.track, a.frame FROM ask a WHERE NOT EXISTS (SELECT 1 FROM keyframes k WHERE k.track = a.track)
  OR NOT (EXISTS (SELECT 1 FROM keyframes k WHERE k.track = a.track AND k.frame <= a.frame) AND EXISTS (SELECT 1 FROM keyframes k WHERE k.track = a.track AND k.frame >= a.frame))""")
def provenance_bracket(spark, sf_dir):
    used = ask(spark, sf_dir).withColumnRenamed("track", "segment")
    return keyframes.provenance_violations(used, src.keyframes(spark, sf_dir).withColumnRenamed("track", "segment")).withColumnRenamed("segment", "track")


@query("cardinality_ratios", """
SELECT (SELECT count(*) FROM lineitem) AS children, (SELECT count(*) FROM orders) AS parents, (SELECT count(*) FROM lineitem) = 4 * (SELECT count(*) FROM orders) AS holds""")
def cardinality_ratios(spark, sf_dir):
    c = src.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("children"))
    return c.crossJoin(src.table(spark, sf_dir, "orders").agg(F.count("*").alias("parents"))).withColumn("holds", F.col("children") == 4 * F.col("parents"))


@query("capability_counts", """
SELECT name, n, n > 0 AS available FROM (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'empty', 0)""")
def capability_counts(spark, sf_dir):
    t = lambda n, df: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    part = src.table(spark, sf_dir, "part")
    u = t("region", src.table(spark, sf_dir, "region")).union(t("nation", src.table(spark, sf_dir, "nation"))).union(t("part", part)).union(t("empty", part.where("p_size < 0")))
    return u.withColumn("available", F.col("n") > 0)


@query("range_tiling", """
WITH w AS (SELECT o_custkey % 20 AS worker, min(o_orderkey) AS s, max(o_orderkey) AS e FROM orders GROUP BY 1), l AS (SELECT *, lag(e) OVER (ORDER BY s, worker) AS p FROM w)
SELECT worker, s, e, p IS NOT NULL AND s <> p + 1 AS broken FROM l""")
def range_tiling(spark, sf_dir):
    w = src.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("worker")).agg(F.min("o_orderkey").alias("s"), F.max("o_orderkey").alias("e"))
    w = w.withColumn("p", F.lag("e").over(Window.orderBy("s", "worker")))
    return w.select("worker", "s", "e", F.expr("p IS NOT NULL AND s <> p + 1").alias("broken"))


@query("timestamp_grid", f"""
WITH {T}, n AS (SELECT track, t, row_number() OVER w - 1 AS i, t - lag(t) OVER w AS delta, first_value(t) OVER w AS t0 FROM (SELECT DISTINCT track, t FROM tracks) WINDOW w AS (PARTITION BY track ORDER BY t))
SELECT track, max(delta) AS max_delta, min(delta) AS min_delta, max(abs(t - t0 - i * 36000)) AS drift FROM n GROUP BY track""")
def timestamp_grid(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("t")
    n = src.tracks(spark, sf_dir).select("track", "t").distinct().select("track", "t", (F.row_number().over(w) - 1).alias("i"), (F.col("t") - F.lag("t").over(w)).alias("delta"), F.first("t").over(w).alias("t0"))
    return n.groupBy("track").agg(F.max("delta").alias("max_delta"), F.min("delta").alias("min_delta"), F.max(F.abs(F.expr("t - t0 - i * 36000"))).alias("drift"))


@query("duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


# ---- telemetry -----------------------------------------------------------------------------------------------------


@query("sample_summary", f"""
WITH {T}, s AS (SELECT label, list_sort(list(value)) AS v FROM tracks GROUP BY label)
SELECT label, CAST(len(v) AS BIGINT) AS n, v[1] AS minimum, v[len(v)] AS maximum, round(list_avg(v), 6) AS mean, v[CAST(least(len(v) - 1, floor(len(v) * 0.5)) AS BIGINT) + 1] AS p50, v[CAST(least(len(v) - 1, floor(len(v) * 0.95)) AS BIGINT) + 1] AS p95 FROM s""")
def sample_summary(spark, sf_dir):
    return telemetry.summary(src.tracks(spark, sf_dir), ["label"], "value").withColumn("mean", F.round("mean", 6))


@query("leak_slope", f"WITH {T} SELECT track, CASE WHEN count(*) >= 3 THEN round(regr_slope(value, t) * 3600, 6) END AS slope FROM tracks GROUP BY track")
def leak_slope(spark, sf_dir):
    return telemetry.slope_per_hour(src.tracks(spark, sf_dir), ["track"], "t", "value").withColumn("slope", F.round("slope", 6))


@query("quarter_change", f"""
WITH {T}, s AS (SELECT track, value, row_number() OVER (PARTITION BY track ORDER BY t, value) AS k, count(*) OVER (PARTITION BY track) AS n FROM tracks),
g AS (SELECT track, median(value) FILTER (WHERE k <= greatest(1, n // 4)) AS first, median(value) FILTER (WHERE k > n - greatest(1, n // 4)) AS last FROM s GROUP BY track)
SELECT track, round(first, 6) AS first, round(last, 6) AS last, round(CASE WHEN first <> 0 THEN (last - first) / first * 100 END, 4) AS change FROM g""")
def quarter_change(spark, sf_dir):
    q = telemetry.quarter_change(src.tracks(spark, sf_dir), ["track"], "t", "value")
    return q.select("track", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round("change", 4).alias("change"))


@query("stable_tail", f"""
WITH {T}, s AS (SELECT track, value, row_number() OVER (PARTITION BY track ORDER BY t) AS k, count(*) OVER (PARTITION BY track) AS n FROM (SELECT track, t, max(value) AS value FROM tracks GROUP BY 1, 2))
SELECT track, count(*) AS n, max(value) AS top FROM s WHERE n < 20 OR k > n - floor(n * 0.4) GROUP BY track""")
def stable_tail(spark, sf_dir):
    s = src.tracks(spark, sf_dir).groupBy("track", "t").agg(F.max("value").alias("value"))
    return telemetry.stable_tail(s, ["track"], "t").groupBy("track").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("phase_summary", f"""
WITH {T} SELECT CASE WHEN value >= 50 THEN 'peak' WHEN label IN ('view', 'click') THEN 'browse' ELSE 'idle' END AS phase, count(*) AS n, round(avg(value), 6) AS mean FROM tracks GROUP BY 1""")
def phase_summary(spark, sf_dir):
    p = telemetry.phase([("peak", F.col("value") >= 50), ("browse", F.col("label").isin("view", "click"))])
    return src.tracks(spark, sf_dir).groupBy(p.alias("phase")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("per_job_summary", f"""
WITH {T}, j AS (SELECT event_id, value, unnest(list_distinct(regexp_extract_all('job-' || (track % 5) || ' job-' || (event_id % 3) || ' ' || props, 'job-([0-9]+)', 1))) AS job FROM tracks) SELECT job, count(*) AS n, max(value) AS top FROM j GROUP BY job""")
def per_job_summary(spark, sf_dir):
    t = src.tracks(spark, sf_dir).withColumn("text", F.expr("concat('job-', track % 5, ' job-', event_id % 3, ' ', props)"))
    return telemetry.by_job(t, "text", "job-([0-9]+)").groupBy("job").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("active_intervals", f"""
WITH {T}, s AS (SELECT track, value >= 15 AS a, coalesce(lag(value >= 15) OVER (PARTITION BY track ORDER BY event_id), FALSE) AS p FROM tracks)
SELECT track, CAST(sum(CASE WHEN a AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS intervals, CAST(sum(CASE WHEN p AND NOT a THEN 1 ELSE 0 END) AS BIGINT) AS "returns" FROM s GROUP BY track""")
def active_intervals(spark, sf_dir):
    return telemetry.active_intervals(src.tracks(spark, sf_dir), ["track"], "event_id", F.col("value") >= 15)


@query("progress_regressions", f"""
WITH {T}, s AS (SELECT track, value, lag(value) OVER (PARTITION BY track ORDER BY event_id) AS p FROM tracks) SELECT track, CAST(sum(CASE WHEN value + 1e-9 < p THEN 1 ELSE 0 END) AS BIGINT) AS regressions FROM s GROUP BY track""")
def progress_regressions(spark, sf_dir):
    return telemetry.regressions(src.tracks(spark, sf_dir), ["track"], "event_id", "value")


@query("event_capture", f"""
WITH {T}, q AS (SELECT quantile_cont(value, 0.95) AS thr FROM tracks), e AS (SELECT track, frame, value >= thr AS ev, frame % 6 = 0 AS near FROM tracks, q)
SELECT CAST(sum(CASE WHEN ev THEN 1 ELSE 0 END) AS BIGINT) AS events, round(avg(CASE WHEN near THEN 1.0 ELSE 0.0 END) FILTER (WHERE ev), 6) AS captured, round(avg(CASE WHEN near THEN 1.0 ELSE 0.0 END) FILTER (WHERE ev) / avg(CASE WHEN near THEN 1.0 ELSE 0.0 END), 6) AS lift FROM e""")
def event_capture(spark, sf_dir):
    t = src.tracks(spark, sf_dir)
    e = t.crossJoin(F.broadcast(t.agg(geo.percentile("value", 0.95).alias("thr")))).withColumn("ev", F.col("value") >= F.col("thr")).withColumn("near", (F.col("frame") % 6 == 0).cast("double"))
    hit = F.avg(F.when(F.col("ev"), F.col("near")))
    return e.agg(F.sum(F.col("ev").cast("long")).alias("events"), F.round(hit, 6).alias("captured"), F.round(hit / F.avg("near"), 6).alias("lift"))


@query("event_window_counts", """
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_window_counts(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


# ---- functions -----------------------------------------------------------------------------------------------------


@query("ring_measures", f"""
WITH {src.RINGS} SELECT frame, track, round(list_sum(list_transform(range(1, 33), lambda i: ring[i].x * ring[i % 32 + 1].y - ring[i % 32 + 1].x * ring[i].y)) / 2, 4) AS area,
  round(list_sum(list_transform(ring, lambda p: p.x)) / 32, 6) AS cx, round(list_sum(list_transform(ring, lambda p: p.y)) / 32, 6) AS cy, list_min(list_transform(ring, lambda p: p.x)) AS x1, list_max(list_transform(ring, lambda p: p.y)) AS y2 FROM rings""")
def ring_measures(spark, sf_dir):
    r = src.rings(spark, sf_dir)
    ring = F.col("ring")
    m = r.select("frame", "track", F.round(geo.signed_area(ring), 4).alias("area"), F.round(geo.vertex_mean(ring, "x"), 6).alias("cx"), F.round(geo.vertex_mean(ring, "y"), 6).alias("cy"), *geo.ring_box(ring))
    return m.drop("y1", "x2")


@query("ring_interpolation", f"""
WITH {src.RINGS}, n AS (SELECT *, lead(frame) OVER w AS f2, lead(ring) OVER w AS r2 FROM rings WINDOW w AS (PARTITION BY track ORDER BY frame))
SELECT track, frame, CAST(CAST(ring[1].x AS FLOAT) + CAST((CAST(r2[1].x AS FLOAT) - CAST(ring[1].x AS FLOAT)) * CAST(0.25 AS FLOAT) AS FLOAT) AS DOUBLE) AS x, CAST(CAST(ring[32].y AS FLOAT) + CAST((CAST(r2[32].y AS FLOAT) - CAST(ring[32].y AS FLOAT)) * CAST(0.25 AS FLOAT) AS FLOAT) AS DOUBLE) AS y FROM n WHERE f2 IS NOT NULL""")
def ring_interpolation(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("frame")
    n = src.rings(spark, sf_dir).withColumn("r2", F.lead("ring").over(w)).where("r2 IS NOT NULL").withColumn("m", geo.ring_lerp(F.col("ring"), F.col("r2"), F.lit(0.25)))
    return n.select("track", "frame", F.col("m")[0]["x"].cast("double").alias("x"), F.col("m")[31]["y"].cast("double").alias("y"))


@query("json_properties", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_properties(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("metadata_flatten", """SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, 'int' AS value_type FROM events
UNION ALL SELECT event_id, 'tags.0', event_type, 'str' FROM events UNION ALL SELECT event_id, 'tags.1', '', 'null' FROM events""")
def metadata_flatten(spark, sf_dir):
    from framelode.functions.metadata import flatten

    e = src.table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "tags": ["'), F.col("event_type"), F.lit('", null]}'))
    return flatten(e.select("event_id", doc.alias("doc")), "event_id", "doc")
