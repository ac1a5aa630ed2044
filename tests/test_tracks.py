"""Trackers, scenes, keyframes, privacy masks, and their golden cases."""

import numpy as np
import pytest

from framelode.operators import asof, cuts, keyframes, privacy, track, tracks, validate

OBS = "video long, scene long, frame long, idx long, x1 double, y1 double, x2 double, y2 double, score double"


def obs(frame, x, score=0.95, scene=0, idx=0, w=40):
    return (0, scene, frame, idx, float(x), 10.0, float(x + w), 60.0, score)


def summaries(spark, rows):
    return sorted(track.track_faces(spark.createDataFrame(rows, OBS), summaries=True).collect(), key=lambda r: r.start)


def test_faces_bridge_a_short_gap(spark):
    s = summaries(spark, [obs(0, 10), obs(1, 12), obs(3, 16)])
    assert [(r.hits, r.removed) for r in s] == [(3, False)]


def test_a_cut_between_frames_ends_a_track(spark):
    s = summaries(spark, [obs(10, 10), obs(12, 10, scene=1)])
    assert [(r.scene, r.reason) for r in s] == [(0, "cut"), (1, "end_of_stream")]
    assert [r.raw_track for r in s] == ["face:raw:0:1", "face:raw:1:2"]


def test_short_weak_tracks_go(spark):
    s = summaries(spark, [obs(0, 10, 0.89), obs(1, 11, 0.88), obs(10, 10, 0.95), obs(11, 11, 0.89)])
    assert [r.removed for r in s] == [True, False] and s[0].reason == "max_gap"


def test_two_stages(spark):
    rows = [obs(0, 10), obs(1, 11, 0.3), obs(1, 300, 0.9, idx=1), obs(1, 600, 0.01, idx=2)]
    got = {(r.frame, r.idx): (r.raw_track, r.stage) for r in track.track_faces(spark.createDataFrame(rows, OBS)).collect()}
    assert got == {(0, 0): ("face:raw:0:1", "new_high"), (1, 0): ("face:raw:0:1", "low"), (1, 1): ("face:raw:0:2", "new_high"), (1, 2): ("face:raw:0:3", "new_below_low")}


def test_tracking_with_a_cut_and_resolution(spark):
    df = spark.createDataFrame([(0, f, 0, float(f % 2), 0.0, 100.0 + f % 2, 100.0, 0.9, "A") for f in range(4)], "video long, frame long, idx long, x1 double, y1 double, x2 double, y2 double, score double, label string")
    placed = tracks.scene_of(df, spark.createDataFrame([(2,)], "frame long"))
    got = track.track_boxes(placed)
    assert sorted((r.frame, r.track) for r in got.collect()) == [(0, 1), (1, 1), (2, 2), (3, 2)]


def test_scenes_are_those_of_the_video(spark):
    rows = [(v, f) for v in (1, 2, None) for f in (0, 5, 70_000, 140_000)]
    df = spark.createDataFrame(rows, "video long, frame long")
    cuts = spark.createDataFrame([(1, 5), (1, 100_000), (2, 70_000)], "video long, frame long")
    got = {(r.video, r.frame): r.scene for r in tracks.scene_of(df, cuts).collect()}
    assert got == {(1, 0): 0, (1, 5): 1, (1, 70_000): 1, (1, 140_000): 2, (2, 0): 0, (2, 5): 0, (2, 70_000): 1, (2, 140_000): 1}


def test_final_ids_go_on_over_blocks(spark):
    df = spark.createDataFrame([(t, "a", i) for t in (3, 70_000, 70_001, 900_000) for i in range(2 if t != 70_000 else 1)], "track long, label string, event_id long")
    got = {r.track: r.final_id for r in tracks.resolve(df, max_short=1).collect()}
    assert got == {3: 1, 70_000: None, 70_001: 2, 900_000: 3}


def test_pairs_prefer_the_larger_track():
    t = track.GreedyTracker()
    same = np.array([[0, 0, 100, 100], [0, 0, 100, 100]], float)
    nan = np.full(2, np.nan)
    assert t.step(0, same, nan) == [1, 2]
    assert t.step(1, same[:1], nan[:1]) == [2]
    assert t.step(40, same[:1], nan[:1]) == [3]


def test_majority_label_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "x", 5)], "track long, label string, event_id long")
    r = {x.track: x for x in tracks.resolve(df, max_short=1).collect()}
    assert r[1].label == "b" and r[1].final_id == 1 and r[2].removed and r[2].final_id is None


def test_refractory_depends_on_what_was_kept(spark):
    df = spark.createDataFrame([(0, f) for f in (0, 10, 20, 30, 31)], "video long, frame long")
    assert [r.frame for r in tracks.refractory(df, ["video"], 15).orderBy("frame").collect()] == [0, 20]


def test_cut_rules(spark):
    rows = [(0, 0, 80.0, 1.0, 1.0), (0, 100, 50.0, 0.97, 0.5), (0, 200, 50.0, 0.99, 0.5), (0, 300, 35.0, 0.9, 0.4), (0, 400, 35.0, 0.9, 0.5), (0, 500, 17.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "video long, frame long, diff double, corr double, ssim double")
    assert [r.frame for r in cuts.high_precision_cuts(df).orderBy("frame").collect()] == [0, 100, 300]


def test_nearest_prefers_the_earlier(spark):
    keys = spark.createDataFrame([(1, 0, 1.0), (1, 10, 2.0)], "track long, frame long, v double")
    ask = spark.createDataFrame([(1, 5), (1, 6), (1, -3), (1, 14), (2, 1)], "track long, frame long")
    got = {(r.track, r.frame): r.nearest for r in asof.nearest(ask, keys, "v").collect()}
    assert got == {(1, 5): 0, (1, 6): 10, (1, -3): 0, (1, 14): 10, (2, 1): None}


def test_densify_does_not_cross_scenes(spark):
    keys = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 4, 8.0), (1, 1, 8, 9.0)], "track long, scene long, frame long, v double")
    got = {r.frame: (r.v, r.is_key) for r in asof.densify(keys, ["v"], scene="scene").collect()}
    assert got == {0: (0.0, True), 1: (2.0, False), 2: (4.0, False), 3: (6.0, False), 4: (8.0, True), 8: (9.0, True)}


def test_paths_are_cheapest():
    import itertools

    rng = np.random.default_rng(2)
    for n in (3, 5, 8):
        t, q = np.arange(n, dtype=float), rng.normal(size=(n, 2))
        cost = keyframes.interval_errors(t, q)
        for i, j in itertools.combinations(range(n), 2):
            u = (t[i : j + 1] - t[i]) / (t[j] - t[i])
            fit = (1 - u)[:, None] * q[i] + u[:, None] * q[j]
            assert cost[i, j] == pytest.approx(((fit - q[i : j + 1]) ** 2).sum(), abs=1e-9)
        price = lambda p: sum(cost[a, b] for a, b in zip(p[:-1], p[1:], strict=True))
        for k in range(2, n + 1):
            best = min(price((0, *m, n - 1)) for m in itertools.combinations(range(1, n - 1), k - 2))
            path = keyframes.exact_k_path(t, cost.copy(), k, 100)
            assert len(path) == k and price(path) == pytest.approx(best)
        every = [(0, *m, n - 1) for r in range(n - 1) for m in itertools.combinations(range(1, n - 1), r)]
        for penalty in (0.0, 0.3, 2.0):
            p = keyframes.penalised_path(cost, penalty)
            assert price(p) + penalty * (len(p) - 1) == pytest.approx(min(price(e) + penalty * (len(e) - 1) for e in every))


def test_compression_keeps_ends_and_lines(spark):
    df = spark.createDataFrame([("a", 0, f, 2.0 * f) for f in range(25)], "track string, segment long, frame long, v double")
    got = keyframes.compress(df, ["v"]).orderBy("frame").collect()
    assert got[0].frame == 0 and got[-1].frame == 24 and len(got) < 10
    assert all(r.v == pytest.approx(2 * r.frame) for r in got)


def test_chunks_emit_each_row_once(spark):
    df = spark.createDataFrame([("a", f) for f in range(47)], "track string, frame long")
    c = tracks.chunks(df, ["track"], 12, 3)
    assert c.where("emit").count() == 47 and c.groupBy("chunk").count().agg({"count": "max"}).first()[0] <= 12


def test_privacy_masks():
    eye = lambda x, c=0.9: {"x": x, "y": 40.0, "class_name": "Eye", "confidence": c, "valid": True}
    ellipse = [50.0, 50.0, 40.0, 30.0, np.pi / 2]
    m = privacy.derive(ellipse, [eye(38.0), eye(62.0)])
    assert m["derivation"] == "eye-keypoints" and (m["cx"], m["cy"]) == (50, 40) and len(m["polygon"]) == 64
    assert m["half_width"] == pytest.approx(0.97 * 24) and m["half_height"] == pytest.approx(0.405 * 24)
    assert privacy.derive(ellipse, [eye(38.0, 0.1)])["derivation"] == "ellipse-fallback"
    assert privacy.derive([50.0, 50.0, 0.0, 30.0, 0.0], []) is None and privacy.derive(None, None) is None
    assert len(privacy.derive(ellipse, [], "face")["polygon"]) == 96


def test_contract_rules(spark):
    masks = spark.createDataFrame([(0, "1", "[]"), (0, "1", "[]"), (-1, " ", None)], "frame long, track string, polygons string")
    cut = spark.createDataFrame([(5,)], "frame long")
    declared = spark.createDataFrame([(2,)], "cut_count long")
    got = {r.rule: r.violations for r in validate.report(validate.mask_rules(masks, cut, declared)).collect()}
    assert got == {"frame_not_negative": 1, "track_not_empty": 1, "polygons_present": 1, "key_unique": 1, "cut_count_matches": 1}


def test_result_tables(spark):
    from framelode.operators import results

    s = results.segment_table(spark.createDataFrame([("b", 0, 9), ("a", 5, 8), ("a", 0, 3)], "track string, start_frame long, end_frame long"))
    assert sorted((r.segment_id, r.track, r.start_frame) for r in s.collect()) == [(1, "a", 0), (2, "a", 5), (3, "b", 0)]
    k = results.keyframe_table(spark.createDataFrame([("a", 1), ("a", 6), ("b", 2), ("b", 1)], "track string, frame long"), s)
    assert sorted((r.keyframe_id, r.segment_id, r.frame, r.keyframe_index) for r in k.collect()) == [(1, 1, 1, 0), (2, 2, 6, 0), (3, 3, 1, 0), (4, 3, 2, 1)]
    assert {r.name: r.available for r in results.capabilities({"s": s, "none": s.limit(0)}).collect()} == {"s": True, "none": False}
    assert list(results.compact({"masks": s, "k": k})) == ["k"]
    assert results.split_range(0, 9, [1, 1, 3]) == [(0, 1), (2, 3), (4, 9)] and results.split_range(5, 5, [1, 1]) in ([(5, 5)],)


def test_border_expansion(spark):
    from framelode.operators import borders

    df = spark.createDataFrame([(1, [(0.0, 40.0), (60.0, 40.0), (60.0, 60.0), (0.0, 60.0)]), (2, [(40.0, 40.0), (60.0, 40.0), (60.0, 60.0)])], "frame long, ring array<struct<x:double,y:double>>")
    got = {r.frame: [tuple(p) for p in r.ring] for r in borders.expand(df, (0.0, 0.0, 100.0, 100.0)).collect()}
    assert got[1][0] == (-6.0, 40.0) and got[1][1] == (60.0, 40.0) and got[2][0] == (40.0, 40.0)


def test_rings_between_keys(spark):
    from framelode.operators import rings

    a, b = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]], [[[8.0, 0.0], [12.0, 0.0], [12.0, 4.0], [8.0, 4.0]]]
    assert rings.between(a, b, 0.25)[0][0] == [2.0, 0.0]
    turned = [[b[0][2], b[0][3], b[0][0], b[0][1]]]
    assert np.allclose(rings.between(a, turned, 0.5, aligned=True), [[[4, 0], [8, 0], [8, 4], [4, 4]]])
    assert rings.between(a, b + a, 0.4) == a and len(rings.between(a, b + a, 0.5)) == 2
    df = spark.createDataFrame([("t", 0, 0, a), ("t", 0, 4, b), ("t", 1, 6, a)], "track string, scene long, frame long, polygons array<array<array<double>>>")
    got = {r.frame: (r.is_key, r.polygons[0][0][0]) for r in rings.densify_rings(df).collect()}
    assert got == {0: (True, 0.0), 1: (False, 2.0), 2: (False, 4.0), 3: (False, 6.0), 4: (True, 8.0), 6: (True, 0.0)}
    assert rings.densify_rings(df, max_span=2).count() == 3


def test_keys_grow_to_cover(spark):
    from framelode.operators import rings

    square = lambda w: [[[0.0, 0.0], [w, 0.0], [w, w], [0.0, w]]]
    kind = "frame long, track string, polygons array<array<array<double>>>"
    keys = spark.createDataFrame([(0, "a", square(97.0)), (1, "a", square(50.0))], kind)
    seen = spark.createDataFrame([(0, "a", square(100.0))], kind)
    got = {r.frame: r.polygons[0] for r in rings.repair_recall(keys, seen).collect()}
    assert got[0][2][0] > 97 and got[1] == square(50.0)[0]


def test_face_masks_fill_short_gaps(spark):
    from framelode.operators import faces

    eye = lambda x: (x, 40.0, "Eye", 0.9, True)
    rows = [(0, 0, f, 0, 10.0 + f, 10.0, 90.0 + f, 90.0, 0.95, 0.9 if f != 2 else 0.1, [50.0 + f, 50.0, 40.0, 30.0, np.pi / 2], [eye(38.0 + f), eye(62.0 + f)]) for f in (0, 1, 2, 3, 8)]
    df = spark.createDataFrame(rows, "video long, scene long, frame long, idx long, x1 double, y1 double, x2 double, y2 double, score double, face_score double, ellipse array<double>, keypoints array<struct<x:double,y:double,class_name:string,confidence:double,valid:boolean>>")
    got = sorted((r.frame, r.cx, r.interpolated) for r in faces.face_masks(df).collect())
    assert got == [(0, 50.0, False), (1, 51.0, False), (2, 52.0, True), (3, 53.0, False), (8, 58.0, False)]
    m = spark.createDataFrame([(0, "1"), (1, "1")], "frame long, track string")
    assert faces.merge_domains(m, m).count() == 4
    with pytest.raises(Exception, match="two masks"):
        faces.merge_domains(m.union(m), m).collect()
