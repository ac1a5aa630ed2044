"""Normalisation, policies, suppression and masks."""

import numpy as np
import pytest

from framelode.functions import raster, shapes
from framelode.operators import classwise, evaluate, filters, nms, rescale


def box(frame, idx, x1, y1, x2, y2, score, label="A"):
    return (frame, idx, float(x1), float(y1), float(x2), float(y2), score, label)


COLS = "frame long, idx long, x1 double, y1 double, x2 double, y2 double, score double, label string"


def test_identical_boxes_keep_the_better(spark):
    df = spark.createDataFrame([box(0, 0, 0, 0, 100, 100, 0.8), box(0, 1, 0, 0, 100, 100, 0.9)], COLS)
    assert [r.score for r in nms.box_nms(df, ["frame"]).collect()] == [0.9]


def test_ties_go_to_the_earlier(spark):
    df = spark.createDataFrame([box(0, 0, 0, 0, 50, 50, 0.5), box(0, 1, 1, 1, 50, 50, 0.5), box(1, 0, 0, 0, 9, 9, None)], COLS)
    assert sorted((r.frame, r.idx) for r in nms.box_nms(df, ["frame"]).collect()) == [(0, 0), (1, 0)]


def test_boxes_that_overlap_without_their_masks_both_stay(spark):
    tri = lambda p: [[list(map(float, q)) for q in p]]
    rows = [(0, 0, 0.0, 0.0, 100.0, 100.0, 0.9, tri([(0, 0), (100, 0), (0, 100)])), (0, 1, 0.0, 0.0, 100.0, 100.0, 0.8, tri([(100, 10), (100, 100), (10, 100)]))]
    df = spark.createDataFrame(rows, "frame long, idx long, x1 double, y1 double, x2 double, y2 double, score double, polygons array<array<array<double>>>")
    assert nms.mask_nms(df, ["frame"]).count() == 2
    assert nms.box_nms(df, ["frame"]).count() == 1


def test_islands_are_cut_and_owners_stay(spark):
    square = lambda x, y, w: [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + w)], [float(x), float(y + w)]]
    rows = [(0, 0, 0.0, 0.0, 300.0, 100.0, 0.9, [square(0, 0, 99)]), (0, 1, 0.0, 0.0, 300.0, 100.0, 0.8, [square(200, 0, 99), square(10, 10, 30), square(150, 50, 1)])]
    df = spark.createDataFrame(rows, "frame long, idx long, x1 double, y1 double, x2 double, y2 double, score double, polygons array<array<array<double>>>")
    got = {r.idx: r for r in nms.component_nms(df, ["frame"]).collect()}
    assert len(got[1].polygons) == 1 and got[1].hint_area > 99 * 99
    assert len(got) == 2


def test_rectangle_fill_counts_edges():
    m = raster.crop_mask([[[2, 3], [12, 3], [12, 9], [2, 9]]])
    assert m.pixels == 11 * 7 and (m.x, m.y) == (2, 3)


def test_holes_and_crossing_rings():
    outer, hole = [[0, 0], [30, 0], [30, 30], [0, 30]], [[10, 10], [20, 10], [20, 20], [10, 20]]
    assert raster.ring_depths([outer, hole]) == [0, 1]
    assert raster.crop_mask([outer, hole]).pixels == 31 * 31 - 11 * 11
    crossing = [[20, 20], [50, 20], [50, 50], [20, 50]]
    assert raster.ring_depths([outer, crossing]) == [0, 0]


def test_fill_agrees_with_even_odd_inside():
    rng = np.random.default_rng(4)
    for _ in range(20):
        p = rng.integers(0, 40, (6, 2)).astype(float)
        m = raster.crop_mask([p.tolist()])
        for x, y in rng.integers(0, 40, (40, 2)):
            if raster.inside(np.array([x, y], float), p) and 0 <= y - m.y < m.grid.shape[0] and 0 <= x - m.x < m.grid.shape[1]:
                assert m.grid[y - m.y, x - m.x]


def test_score_policy_spellings_and_bounds(spark):
    p = filters.load_score_policy('{"default": {"threshold": 0.4}, "classes": {"A": {"score_min": 0.5}, "B": {"min_score": "x", "score": 0.1}}}')
    assert p == {"default": 0.4, "classes": {"A": 0.5, "B": 0.1}}
    df = spark.createDataFrame([("A", 0.5), ("A", 0.49), ("B", 0.1), ("C", 0.4), ("C", None), ("C", float("nan")), ("C", float("inf"))], "label string, score double")
    assert sorted((r.label, r.score) for r in filters.score_policy(df, p).collect()) == [("A", 0.5), ("B", 0.1), ("C", 0.4)]


def test_record_dialects(spark):
    df = spark.createDataFrame([(3, [(" ", [10.0, 10.0, -5.0, 4.0], 0.7)])], "frame_idx long, instances array<struct<label:string,bbox:array<double>,cls_score:double>>")
    r = filters.normalise_records(df).first()
    assert (r.frame, r.label, r.class_name, r.bbox_xyxy, r.score) == (3, "unknown", "unknown", [10, 10, 10, 14], 0.7)


def test_rescale(spark):
    df = spark.createDataFrame([(10.0, 20.0)], "x double, y double")
    assert tuple(rescale.rescale(df, (960, 540), (1920, 1080), ["x"], ["y"]).first()) == (20.0, 40.0)
    with pytest.raises(ValueError):
        rescale.rescale(df, (960, 540), (1920, 1000), ["x"], ["y"])


def test_class_policy(spark):
    p = classwise.load_policy('{"schema_version": 1, "default": {"keyframe_interval": 3}, "classes": {"A": {"keyframe_interval": 2}}}')
    df = spark.createDataFrame([("A",), ("B",)], "label string")
    assert {r.label: r.keyframe_interval for r in classwise.route(df, p).collect()} == {"A": 2, "B": 3}
    for bad in ('{"schema_version": 3}', '{"schema_version": 1, "classes": {"A": {"shape": "ellipse"}}}', '{"schema_version": 1, "other": 1}'):
        with pytest.raises(ValueError):
            classwise.load_policy(bad)


def test_quality_of_equal_and_missing_masks(spark):
    square = [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]]
    kind = "frame long, track string, polygons array<array<array<double>>>"
    ref = spark.createDataFrame([(0, "a", square), (1, "a", square)], kind)
    m = evaluate.metrics(evaluate.mask_areas(ref, ref.where("frame = 0"))).first()
    assert (m.micro_iou, m.micro_precision, m.micro_recall, m.macro_iou, m.weighted_error) == (0.5, 1.0, 0.5, 0.5, 200.0)
    empty = evaluate.metrics(evaluate.mask_areas(ref.limit(0), ref.limit(0))).first()
    assert empty.macro_iou is None


def test_assignment_is_cheapest():
    import itertools

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (5, 5)):
        cost = rng.random((n, m))
        got = shapes.assign(cost)
        total = sum(cost[i, j] for i, j in enumerate(got) if j >= 0)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert total == pytest.approx(best) and (got >= 0).sum() == min(n, m)


def test_contours():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert np.allclose(shapes.resample(square, 8)[1], [5, 0])
    turned = np.roll(square, -2, axis=0)[::-1]
    assert np.allclose(shapes.align(square, turned), square)
    assert shapes.is_simple(square) and not shapes.is_simple(square[[0, 2, 1, 3]])
    ring = shapes.resample(square, 40)
    for f in (shapes.simplify_rdp, shapes.simplify_area):
        assert abs(shapes.signed_area(f(ring, 4))) == pytest.approx(100)
        assert len(f(ring, 9)) == 9
    c, s = np.cos(0.3), np.sin(0.3)
    moved = 2 * square @ np.array([[c, s], [-s, c]]) + [3, 4]
    scale, angle, shift = shapes.similarity(square, moved)
    assert (scale, angle) == pytest.approx((2, 0.3)) and np.allclose(shift, [3, 4])
    assert shapes.motion(square, moved)["rms_similarity"] == pytest.approx(0, abs=1e-9)
    assert shapes.point_budget([70, 20, 10], 20) == [11, 5, 4] and sum(shapes.point_budget([5, 5, 5], 10)) == 10


def test_metadata_of_all_kinds():
    from framelode.functions.metadata import entries

    value = {"a": True, "b": False, "c": None, "d": {}, "e": [], "f": {"g": [1, 2.5, "x", None]}}
    assert list(entries(value)) == [("a", "1", "bool"), ("b", "0", "bool"), ("c", "", "null"), ("d", "", "empty_mapping"), ("e", "", "empty_sequence"), ("f.g.0", "1", "int"), ("f.g.1", "2.5", "float"), ("f.g.2", "x", "str"), ("f.g.3", "", "null")]


MASKS = [
    [[[0.4, 0.0], [9.6, 0.0], [9.6, 5.5], [0.4, 5.5]]], [[[3.0, 8.0], [3.0, 2.0], [7.0, 2.0], [7.0, 8.0]]], [[[5.0, 5.0], [5.0, 5.0], [5.0, 9.0], [5.0, 9.0]]], [[[7.0, 1.0], [2.0, 1.0], [2.0, 4.0], [7.0, 4.0]]],
    [[[0.0, 0.0], [8.0, 3.0], [8.0, 9.0]]], [[[0.0, 0.0], [6.0, 0.0], [0.0, 6.0], [6.0, 6.0]]], [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[2.0, 2.0], [9.0, 2.0], [9.0, 9.0], [2.0, 9.0]]], [], None, [[[1.0, 1.0], [4.0, 4.0]]],
]


def test_rectangles_are_counted_without_painting(spark):
    from pyspark.sql import functions as F

    from framelode.functions import geometry

    masks = spark.createDataFrame([(k, m) for k, m in enumerate(MASKS)], "k long, polygons array<array<array<double>>>")
    assert {r.k for r in masks.where(geometry.pixel_box(F.col("polygons")).isNotNull()).collect()} == {0, 1, 2, 3, 7}
    pairs = [(10 * i + j, i, j) for i in range(len(MASKS)) for j in range(len(MASKS))]
    kind = "frame long, track long, polygons array<array<array<double>>>"
    ref, pred = [(f, 0, MASKS[i]) for f, i, _ in pairs], [(f, 0, MASKS[j]) for f, _, j in pairs]
    got = {(r.frame, r.track): (r.ra, r.pa, r.i) for r in evaluate.mask_areas(spark.createDataFrame([*ref, (200, 0, MASKS[0])], kind), spark.createDataFrame([*pred, (201, 0, MASKS[4])], kind)).collect()}
    painted = [raster.crop_mask(m or [], union=True) for m in MASKS]
    want = {(f, 0): (painted[i].pixels, painted[j].pixels, raster.common_pixels(painted[i], painted[j])) for f, i, j in pairs}
    assert got == want | {(200, 0): (painted[0].pixels, 0, 0), (201, 0): (0, painted[4].pixels, 0)}


def test_rectangles_are_suppressed_by_components_as_painted_masks_are(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for frame in range(60):
        for idx in range(rng.integers(1, 9 if frame < 50 else 50)):
            x, y, w, h = (int(v) for v in rng.integers((0, 0, 0, 0), (60, 60, 70, 70)))
            ring = [[float(a), float(b)] for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
            score = (None, float("nan"), 0.5, 0.5, float(rng.random()))[rng.integers(5)]
            rows.append((None if frame == 3 else frame, idx, score, [] if rng.random() < 0.05 else [ring[::-1] if rng.random() < 0.3 else ring]))
    rows += [(70, 0, 0.9, [[[0.0, 0.0], [9.5, 0.0], [9.5, 9.0], [0.0, 9.0]]]), (70, 1, 0.8, [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]])]
    df = spark.createDataFrame(rows, "frame long, idx long, score double, polygons array<array<array<double>>>")
    answers = lambda limit: (monkeypatch.setattr(nms, "FOLDED", limit), sorted(map(repr, nms.component_nms(df, ["frame"]).collect())))[1]
    folded, painted = answers(32), answers(0)
    assert folded == painted and 60 < len(folded) < len(rows)
