"""Text rules and word joins on hand-made cases, awkward rows among them."""

import pytest
from pyspark.sql import functions as F

from drawgraph.functions import text as x
from drawgraph.operators import leaders, review, spatial, words


def of(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_only_the_whole_prefix_is_skipped(spark):
    assert of(spark, x.line_ids, "RDX_1234 RD1-0001 RD_0001 LC-0002", "RD-0001", "", None) == [["LC_0002", "RD1_0001", "RDX_1234"], [], [], None]


@pytest.mark.parametrize("strict", [True, False])
def test_continuation_words(spark, strict):
    got = of(spark, lambda c: x.connection_class(c, strict), "SEE SHEET", "continuation", "СМ. чертеж", "SHEET 4", "TIE-IN SHEET 4", "valve", None)
    assert [r["kind"] for r in got] == ["other", "other", "other", "continuation", "tie_in", "other", "other"]
    assert [r["hint"] for r in got] == [not strict, not strict, not strict, True, False, False, False]


def test_cross_sheet_references(spark):
    texts = ("ЛИСТ 5", "ЛИСТА 5", "ЛИСТ-5", "ЛИСТ № 2", "Лист: 7", "ЛИСТ 200X300X6", "ЛИСТ   12", "см. лист №3, изм. 1", "ЛИСТ 9х9", None)
    assert of(spark, x.cross_sheet_reference, *texts) == [5, None, None, 2, 7, None, 12, 3, 9, None]


def test_stamp(spark):
    cols = "page int, idx int, text string, x0 double, x1 double, top double, bottom double"
    head = [(1, 3, "Номер", 100.0, 140.0, 600.0, 608.0), (1, 5, "линии", 150.0, 190.0, 603.0, 611.0)]
    value = [(1, 9, "0012", 140.0, 170.0, 620.0, 628.0), (1, 8, "LC -", 100.0, 130.0, 620.0, 628.0), (1, 10, "CO_0001", 300.0, 340.0, 620.0, 628.0)]
    far = [(2, 1, "номер", 0.0, 9.0, 5.0, 9.0), (2, 2, "линии", 10.0, 19.0, 9.5, 12.0), (2, 3, "LC_0001", 0.0, 9.0, 25.0, 30.0)]
    late = [(3, 1, "номер", 0.0, 9.0, 5.0, 9.0), (3, 7, "линии", 10.0, 19.0, 5.0, 9.0), (3, 8, "LC_0001", 0.0, 9.0, 25.0, 30.0), (4, None, None, None, None, None, None)]
    got = words.stamp_lines(spark.createDataFrame(head + value + far + late, cols)).collect()
    assert [(r.page, r.line_id) for r in got] == [(1, "LC_0012")]


def test_dimension_numbers(spark):
    cols = "page int, block int, line int, word_id int, text string, x0 double, y0 double, x1 double, y1 double"
    w = lambda line, i, text, x0, y0=100.0: (1, 0, line, i, text, x0, y0, x0 + 8, y0 + 8)
    rows = [w(0, 1, "120,5", 100.0), w(1, 2, "X", 200.0), w(1, 3, "450", 220.0), w(2, 4, "99", 300.0), w(3, 5, "77", 900.0), w(4, 6, "120,5", 100.04), w(5, 7, None, 100.0), w(6, 8, "0", 100.0), w(7, 9, "X5", 500.0), w(7, 10, "12", 520.0)]
    box = spark.createDataFrame([(1, 295.0, 95.0, 312.0, 112.0), (2, 0.0, 0.0, 999.0, 999.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    got = {r.word_id: (r.value, r.rule) for r in words.dimension_numbers(spark.createDataFrame(rows, cols), box).collect()}
    assert got == {1: (120.5, None), 3: (450.0, "coord"), 4: (99.0, "inside_rect"), 10: (12.0, "coord")}
    coordinates = words.word_coordinates(spark.createDataFrame([*rows, w(1, 11, "470", 240.0), w(1, 12, "9", 100.0)], cols)).collect()
    assert [(r.label_id, r.label, r.word_id, r.value) for r in coordinates] == [(2, "X", 3, "450")]


def test_drawing_area(spark):
    got = spark.createDataFrame([(1190.0, 842.0), (842.0, 595.0), (1000.0, 500.0)], "w double, h double").select("w", words.drawing_area(F.col("w"), F.col("h")).alias("a")).collect()
    assert [tuple(r.a) for r in got] == [(56.9, 13.0, 810.0, 705.0)] * 2 + [(0.0, 0.0, 650.0, 415.0)]


def stroke(page, i, a, b):
    return (page, i, {"x": float(a[0]), "y": float(a[1])}, {"x": float(b[0]), "y": float(b[1])})


def test_leader_targets_prefer_what_they_touch(spark):
    point = "struct<x:double,y:double>"
    lead = spark.createDataFrame([(1, 1, *[{"x": float(v[0]), "y": float(v[1])} for v in ((0, 0), (50, 0), (0, 100), (100, 100))])], f"page int, leader_id long, s {point}, e {point}, edge_a {point}, edge_b {point}")
    strokes = [stroke(1, 2, (50, -40), (50, 40)), stroke(1, 3, (56, -40), (56, 40)), stroke(1, 4, (52, 0), (62, 0)), stroke(1, 5, (50, 30), (90, 30)), stroke(1, 1, (0, 0), (50, 0)), stroke(2, 6, (50, -1), (50, 1))]
    rows = leaders.leader_targets(lead, spark.createDataFrame(strokes, f"page int, stroke_id long, a {point}, b {point}")).collect()
    assert [(r.leader_id, r.stroke_id, r.suspect) for r in rows] == [(1, 2, False)] and abs(rows[0].score - (0.25 * 40 + 0.12 * 60 - 0.02 * 80 + 0.12 * ((50**2 + 60**2) ** 0.5 - 60))) < 1e-6


def test_reviews_and_matches(spark):
    est = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "page int, candidate_id long")
    rev = spark.createDataFrame([("1:10", 0, "a"), ("9:10", 1, "b"), ("7:11", 3, "late"), ("8:11", 2, "early"), ("12", 4, "bare")], "key string, pos int, assessment string")
    assert sorted((r.candidate_id, r.assessment, r.matched) for r in review.reviewed(est, rev).collect()) == [(10, "a", "exact"), (11, "early", "suffix"), (12, None, None)]
    last = review.last_of(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, pos int, v string"), ["k"], "pos").collect()
    assert sorted((r.k, r.v) for r in last) == [(1, "y"), (2, "z")]


def test_touching_across_cells(spark):
    point = "struct<x:double,y:double>"
    edges = [stroke(1, 1, (0, 0), (11, 11)), stroke(1, 2, (13, 12), (80, 80)), stroke(1, 3, (80, 92), (99, 99)), stroke(1, 4, (80, 93), (80, 200)), stroke(2, 5, (0, 0), (11, 11)), (1, 6, None, None)]
    got = spatial.touching(spark.createDataFrame(edges, f"page int, edge_id long, a {point}, b {point}")).collect()
    assert sorted((r.first_id, r.second_id) for r in got) == [(1, 2), (2, 3), (3, 4)]


def test_extension_lines_strict_relaxed_and_mirrored(spark):
    """Dimension 1 from (0, 0) to (60, 0), its pipe 30 below; what leads from its left end, and what stands like its mirror image at the right one."""
    point = "struct<x:double,y:double>"
    dims = spark.createDataFrame([(1, 1, 1, 7, {"x": 0.0, "y": 0.0}, {"x": 60.0, "y": 0.0})], f"page int, dim_id long, own_id long, edge_id long, a {point}, b {point}")
    pipes = spark.createDataFrame([stroke(1, 7, (-50, 30), (150, 30))], f"page int, pipe_id long, a {point}, b {point}")
    left, strict, relaxed, mirror, along = stroke(1, 2, (0, 0), (0, 28)), stroke(1, 3, (60, 4), (60, 28)), stroke(1, 4, (60, 12), (60, 31)), stroke(1, 5, (70, 18), (70, 38)), stroke(1, 6, (50, 1), (70, 1))

    def found(*strokes):
        rows = leaders.extension_lines(dims, spark.createDataFrame([stroke(1, 1, (0, 0), (60, 0)), *strokes], f"page int, stroke_id long, a {point}, b {point}"), pipes).collect()
        return sorted((r.end, r.stroke_id, r.level, r.pipe_id) for r in rows)

    assert found(left, strict, relaxed, along) == [(0, 2, 0, 7), (1, 3, 0, 7)]
    assert found(left, relaxed, along) == [(0, 2, 0, 7), (1, 4, 1, 7)]
    assert found(left, mirror, along) == [(0, 2, 0, 7), (1, 5, 2, 7)]
    assert found(along) == [] and found(left) == [(0, 2, 0, 7)]
