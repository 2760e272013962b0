"""Strokes beside labels, ends of handwheel signs and of the contour, pages as text."""

from drawgraph.operators import assembly, contour, evaluate, leaders

XY = "struct<x: double, y: double>"
STROKES = f"page int, stroke_id long, a {XY}, b {XY}"
BESIDE = [(1, 1, (5.0, 0.0), (35.0, 0.0)), (1, 2, (-20.0, 3.0), (20.0, 3.0)), (1, 3, (4.0, 0.0), (9.0, 0.0)), (2, 4, (0.0, 0.0), (0.0, 40.0))]


def test_fallback_leaders(spark):
    strokes = spark.createDataFrame(BESIDE, STROKES)
    labels = spark.createDataFrame([(1, 7, (0.0, 0.0)), (1, 8, (500.0, 0.0))], f"page int, label_id long, p {XY}")
    assert [tuple(r) for r in leaders.fallback_leaders(labels, strokes).collect()] == [(1, 7, 1)]
    blocked = strokes.filter("stroke_id = 1").select("page", "stroke_id")
    assert [tuple(r) for r in leaders.fallback_leaders(labels, strokes, blocked).collect()] == [(1, 7, 2)]  # it passes by with its middle, but no other is left; 3 is too short
    assert leaders.fallback_leaders(labels.limit(0), strokes).count() == 0


def test_direct_strokes(spark):
    strokes = spark.createDataFrame([*BESIDE, (1, 5, (0.0, -20.0), (0.0, 20.0))], STROKES)
    labels = spark.createDataFrame([(1, 7, (0.0, 0.0), (0.0, 50.0), (90.0, 50.0)), (1, 9, (0.0, 0.0), None, None)], f"page int, label_id long, p {XY}, edge_a {XY}, edge_b {XY}")
    assert [tuple(r) for r in leaders.direct_strokes(labels, strokes).collect()] == [(1, 7, 2)]  # 5 goes through the label, but across the pipe


def test_glyph_spans(spark):
    sign = lambda n, x, y: (1, n, (x, y), [(x - 10, y - 10), (x + 10, y + 10), (x - 10, y + 10), (x + 10, y - 10)])
    glyphs = spark.createDataFrame([sign("on", 50.0, 0.0), sign("end", 95.0, 0.0), sign("gap", 120.0, 0.0), sign("far", 50.0, 80.0)], f"page int, glyph_id string, p {XY}, points array<{XY}>")
    edges = spark.createDataFrame([(1, 1, (0.0, 0.0), (100.0, 0.0))], f"page int, edge_id long, a {XY}, b {XY}")
    wheels = spark.createDataFrame([(1, 1, "w1", (45.0, 0.0)), (1, 1, "w2", (200.0, 0.0)), (1, 2, "w3", (50.0, 0.0))], f"page int, edge_id long, handwheel_id string, tip {XY}")
    got = {(r.glyph_id, r.role): (r.handwheel_id, r.x, r.y) for r in leaders.glyph_spans(glyphs, edges, wheels).collect()}
    assert got == {("on", "A"): ("w1", 40.0, 0.0), ("on", "B"): ("w1", 60.0, 0.0), ("end", "A"): ("w1", 85.0, 0.0), ("end", "B"): ("w1", 100.0, 0.0), ("gap", "A"): ("w1", 110.0, 0.0), ("gap", "B"): ("w1", 130.0, 0.0)}
    assert all(r.handwheel_id == r.glyph_id for r in leaders.glyph_spans(glyphs, edges, wheels.limit(0)).collect())


def test_adjusted_ends(spark):
    edges = spark.createDataFrame([(1, 1, (0.0, 0.0), (100.0, 0.0))], f"page int, edge_id long, a {XY}, b {XY}")
    vertices = spark.createDataFrame([(1, 1, (0.0, 0.0)), (1, 2, (101.0, 0.0)), (1, 3, (20.0, 4.0))], f"page int, vertex_id long, p {XY}")
    extensions = spark.createDataFrame([(1, 5, (20.0, 30.0), (20.0, 2.0))], f"page int, extension_id long, a {XY}, b {XY}")
    got = contour.adjusted_ends(vertices, extensions, edges).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 5, 20.0, 0.0, 20.0)]  # the second is over 80 away, the third stands right
    along = spark.createDataFrame([(1, 6, (30.0, 2.0), (60.0, 2.0))], f"page int, extension_id long, a {XY}, b {XY}")
    assert [tuple(r) for r in contour.adjusted_ends(vertices.filter("vertex_id = 1"), along, edges).collect()] == [(1, 1, 1, 6, 30.0, 0.0, 30.0)]


def test_names_by_their_starts(spark):
    lines = spark.createDataFrame([("LC-1",), ("LC-1_2",), ("LC-17",), ("B",), ("ZZ",)], "line_id string")
    groups = spark.createDataFrame([("LC-1",), ("BUILDING",), ("",)], "group_id string")
    got = {(r.line_id, r.group_id, r.level, r.status) for r in evaluate.groups_of_lines(lines, groups).collect()}
    assert got == {("LC-1", "LC-1", 1, "evaluated"), ("LC-1_2", "LC-1", 1, "evaluated"), ("LC-17", "LC-1", 2, "evaluated"), ("B", "BUILDING", 2, "evaluated"), ("ZZ", None, None, "not_configured")}


def test_pages_without_parts(spark):
    vertex, edge = "array<struct<id: string, role: string, x: double, y: double, confidence: double>>", "array<struct<id: string, from_vertex: string, to_vertex: string, status: string, pixel_length: double>>"
    dims = "array<struct<id: string, value_mm: double, selected_edge_id: string, status: string, decision: string, reason: string, conflict_with: string>>"
    pages = spark.createDataFrame([(1, "S", None, None, [(None, 5.0, None, None, "include", None, None), ("D1", 7.0, None, "mapped", None, None, None)], "gone")], f"page int, pdf string, vertices {vertex}, edges {edge}, dimensions {dims}, final_contour string")
    text = assembly.map_text(pages).first().map_text.split("\n")
    assert text[:5] == ["PDF: S", "PAGE: 1", "VERTICES:", "EDGES:", "DIMENSIONS:"] and text[5].startswith("None value_mm=5.0") and text[-1] == ""
    snapshot = assembly.local_snapshot(pages)
    assert "final_contour" not in snapshot.columns and [d.candidate_id for d in snapshot.first().local_decisions] == ["D1"] and snapshot.first().base_edges == []
    assert '"vertices":[]' in assembly.review_payload(pages).first().payload
