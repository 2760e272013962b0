"""Worked cases of single operators, and order-dependent ones against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from drawgraph.functions import geometry as g
from drawgraph.functions import text as x
from drawgraph.operators import contour, evaluate, graph, leaders, lengths, rules, store
from drawgraph.sources import readers, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_primary_edges(spark):
    rows = [(1, 1, 100.0, "include", None, 1, 1, None), (1, 2, 50.0, "exclude", "valve_dimension", 1, 1, None), (1, 3, 25.0, "ambiguous", "cross_sheet_dimension", 2, 1, None), (1, 4, 200.0, "include", None, 3, 1, None), (1, 5, 40.0, "include", None, 1, 1, None)]
    df = spark.createDataFrame(rows, "page int, dim_id int, value_mm double, decision string, kind string, edge_id int, coverage int, route_type string")
    r = lengths.reviewed_lengths(df).first()
    assert (r.clean_mm, r.dirty_mm, r.ambiguous_mm, r.duplicates) == (300.0, 340.0, 0.0, 1)


def test_precedence(spark):
    cases = [("include", None, "exclude", False, True, "exclude"), ("include", None, "exclude", True, True, "include"), ("include", "disputed", None, False, False, "ambiguous"), ("exclude", "accepted", None, None, None, "exclude"), ("exclude", "insufficient", "include", False, False, "include"), ("include", None, None, False, True, "include")]
    df = spark.createDataFrame(cases, "local string, assessment string, proposed string, keep boolean, accept boolean, want string")
    d = lengths.effective_decision(F.col("local"), F.col("assessment"), F.col("proposed"), F.col("keep"), F.col("accept"))
    assert df.filter(d != F.col("want")).count() == 0


def test_cross_sheet_references(spark):
    got = [one(spark, x.cross_sheet_reference(F.lit(t)))[0] for t in ("СМ. CO-0031 ЛИСТ 2", "Лист 200X300X6", "ПОДКЛЮЧЕНИЕ V-505")]
    assert got == [2, None, None]
    kinds = [one(spark, x.connection_class(F.lit(t), strict=False).alias("k")).k for t in ("Врезка в линию", "см. лист 3", "СМ.", "пусто")]
    assert [(k.kind, k.sheet, k.hint) for k in kinds] == [("tie_in", None, False), ("continuation", "3", True), ("other", None, True), ("other", None, False)]


def test_text_rules(spark):
    kinds = {t: one(spark, x.candidate_kind(F.lit(t)))[0] for t in ("Х", "z+", "DN40x25", "LC-1031", "12345", "250", "7", "word")}
    assert kinds == {"Х": "coordinate_label", "z+": "coordinate_label", "DN40x25": "dn", "LC-1031": "line_ref", "12345": "coordinate_value", "250": "dimension", "7": None, "word": None}
    assert one(spark, x.line_ids(F.lit("LC-1031, LC_1031 RD_0001 (CO_0166)")))[0] == ["CO_0166", "LC_1031"]
    assert [one(spark, x.number(F.lit(t)))[0] for t in ("12,5", "0", "100001", "1.2.3")] == [12.5, None, None, None]
    assert [one(spark, x.marks_coordinate(F.lit(t)))[0] for t in ("DN40", "45°", "40mm", "40mmx", "мм", "xDN40")] == [True, True, True, False, True, False]
    assert [one(spark, x.page_key(F.lit(3), F.lit(k)))[0] for k in ("D1", "4:D1", "")] == ["3:D1", "4:D1", ""]
    assert one(spark, x.file_name(F.lit("__a/б c__")), x.file_name(F.lit("//")))[:] == ("a_б_c", "item")
    assert one(spark, x.answer_object(F.lit("```json\n{\"a\": 1}\n```")).isNotNull(), x.answer_object(F.lit("[1]")).isNull())[:] == (True, True)


def test_geometry(spark):
    p = lambda a, b: g.point(F.lit(float(a)), F.lit(float(b)))
    r = one(spark, g.to_segment(p(5, 3), p(0, 0), p(10, 0)).alias("n"), g.intersection(p(0, 0), p(10, 10), p(0, 10), p(10, 0)).alias("i"), g.intersection(p(0, 0), p(1, 0), p(0, 1), p(1, 1)).alias("none"), g.ray_hit(p(0, 5), p(1, 0), p(8, 0), p(8, 10), 100.0).alias("ray"), g.ray_near_miss(p(12, 40), p(1, 0), p(20, 48), p(20, 90), 100.0, 10.0).alias("miss"))
    assert (r.n.distance, r.n.at) == (3.0, 0.5) and (r.i.x, r.i.y) == (5.0, 5.0) and r.none is None and (r.ray.distance, r.ray.at) == (8.0, 0.5)
    assert (r.miss.side_gap, r.miss.x, r.miss.y) == (8.0, 20.0, 48.0)
    ax = one(spark, g.axis_of(F.lit(0.0), F.lit(90.0)).alias("a"), g.axis_of(F.lit(60.0), F.lit(-60.0)).alias("b"), g.axis_of(F.lit(-60.0), F.lit(-60.0)).alias("c"))
    assert (ax.a.axis, ax.a.sign) == ("Z", "+") and (ax.b.axis, ax.b.sign) == ("X", "+") and (ax.c.axis, ax.c.sign) == ("Y", "-")
    path = F.array(p(0, 0), p(3, 4), p(6, 8))
    assert one(spark, g.path_length(path), g.path_is_stable(path), g.path_is_stable(F.array(p(0, 0), p(5, 0), p(5, 5), p(0, 5))))[:] == (10.0, True, False)
    assert one(spark, g.is_parallel(p(0, 0), p(1, 0), p(0, 0), p(0, 1)), g.is_parallel(p(0, 0), p(1, 0), p(0, 0), p(0, 1), legacy=True))[:] == (False, True)


def test_snapped_nodes(spark):
    rnd = random.Random(1)
    rows = [(page, i, *(float(rnd.randint(0, 30)) for _ in range(4))) for page in (1, 2) for i in range(25)]
    got = {(r.page, r.stroke_id, r.end): r.node for r in graph.snapped_nodes(spark.createDataFrame(rows, "page int, stroke_id long, x0 double, y0 double, x1 double, y1 double")).collect()}
    for page in (1, 2):
        nodes = []
        for _, i, x0, y0, x1, y1 in (r for r in rows if r[0] == page):
            for end, (a, b) in enumerate(((x0, y0), (x1, y1))):
                far = [(math.hypot(n[0] - a, n[1] - b), k) for k, n in enumerate(nodes)]
                best = min(far, default=(9e9, -1))
                if best[0] >= 4:
                    nodes.append([a, b, 1])
                    k = len(nodes) - 1
                else:
                    k = best[1]
                    n = nodes[k]
                    n[2] += 1
                    n[0], n[1] = n[0] + (a - n[0]) / n[2], n[1] + (b - n[1]) / n[2]
                assert got[page, i, end] == k


def test_paths_and_clusters(spark):
    rows = [(1, 1, 0.0, 0.0, 3.0, 4.0), (1, 2, 3.0, 4.0, 3.0, 10.0), (1, 3, 0.0, 0.0, 0.0, 20.0), (1, 4, 0.0, 20.0, 3.0, 10.0)]
    edges = graph.end_nodes(spark.createDataFrame(rows, "page int, stroke_id long, x0 double, y0 double, x1 double, y1 double"))
    assert {(r.x, r.y): (r.distance, r.hops) for r in graph.shortest_paths(edges).collect()} == {(0.0, 0.0): (0.0, 0), (3.0, 4.0): (5.0, 1), (3.0, 10.0): (11.0, 2), (0.0, 20.0): (20.0, 1)}
    pts = spark.createDataFrame([(1, "corner", 0.0, 0.0), (1, "corner", 15.0, 0.0), (1, "corner", 30.0, 0.0), (1, "endpoint", 0.0, 0.0), (1, "endpoint", 9.0, 0.0), (1, "endpoint", 90.0, 0.0)], "page int, role string, x double, y double")
    assert sorted((r.role, r.n, r.x) for r in graph.clusters(pts).collect()) == [("corner", 3, 15.0), ("endpoint", 1, 90.0)]
    merged = graph.merged_strokes(spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 2, 14.0, 0.0, 30.0, 0.0), (1, 3, 35.0, 0.0, 50.0, 0.0), (1, 4, 50.0, 0.0, 50.0, 9.0)], "page int, stroke_id long, x0 double, y0 double, x1 double, y1 double"))
    assert {r.stroke_id: r.members for r in merged.collect()} == {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 3], 4: [4]}
    box = [(1, 1, 0.0, 0.0, 20.0, 0.0), (1, 2, 20.0, 0.0, 20.0, 10.0), (1, 3, 20.0, 10.0, 0.0, 10.0), (1, 4, 0.0, 10.0, 0.0, 0.0), (1, 5, 0.0, 0.0, 0.0, 30.0)]
    assert [tuple(r) for r in graph.rectangles(spark.createDataFrame(box, "page int, stroke_id long, x0 double, y0 double, x1 double, y1 double")).collect()] == [(1, 0.0, 0.0, 20.0, 10.0)]


def test_leader_polyline(spark):
    segs = [(1, 1, 10.0, 5.0, 40.0, 5.0), (1, 2, 40.0, 5.0, 40.0, 40.0), (1, 3, 40.0, 40.0, 37.0, 34.0), (1, 4, 40.0, 40.0, 43.0, 34.0)]
    r = leaders.leader_ends(spark.createDataFrame([(1, 7, 5.0, 5.0), (1, 8, 500.0, 5.0)], "page int, label_id long, x double, y double"), spark.createDataFrame(segs, "page int, seg_id long, x0 double, y0 double, x1 double, y1 double"))
    got = {x.label_id: x for x in r.collect()}
    assert got[7].found and (got[7].x, got[7].y) == (40.0, 40.0) and got[7].path == [1, 2] and not got[8].found


def test_merged_hits(spark):
    rows = [(1, 1, 0.0, 0.0, 5.0), (1, 2, 6.0, 0.0, 1.0), (1, 3, 14.0, 0.0, 3.0), (1, 4, 40.0, 0.0, -2.0)]
    got = contour.merged_hits(spark.createDataFrame(rows, "page int, hit_id int, x double, y double, gap double")).collect()
    assert [(r.vertex, r.x, r.n) for r in got] == [("VE-01", 6.0, 3), ("VE-02", 40.0, 1)]


def test_evaluation(spark):
    truth = spark.createDataFrame([("g", "216", "D001", "include"), ("g", "217", "D001", "exclude"), ("g", "217", "D002", None)], "group_id string, sheet string, candidate_id string, status string")
    answers = spark.createDataFrame([("S216", "D001", "exclude", 0), ("216", "D001", "include", 1), ("S217", "D001", "include", 0), ("217", "D999", "include", 0)], "sheet string, candidate_id string, status string, pos int")
    got = {(r.sheet, r.candidate_id): r.kind for r in evaluate.compared(truth, answers).collect()}
    assert got == {("216", "D001"): "match", ("217", "D001"): "mismatch", ("217", "D002"): "match", ("217", "D999"): "extra"}


def test_rules(spark):
    rows = [(1, 1, True, "main", 100.0, False, False), (1, 2, True, None, 12.0, True, True), (1, 3, True, None, 40.0, True, True), (1, 4, False, "main", 5.0, True, True), (1, 5, True, "branch", 500.0, False, False)]
    got = {r.id: r.final_route for r in rules.branch_routes(spark.createDataFrame(rows, "line_id int, id int, accepted boolean, route string, value double, isolated boolean, evidence boolean")).collect()}
    assert got == {1: "main", 2: "branch", 3: "main", 4: None, 5: "branch"}


def test_versions_and_sections(spark, tmp_path):
    lines = [json.dumps({"version": 0, "created_at": "2024", "text": "a"}), "", "broken {", "[1]", json.dumps({"created_at": "2025", "text": "b"}), json.dumps({"created_at": "2026", "text": "a"})]
    (tmp_path / "v.jsonl").write_text("\n".join(lines))
    log = readers.versions(spark, str(tmp_path / "v.jsonl"))
    assert [(r.version, r.text) for r in log.orderBy("version").collect()] == [(0, "a"), (1, "b"), (2, "a")]
    assert [r.version for r in readers.active_version(log, "a").filter("is_active").collect()] == [2]
    assert [r.version for r in readers.active_version(log, "a", 0).filter("is_active").collect()] == [0]
    assert readers.append_version(log, "a", "2027").count() == 3 and readers.append_version(log, "c", "2027").count() == 4
    (tmp_path / "n.txt").write_text("# One\na\tb\n\n# Two\nc\td\te\n")
    assert [(r.section, r.fields) for r in readers.sections(spark, str(tmp_path / "n.txt")).orderBy("row").collect()] == [("One", ["a", "b"]), ("Two", ["c", "d", "e"])]
    assert one(spark, readers.page_ranges(F.lit("7, 3-5,4")))[0] == [3, 4, 5, 7]
    with pytest.raises(Exception, match="page numbers"):
        one(spark, readers.page_ranges(F.lit("5-3")))


def test_exports_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], None), (2, ["b", "c"], "x")], "id int, tags array<string>, note string")
    sinks.export_tables({"one": df}, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/one").count() == 2
    sinks.export_json(df, f"{tmp_path}/json")
    assert "note" not in spark.read.text(f"{tmp_path}/json").filter("value like '%\"id\":1%'").first()[0]
    sinks.export_text(df, f"{tmp_path}/txt", "id", "note")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/txt").collect()) == ["1\t", "2\tx"]
    made = []
    for _ in range(2):
        assert readers.cached(spark, str(tmp_path / "cache"), ["v1", "file"], lambda: made.append(1) or df).count() == 2
    assert made == [1]


def test_latest_keeps_first_date(spark):
    log = spark.createDataFrame([("r", 1, "2024", "a"), ("r", 2, "2025", "b"), ("q", 1, "2023", "c")], "run string, seq int, created string, state string")
    assert sorted(tuple(r) for r in store.latest(log, ["run"], "seq", "created").collect()) == [("q", 1, "2023", "c"), ("r", 2, "2024", "b")]


def test_walks_tours_and_blocks(spark):
    rows = [(1, i, float(i), 0.0, float(i + 1), 0.0) for i in range(5)] + [(1, 9, 2.0, 0.0, 2.0, 1.0)]
    edges = graph.end_nodes(spark.createDataFrame(rows, "page int, stroke_id long, x0 double, y0 double, x1 double, y1 double"))
    r = graph.longest_walks(edges).first()
    assert r.hops == 5 and {(r.from_x, r.from_y), (r.to_x, r.to_y)} == {(0.0, 0.0), (5.0, 0.0)}
    pts = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 2, 0.0, 0.0), (1, 3, 9.0, 1.0), (1, 4, 1.0, 4.0)], "page int, id long, x double, y double")
    assert [r.id for r in graph.nearest_tour(pts).orderBy("place").collect()] == [2, 4, 1, 3]
    labels = [(1, 1, "x", 10.0, 0.0), (1, 2, "y", 11.0, 8.0), (1, 3, "z", 10.0, 16.0), (1, 4, "x", 10.0, 24.0), (1, 5, "x", 90.0, 0.0)]
    got = graph.coordinate_blocks(spark.createDataFrame(labels, "page int, id long, axis string, x double, y double")).collect()
    assert [(r.ids, r.axes) for r in got] == [([1, 2, 3], ["x", "y", "z"])]


def test_ways_of_every_component(spark):
    lines = [(0.0, 0.0, 3.0, 4.0), (100.0, 0.0, 101.0, 0.0), (101.0, 0.0, 102.0, 0.0), (102.0, 0.0, 103.0, 0.0)]
    edges = spark.createDataFrame([(1, i, *e) for i, e in enumerate(lines)], "page int, stroke_id long, from_x double, from_y double, to_x double, to_y double")
    assert sorted((r.x, r.distance, r.hops) for r in graph.shortest_paths(edges).collect()) == [(0.0, 0.0, 0), (3.0, 5.0, 1), (100.0, 0.0, 0), (101.0, 1.0, 1), (102.0, 2.0, 2), (103.0, 3.0, 3)]
    assert sorted((r.hops, *sorted((r.from_x, r.to_x))) for r in graph.longest_walks(edges).collect()) == [(1, 0.0, 3.0), (3, 100.0, 103.0)]
