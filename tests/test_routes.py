"""Reconciled segments on small cases: order of numbers, routes, lengths, points that exist."""

from drawgraph.operators import routes

CAND = "line_id long, candidate_id string, page int, text string, kind string, value double, box string"
SEG = "line_id long, segment_id string, label string, length double, route string"
PART = "line_id long, candidate_id string, route string, pos int"


def run(spark, seg, cand, parts, points=()):
    out = routes.reconciled(spark.createDataFrame(seg, SEG), spark.createDataFrame(cand, CAND), spark.createDataFrame(parts, PART), spark.createDataFrame([(p,) for p in points], "point_id string"))
    return [[tuple(r) for r in d.collect()] for d in out]


def cand(n, kind="dimension", value=100.0, line=1):
    return (line, f"C-001-{n:04d}", 1, f"t{n}", kind, value + n, None)


def test_numbers_skip_what_is_held(spark):
    seg = [(1, f"R-1-MAIN{i}", None, 1.0, "main") for i in ("01", "02", "04", "007", "5")] + [(2, "R-2-MAIN00", None, 1.0, "main")]
    parts = [(1, f"C-001-{n:04d}", "main", n) for n in range(1, 5)] + [(1, "C-001-0005", "branch", 0), (1, "C-001-0001", "branch", 9)]
    whole, points, notes = run(spark, seg, [cand(n) for n in range(1, 6)], parts, ["R-1-MAIN00-P02"])
    made = {r[2].split()[0][-1]: (r[1], r[4], r[3]) for r in whole if r[-1] == "created"}
    assert made == {"1": ("R-1-BRANCH01", "branch", 101.0), "2": ("R-1-MAIN00", "main", 102.0), "3": ("R-1-MAIN03", "main", 103.0), "4": ("R-1-MAIN05", "main", 104.0), "5": ("R-1-BRANCH02", "branch", 105.0)}
    assert len(points) == 9 and ("R-1-MAIN00-P01", "route start") in {(p[0], p[3]) for p in points} | {(p[2], p[3]) for p in points}
    assert {(n[1], n[3]) for n in notes} >= {("A-R-1-MAIN00", "R-1-MAIN00 t2"), ("A-R-1-BRANCH01", "R-1-BRANCH01 t1")}


def test_named_segments_take_route_and_length(spark):
    seg = [(1, "a", "C-001-0001 and C-001-0002", None, "unknown"), (1, "b", "C-001-0003", 7.0, "main"), (1, "c", "C-001-0003 C-001-0004", 7.0, "main"), (1, "d", "C-001-0009", None, "main"), (1, "e", None, None, None)]
    cands = [cand(1), cand(2), cand(3, "coordinate_delta"), cand(4), cand(9, line=2)]
    whole, points, notes = run(spark, seg, cands, [(1, "C-001-0002", "main", 5), (1, "C-001-0001", "branch", 1), (1, "C-001-0009", "main", 0)])
    assert {r[1]: (r[4], r[3]) for r in whole} == {"a": ("branch", 102.0), "b": ("unknown", 7.0), "c": ("main", 7.0), "d": ("main", None), "e": (None, None)}
    assert points == [] and notes == []


def test_empty_tables(spark):
    assert run(spark, [], [], []) == [[], [], []]


def test_handwheels(spark):
    xy = "struct<x: double, y: double>"
    wheels = spark.createDataFrame([(1, 10, 1, (0.0, 45.0)), (1, 11, 2, (0.0, 45.5)), (1, 12, 3, None), (2, 13, 1, (0.0, 0.0))], f"page int, id int, pos int, tip {xy}")
    edges = spark.createDataFrame([(1, 7, (-5.0, 0.0), (5.0, 0.0)), (1, 6, (0.0, 0.0), (9.0, 0.0))], f"page int, edge_id int, a {xy}, b {xy}")
    got = {r.id: (r.edge_id, r.distance, r.edge_created, r.edge_kind) for r in routes.handwheel_edges(wheels, edges).collect()}
    assert got == {10: ("6", 45.0, False, "pipe_edge"), 11: ("HW_EDGE_002", None, True, "handwheel_attachment"), 12: (None, None, None, None), 13: ("HW_EDGE_001", None, True, "handwheel_attachment")}
