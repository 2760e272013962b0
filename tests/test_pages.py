"""Pairs within pages against plain loops, and that they are no rows of a table."""

import random

import pytest
from pyspark.sql import functions as F

from drawgraph.functions import geometry as g
from drawgraph.operators import contour, graph, leaders, pages, routes, spatial

POINT = "struct<x: double, y: double>"
SEGMENTS = f"page int, id long, a {POINT}, b {POINT}"


def segments(rows, seed, pages_=5, n=30):
    r = random.Random(seed)
    place = lambda: (float(r.randrange(0, 40)), float(r.randrange(0, 40)))
    return [(p, p * 1000 + i, place(), place()) for p in range(pages_) for i in range(r.randrange(0, n))] + rows


def d2(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    long = dx * dx + dy * dy
    t = 0.0 if long <= 1e-9 else min(1.0, max(0.0, (dx * (p[0] - a[0]) + dy * (p[1] - a[1])) / long))
    x, y = p[0] - (a[0] + t * dx), p[1] - (a[1] + t * dy)
    return x * x + y * y


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def drawn(spark):
    return lambda rows, schema=SEGMENTS: spark.createDataFrame(rows, schema)


def test_reserved_strokes_make_no_row_for_a_pair(drawn):
    s, p = segments([(9, 9001, (1.0, 1.0), (1.0, 1.0))], 1), segments([], 2)
    strokes, pipes = drawn(s), drawn(p).select("page", F.col("a").alias("c"), F.col("b").alias("d"))
    for most in (2.5, 3.0, 6.0):
        want = {i for page, i, a, b in s if any(q == page and max(d2(a, c, d), d2(b, c, d)) <= most * most for q, _, c, d in p)}
        assert {r.id for r in spatial.reserved(strokes, pipes, most).collect()} == want
        assert {r.id for r in spatial.on_pipes(strokes, pipes, most).collect()} == {i for _, i, _, _ in s} - want
    assert "Join" not in plan(spatial.reserved(strokes, pipes)) + plan(spatial.on_pipes(strokes, pipes))


def test_crossing_legs_make_no_row_for_a_pair(drawn):
    s = segments([(7, 7001, (0.0, 0.0), (20.0, 20.0)), (7, 7002, (0.0, 20.0), (20.0, 0.0)), (7, 7003, (10.0, 0.0), (10.0, 20.0))], 3)
    found = spatial.crossing_legs(drawn(s))
    want = {}
    size = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
    for p, i, a, b in s:
        for q, j, c, d in s:
            det = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            one, two = size(a, b), size(c, d)
            if p == q and i < j and abs(det) > 1e-9 and 8 <= min(one, two) and max(one, two) <= min(90, 2 * min(one, two)):
                at, back = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / det, ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / det
                if 0.28 <= at <= 0.72 and 0.28 <= back <= 0.72:
                    want[i, j] = (a[0] + at * (b[0] - a[0]), a[1] + at * (b[1] - a[1]))
    assert {(r.first_id, r.second_id): (r.x, r.y) for r in found.collect()} == want and (7001, 7002) in want
    assert "Join" not in plan(found)


def test_nearest_and_within(drawn, monkeypatch):
    s, p = segments([(8, 8001, (3.0, 3.0), (3.0, 3.0))] * 2, 4), segments([], 5)
    points, sides = drawn(s).select("page", "id", F.col("a").alias("p")), drawn(p).select("page", F.struct("id").alias("key"), "a", "b")
    want = {i: min(((d2(a, c, d), k) for q, k, c, d in p if q == page), default=(None, None)) for page, i, a, _ in s}
    near = spatial.nearest(points, sides, "p", "key")
    got = [(r.id, (r.d2, r.near_id and r.near_id.id)) for r in near.collect()]
    assert len(got) == len(want) and dict(got) == want and None in dict(want.values())  # equal rows are one, those of a page without segments stay
    for most in (3.0, 9.0):
        both = sorted((i, k, d2(a, c, d)) for page, i, a, _ in s for q, k, c, d in p if q == page and d2(a, c, d) <= most * most)
        found = spatial.gridded_within(points, sides, "p", "key", most)
        assert sorted((r.id, r.near_id.id, r.d2) for r in found.collect()) == both
        assert "Join" not in plan(found) + plan(near)


def test_a_crowded_page_is_swept(monkeypatch):
    import numpy as np

    monkeypatch.setattr(pages, "BLOCK", 50)
    r = np.random.default_rng(1)
    x, a, b = r.integers(0, 60, 40).astype(float), r.integers(0, 60, 40).astype(float), r.integers(0, 60, 40).astype(float)
    got = [(int(i), int(j)) for rows, right in pages._swept(3, 20, 40, x, a, b, 4.0) for i, j in zip(rows, right, strict=True)]
    assert sorted(got) == [(i, j) for i in range(3, 20) for j in range(20, 40) if min(a[j], b[j]) - 4 <= x[i] <= max(a[j], b[j]) + 4]
    rows = list(pages._blocks(np.arange(5), np.array([0, 10, 20, 30, 40]), np.array([30, 30, 0, 200, 10])))
    assert [len(j) for *_, j in rows] == [30, 30, 200, 10] and all(c.sum() == len(j) for _, c, j in rows)


def test_pages_are_whole():
    import pyarrow as pa

    page = [1, 1, 2, 3, 3, 3, 3, 4]
    for n in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_pydict({"page": page[k : k + n]}) for k in range(0, len(page), n)]
        parts = [b.column(0).to_pylist() for b in pages._whole(iter(batches))]
        assert sum(parts, []) == page and all(len([p for p in parts if k in p]) == 1 for k in set(page))


def test_squared_is_that_of_the_column(drawn):
    import numpy as np

    s = segments([(8, 1, (0.1, 0.2), (0.1, 0.2))], 6)
    rows = drawn(s).select("a", "b", g.squared_to_segment(g.point(F.lit(0.3), F.lit(7.7)), F.col("a"), F.col("b")).alias("d")).collect()
    cols = [np.array([getattr(r, c)[k] for r in rows]) for c in "ab" for k in (0, 1)]
    assert pages.squared(np.full(len(rows), 0.3), np.full(len(rows), 7.7), *cols).tolist() == [r.d for r in rows]


EDGES = "page int, stroke_id long, from_x double, from_y double, to_x double, to_y double"


def edges(seed):
    return [(p, i, *a, *b) for p, i, a, b in segments([], seed, 8, 25) if a != b]


def test_shortest_ways_take_no_frame_for_a_page(drawn):
    rows = edges(7)
    found = graph.shortest_paths(drawn(rows, EDGES))
    want = {}
    for page in {r[0] for r in rows}:
        mine = [((x, y), (v, w)) for p, _, x, y, v, w in rows if p == page]
        best = {}
        for start in sorted({n for e in mine for n in e}):
            if start not in best:
                best[start] = (0.0, 0)
                for _ in mine:
                    for a, b in mine + [e[::-1] for e in mine]:
                        if a in best:
                            best[b] = min(best.get(b, (1e9, 0)), (best[a][0] + ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5, best[a][1] + 1))
        want |= {(page, *n): (round(far, 9), hops) for n, (far, hops) in best.items()}
    assert {(r.page, r.x, r.y): (round(r.distance, 9), r.hops) for r in found.collect()} == want
    assert "InPandas" not in plan(found)


def test_longest_walks_take_no_frame_for_a_page(drawn):
    rows = edges(8)
    found = graph.longest_walks(drawn(rows, EDGES))
    want = []
    for page in {r[0] for r in rows}:
        next_ = {}
        for p, _, x, y, v, w in rows:
            if p == page:
                next_.setdefault((x, y), set()).add((v, w))
                next_.setdefault((v, w), set()).add((x, y))

        def sweep(start):
            far, k = {start: 0}, 0
            while new := {m for n, h in far.items() if h == k for m in next_[n]} - far.keys():  # noqa: B023
                k += 1
                far |= dict.fromkeys(new, k)
            return far

        seen = set()
        for start in sorted(next_):
            if start not in seen:
                far = sweep(start)
                seen |= far.keys()
                one = min(far, key=lambda n: (-far[n], n))
                far = sweep(one)
                two = min(far, key=lambda n: (-far[n], n))
                want.append((page, far[two], *one, *two))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "InPandas" not in plan(found)


def test_merged_vertices_take_no_frame_for_a_page(drawn):
    rows = [(p, i, *a, float(i % 7)) for p, i, a, _ in segments([], 9)]
    found = contour.merged_hits(drawn(rows, "page int, hit_id long, x double, y double, gap double"))
    want = []
    for page in {r[0] for r in rows}:
        made = []
        for _, _, x, y, gap in (r for r in rows if r[0] == page):
            near = next((v for v in made if (v[0] - x) ** 2 + (v[1] - y) ** 2 <= 81), None)
            if near is None:
                made.append([x, y, gap, 1])
            else:
                near[:] = [x, y, gap, near[3] + 1] if gap < near[2] else [*near[:3], near[3] + 1]
        want += [(page, f"VE-{k:02d}", x, y, n) for k, (x, y, _, n) in enumerate(made, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "InPandas" not in plan(found)


def test_leader_targets_make_no_row_for_a_pair(drawn):
    s = segments([], 10)
    strokes = drawn(s)
    lead = strokes.select("page", F.col("id").alias("leader_id"), F.col("a").alias("s"), F.col("b").alias("e"), F.lit(None).cast(POINT).alias("edge_a"), F.lit(None).cast(POINT).alias("edge_b"))
    found = leaders.leader_targets(lead, strokes.select("page", F.col("id").alias("stroke_id"), "a", "b"))
    got = {r.leader_id: r.stroke_id for r in found.collect()}
    assert got and all(i != j and i // 1000 == j // 1000 for i, j in got.items())
    assert "Join" not in plan(found)


def test_touching_edges_make_no_row_for_a_cell(drawn):
    rows = segments([], 11)
    found = spatial.touching(drawn(rows).withColumnRenamed("id", "edge_id"), 4.0)
    far = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
    want = {(p, i, j) for p, i, a, b in rows for q, j, c, d in rows if p == q and i < j and min(far(m, n) for m in (a, b) for n in (c, d)) <= 4}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Join" not in plan(found) and "Generate" not in plan(found)


@pytest.mark.parametrize("name", ["extension_vertices", "glyph_spans", "final_vertices"])
def test_strokes_are_worked_out_once(spark, sf_dir, monkeypatch, name):
    from drawgraph import plans
    from drawgraph.sources import tables

    made, calls = tables.strokes, []
    monkeypatch.setattr(tables, "strokes", lambda *a: calls.append(a) or made(*a))
    plans.QUERIES[name](spark, sf_dir)
    assert len(calls) == 1


def test_handwheel_edges_are_found_without_cells(drawn):
    sides = drawn(segments([], 12)).withColumnRenamed("id", "edge_id")
    wheels = drawn(segments([], 13)).select("page", "id", (F.col("id") % 1000).cast("int").alias("pos"), F.col("a").alias("tip"))
    assert "cx_" not in plan(routes.handwheel_edges(wheels, sides))


def test_ends_are_adjusted_without_cells(drawn):
    sides = drawn(segments([], 14)).withColumnRenamed("id", "edge_id")
    ends = sides.select("page", F.col("edge_id").alias("vertex_id"), F.col("a").alias("p"))
    lines = drawn(segments([], 15)).withColumnRenamed("id", "extension_id")
    assert "cx_" not in plan(contour.adjusted_ends(ends, lines, sides))


def test_coordinate_leads_look_at_pipes_once(spark, sf_dir, monkeypatch):
    from drawgraph import plans
    from drawgraph.plans import interval_queries

    monkeypatch.setattr(spatial, "gaps", lambda strokes, pipes, made=spatial.gaps: calls.append(1) or made(strokes, pipes), raising=False)
    calls: list[int] = []
    monkeypatch.setattr(interval_queries, "written", lambda df, name: pytest.fail(f"{name} is written"))
    assert plans.QUERIES["coordinate_leads"](spark, sf_dir).columns[1] == "block_id" and calls == [1]
