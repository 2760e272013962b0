"""R04 against plain loops over all pairs of a page."""

import math
import random

from drawgraph.operators import rules

XY = "struct<x: double, y: double>"


def dist(p, q):
    return math.hypot(p[0] - q[0], p[1] - q[1])


def plain(dims, edges):
    def span(s, o, u):
        v = [(p[0] - o[0]) * u[0] + (p[1] - o[1]) * u[1] for p in s]
        return min(v), max(v)

    def unit(a, b):
        return ((b[0] - a[0]) / dist(a, b), (b[1] - a[1]) / dist(a, b))

    def gap(p, a, b):
        t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / dist(a, b) ** 2))
        return dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

    def cosine(p, q):
        u, v = unit(p["a"], p["b"]), unit(q["a"], q["b"])
        return abs(u[0] * v[0] + u[1] * v[1])

    def contour(p, q):
        e, f = edges.get(p["edge"]), edges.get(q["edge"])
        if e is None or f is None or (p["edge"] != q["edge"] and e[1] != f[0] and f[1] != e[0]) or set(p["strokes"]) & set(q["strokes"]) or cosine(p, q) < 0.97:
            return False
        u = unit(p["a"], p["b"])
        x, y = span((p["a"], p["b"]), (0, 0), u), span((q["a"], q["b"]), (0, 0), u)
        shared, shorter = min(x[1], y[1]) - max(x[0], y[0]), min(dist(p["a"], p["b"]), dist(q["a"], q["b"]))
        if shared <= 2 or shared < max(10, 0.25 * shorter):
            return False
        if p["offset"] is not None and q["offset"] is not None:
            apart = abs(p["offset"] - q["offset"])
            if apart <= 22 or (abs(sum(x) / 2 - sum(y) / 2) <= 0.15 * shorter and apart <= 32):
                return False
        return True

    def contains(o, i):
        u = unit(o["a"], o["b"])
        x, y = span((o["a"], o["b"]), o["a"], u), span((i["a"], i["b"]), o["a"], u)
        size = y[1] - y[0]
        return size > 0 and max(0, min(x[1], y[1]) - max(x[0], y[0])) >= 0.82 * size and max(x[0] - y[0], y[1] - x[1], 0) <= max(8, 0.08 * max(1, x[1] - x[0]))

    out = {}
    for k, p in enumerate(dims):
        for q in dims[k + 1 :]:
            if p["value"] == q["value"]:
                continue
            s, l = (p, q) if p["value"] < q["value"] else (q, p)
            callout, edge = s["kind"] == "leader_to_dimension_arrow", s["edge"] is not None and s["edge"] == l["edge"]
            shared = bool(set(s["lines"]) & set(l["lines"]) or set(s["pipes"]) & set(l["pipes"]))
            beside = dist(l["a"], l["b"]) >= 1.08 * dist(s["a"], s["b"]) and cosine(l, s) >= 0.965 and contains(l, s) and 6 <= (gap(s["a"], l["a"], l["b"]) + gap(s["b"], l["a"], l["b"])) / 2 <= 38
            section = not callout and (edge or contour(p, q)) and contains(l, s)
            parallel = not callout and (edge or contour(p, q) or shared or (s["value"] >= 500 and s["value"] / max(l["value"], 1) >= 0.18)) and beside
            end = edge and callout and s["value"] < 250 and dist(s["a"], s["b"]) <= 24 and (s["leader"] or 0) >= 55 and s["at"] is not None and (s["at"] <= 0.12 or s["at"] >= 0.88)
            reference = callout and s["value"] >= 500 and shared
            if section or parallel or end or reference:
                out[s["id"]] = (rules.COVERED_BY["end" if end else "reference" if reference else "section"], l["id"], out.get(s["id"], (0, 0, 0))[2] + 1)
    return out


def test_nested_exclusions(spark):
    rnd = random.Random(17)
    rows, edges, want = [], [], {}
    for page in range(40):
        own = {page * 10 + e: (f"n{e}", f"n{rnd.choice((e + 1, e + 2))}") for e in range(4)}
        edges += [(page, e, *nodes) for e, nodes in own.items()]
        dims = []
        for k in range(14):
            x, y, size = rnd.choice((0, 20, 50, 100)), rnd.choice((0, 10, 25, 40, 90)), rnd.choice((15, 22, 60, 100, 180))
            dx, dy = rnd.choice(((1, 0), (1, 0), (1, 0.1), (0, 1), (1, 0.3), (-1, 0)))
            dims.append({"id": page * 100 + k, "value": float(rnd.choice((100, 200, 400, 550, 900, 2000))), "a": (float(x), float(y)), "b": (float(x + size * dx), float(y + size * dy)), "edge": rnd.choice([*own, None, -1]), "offset": rnd.choice((None, 0.0, 25.0, 30.0, 60.0)), "strokes": [rnd.randrange(20)], "lines": rnd.sample(range(30), 2), "pipes": rnd.sample(range(30), 1), "kind": rnd.choice((None, None, "leader_to_dimension_arrow")), "leader": rnd.choice((None, 40.0, 60.0)), "at": rnd.choice((None, 0.05, 0.5, 0.95))})
        rows += [(page, d["id"], d["value"], d["a"], d["b"], d["edge"], d["offset"], d["strokes"], d["lines"], d["pipes"], d["kind"], d["leader"], d["at"]) for d in dims]
        want |= plain(dims, own)
    frame = spark.createDataFrame(rows, f"page int, id long, value double, a {XY}, b {XY}, edge_id long, offset double, strokes array<long>, lines array<long>, pipes array<long>, attachment string, leader_size double, target_at double")
    got = {r.id: (r.reason, r.conflict_with, r.pairs) for r in rules.nested_exclusions(frame, spark.createDataFrame(edges, "page int, edge_id long, from_node string, to_node string")).collect()}
    assert got == want and {v[0] for v in want.values()} == set(rules.COVERED_BY.values()) and len(want) > 90
