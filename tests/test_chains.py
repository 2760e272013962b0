"""Leads of coordinate blocks and of numbers against plain loops over all segments, and the cases that they are for."""

import math
import random

from drawgraph.operators import chains

SEGMENTS, BLOCKS, LABELS, VERTICES = "page int, seg_id long, x0 double, y0 double, x1 double, y1 double", "page int, block_id long, x double, y double", "page int, label_id long, x double, y double", "page int, vertex string, x double, y double"


def dist(p, q):
    return math.hypot(p[0] - q[0], p[1] - q[1])


def arrowhead(tip, main, segments):
    legs = []
    for a, b in segments:
        if (a, b) == main or (b, a) == main or min(dist(a, tip), dist(b, tip)) > 3:
            continue
        outer = b if dist(a, tip) <= dist(b, tip) else a
        if 3 <= dist(outer, tip) <= min(24, max(8, 0.3 * dist(*main))):
            legs.append(outer)
    cosines = [((u[0] - tip[0]) * (v[0] - tip[0]) + (u[1] - tip[1]) * (v[1] - tip[1])) / (dist(u, tip) * dist(v, tip)) for i, u in enumerate(legs) for v in legs[:i]]
    return any(-0.6 <= c <= 0.95 for c in cosines)


def plain_chains(centre, path, used, segments, out):
    """Depth first, outermost way first; 80 chains at most."""
    if len(out) >= 80:
        return
    tip = path[-1][1]
    arrow = arrowhead(tip, path[-1], segments)
    out.append((list(path), arrow, list(used)))
    if arrow or len(path) >= 14:
        return
    ways = []
    for i, (a, b) in enumerate(segments):
        if i not in used and min(dist(a, tip), dist(b, tip)) <= 3.5:
            near, far = (b, a) if dist(b, tip) < dist(a, tip) else (a, b)
            ways.append((dist(far, centre), i, near, far))
    for _, i, near, far in sorted(ways, reverse=True)[:5]:
        plain_chains(centre, [*path, (near, far)], [*used, i], segments, out)


def plain_lead(centre, segments, vertices):
    starts = []
    for i, (a, b) in enumerate(segments):
        if min(dist(a, centre), dist(b, centre)) <= 95:
            starts.append((min(dist(a, centre), dist(b, centre)), i, *((b, a) if dist(b, centre) < dist(a, centre) else (a, b))))
    for _, i, near, far in sorted(starts, key=lambda s: s[0]):
        found = []
        plain_chains(centre, [(near, far)], [i], segments, found)
        for path, arrow, used in sorted(found, key=lambda c: (c[1], len(c[0])), reverse=True):
            hit = min(((dist((x, y), path[-1][1]), name) for name, x, y in vertices), default=(99,))
            if arrow and hit[0] <= 22:
                return hit[1], used
    return None, None


def plain_number(label, segments):
    def target(tip, used):
        near = []
        for i, (a, b) in enumerate(segments):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = max(0.0, min(1.0, ((tip[0] - a[0]) * dx + (tip[1] - a[1]) * dy) / (dx * dx + dy * dy)))
            gap = dist(tip, (a[0] + t * dx, a[1] + t * dy))
            if i not in used and dist(a, b) >= 28 and gap <= 4:
                near.append((gap, i, t))
        return min(near) if near and 0.08 <= min(near)[2] <= 0.92 else None

    def straight(path, near, far):
        here, before = near, None
        if dist(near, far) <= 0.01:
            return False
        whole = ((far[0] - near[0]) / dist(near, far), (far[1] - near[1]) / dist(near, far))
        for a, b in path:
            there = b if dist(here, a) <= dist(here, b) else a
            if dist(here, there) <= 0.01:
                return False
            u = ((there[0] - here[0]) / dist(here, there), (there[1] - here[1]) / dist(here, there))
            if u[0] * whole[0] + u[1] * whole[1] < 0.72 or (before and u[0] * before[0] + u[1] * before[1] < 0.72):
                return False
            here, before = there, u
        return dist(here, far) <= 5

    found = []
    for k, (a, b) in enumerate(segments):
        gap = min(dist(a, label), dist(b, label))
        if not 2 <= gap <= 28:
            continue
        near, far = (a, b) if dist(a, label) <= dist(b, label) else (b, a)
        if arrowhead(far, segments[k], segments) and (t := target(far, {k})):
            found.append((gap + t[0] - 6, len(found), [k], t[1], near))
            continue
        queue = [(far, [k])]
        while queue:
            tip, path = queue.pop(0)
            if arrowhead(tip, segments[path[-1]], segments):
                if not straight([segments[i] for i in path], near, tip):
                    continue
                if t := target(tip, set(path)):
                    size = sum(dist(*segments[i]) for i in path)
                    if dist(near, tip) <= 0.01 or size / dist(near, tip) > 1.18:
                        continue
                    found.append((gap + t[0] + 4 * len(path) + 0.03 * size, len(found), path, t[1], near))
                    break
            if len(path) < 4:
                for i, (c, d) in enumerate(segments):
                    if i not in path and min(dist(c, tip), dist(d, tip)) <= 5:
                        queue.append((d if dist(c, tip) <= 5 else c, [*path, i]))
    if not found:
        return None
    score, _, path, hit, near = min(found)
    nearest = min((min(dist(a, label), dist(b, label)) for a, b in segments if 8 <= dist(a, b) <= 120), default=99)
    return None if nearest <= 12 and dist(near, label) - nearest > 12 else (round(score, 9), path, hit)


def drawing(rnd):
    """Lines in sectors with and without arrowheads, some across each other, and short strokes about."""
    out = []
    for _ in range(7):
        x, y, way = rnd.uniform(20, 280), rnd.uniform(20, 280), rnd.choice((0, 1, 2, 3, 4, 5, 6, 7)) * math.pi / 4
        for _ in range(rnd.choice((1, 1, 2, 3))):
            size = rnd.choice((20, 34, 50))
            way += rnd.choice((0, 0, 0.2, -0.3, 1.2))
            end = (x + size * math.cos(way), y + size * math.sin(way))
            out.append(((x, y), end) if rnd.random() < 0.5 else (end, (x, y)))
            x, y = end[0] + rnd.choice((0, 2)), end[1]
        if rnd.random() < 0.7:
            tip = out[-1][1] if dist(out[-1][1], (x, y)) < 3 else out[-1][0]
            for side in (0.4, -0.4):
                out.append((tip, (tip[0] - 6 * math.cos(way + side), tip[1] - 6 * math.sin(way + side))))
            if rnd.random() < 0.7:  # a long line through the tip
                at = rnd.choice((0.5, 0.3, 0.03))
                across = way + math.pi / 2
                out.append(((tip[0] - 60 * at * math.cos(across), tip[1] - 60 * at * math.sin(across)), (tip[0] + 60 * (1 - at) * math.cos(across), tip[1] + 60 * (1 - at) * math.sin(across))))
    return out


def pages(spark, seed, n):
    rnd = random.Random(seed)
    segments, points, vertices, plain = [], [], [], {}
    for page in range(n):
        own = drawing(rnd)
        segments += [(page, page * 1000 + i, *a, *b) for i, (a, b) in enumerate(own)]
        spots = [rnd.choice(rnd.choice(own)) for _ in range(5)]
        marks = [(page, page * 10 + k, x + rnd.choice((3, 10, -15)), y + rnd.choice((0, 8))) for k, (x, y) in enumerate(spots)]
        points += marks
        near = [(f"v{k}", x + rnd.choice((0, 9)), y) for k, (x, y) in enumerate(rnd.choice(s) for s in rnd.sample(own, 4))]
        vertices += [(page, *v) for v in near]
        plain[page] = (own, marks, near)
    return segments, points, vertices, plain


def test_coordinate_leads(spark):
    segments, points, vertices, plain = pages(spark, 3, 40)
    got = {(r.page, r.block_id): (r.vertex, r.path) for r in chains.coordinate_leads(spark.createDataFrame(points, BLOCKS), spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(vertices, VERTICES)).collect()}
    want = {}
    for page, (own, marks, near) in plain.items():
        for _, block, x, y in marks:
            vertex, used = plain_lead((x, y), own, near)
            want[page, block] = (vertex, used and [page * 1000 + i for i in used])
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[1] and len(v[1]) > 1 for v in want.values())


def test_number_leads(spark):
    segments, points, _, plain = pages(spark, 8, 60)
    got = {(r.page, r.label_id): (round(r.score, 6), r.path, r.target) for r in chains.number_leads(spark.createDataFrame(points, LABELS), spark.createDataFrame(segments, SEGMENTS)).collect()}
    want = {}
    for page, (own, marks, _) in plain.items():
        for _, label, x, y in marks:
            if found := plain_number((x, y), own):
                want[page, label] = (round(found[0], 6), [page * 1000 + i for i in found[1]], page * 1000 + found[2])
    assert got == want and len(want) > 15 and any(len(v[1]) > 1 for v in want.values())


def test_lead_needs_an_arrowhead_at_a_vertex(spark):
    """A chain of two sectors with an arrowhead leads to its vertex; without one, or with its tip too far off, it doesn't; without segments nothing does."""
    line = [(1, 1, 10.0, 0.0, 60.0, 0.0), (1, 2, 60.0, 0.0, 110.0, 20.0)]
    legs = [(1, 3, 110.0, 20.0, 104.0, 14.0), (1, 4, 110.0, 20.0, 103.0, 22.0)]
    blocks = spark.createDataFrame([(1, 7, 0.0, 0.0), (2, 8, 0.0, 0.0)], BLOCKS)
    lead = lambda segments, x: {r.block_id: (r.vertex, r.path) for r in chains.coordinate_leads(blocks, spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame([(1, "v", x, 20.0)], VERTICES)).collect()}
    assert lead(line + legs, 125.0) == {7: ("v", [1, 2]), 8: (None, None)}
    assert lead(line, 125.0) == lead(line + legs, 140.0) == {7: (None, None), 8: (None, None)}
    assert chains.number_leads(spark.createDataFrame([], LABELS), spark.createDataFrame(line, SEGMENTS)).collect() == []
