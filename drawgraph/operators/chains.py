"""Chains of leader segments: from a coordinate block to a vertex, from a number to a dimension line.

Which chains are tried, and in which order, decides which one is found, so they are walked on one page at a time, over an index of
segment ends; a page's rows lie one after another in a partition. What a chain's tip meets is a join.
"""

from __future__ import annotations

from collections import defaultdict, deque
from math import floor, hypot

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import by_page
from .spatial import gridded_within

# Distances and limits that results depend on.
BLOCK_START, LEAD_JOIN, LEAD_SEGMENTS, LEAD_PATHS, LEAD_WAYS, VERTEX_HIT = 95.0, 3.5, 14, 80, 5, 22.0
ARROW_TIP, ARROW_LEAST, ARROW_MOST, ARROW_SHARE, ARROW_COSINES = 3.0, 3.0, (8.0, 24.0), 0.3, (-0.6, 0.95)
NUMBER_START, NUMBER_JOIN, NUMBER_SEGMENTS, STRETCH, STRAIGHT = (2.0, 28.0), 5.0, 4, 1.18, 0.72
TARGET_NEAR, TARGET_LENGTH, TARGET_PLACE = 4.0, 28.0, (0.08, 0.92)
ONE_SECTOR, EACH_SECTOR, EACH_LENGTH = -6.0, 4.0, 0.03
OTHER_STARTS, OTHER_LENGTHS = 12.0, (8.0, 120.0)
CELL = 32.0


def _away(p: tuple, q: tuple) -> float:
    return hypot(p[0] - q[0], p[1] - q[1])


class Drawn:
    """The segments of a page, found by their ends."""

    def __init__(self, segments: list[tuple[tuple, tuple]]):
        self.segments = segments
        self.cells: dict[tuple, list[int]] = defaultdict(list)
        for i, ends in enumerate(segments):
            for cell in {self._cell(p) for p in ends}:
                self.cells[cell].append(i)

    @staticmethod
    def _cell(p: tuple) -> tuple[int, int]:
        return floor(p[0] / CELL), floor(p[1] / CELL)

    def ending(self, p: tuple, most: float) -> list[tuple[float, int, tuple, tuple]]:
        """Segments with an end within most of p, by number: (gap, number, that end, the other)."""
        cx, cy = self._cell(p)
        r = int(most // CELL) + 1
        found = []
        for i in sorted({i for x in range(cx - r, cx + r + 1) for y in range(cy - r, cy + r + 1) for i in self.cells.get((x, y), ())}):
            a, b = self.segments[i]
            one, other = _away(a, p), _away(b, p)
            if min(one, other) <= most:
                found.append((one, i, a, b) if one <= other else (other, i, b, a))
        return found

    def has_arrowhead(self, tip: tuple, main: tuple[tuple, tuple]) -> bool:
        """Whether two legs that belong together by their angle stand at a segment's tip."""
        most = min(ARROW_MOST[1], max(ARROW_MOST[0], _away(*main) * ARROW_SHARE))
        legs = []
        for _, i, _, outer in self.ending(tip, ARROW_TIP):
            if self.segments[i] not in (main, main[::-1]) and ARROW_LEAST <= _away(outer, tip) <= most:
                legs.append(((outer[0] - tip[0]) / _away(outer, tip), (outer[1] - tip[1]) / _away(outer, tip)))
        return any(ARROW_COSINES[0] <= u[0] * v[0] + u[1] * v[1] <= ARROW_COSINES[1] for i, u in enumerate(legs) for v in legs[i + 1 :])

    def chains(self, centre: tuple, first: int, start: tuple, end: tuple) -> list[tuple[list, bool]]:
        """Chains from a start segment, as (steps (number, from, to), arrowhead), depth first and outermost way first.

        A chain ends at an arrowhead or at LEAD_SEGMENTS; of the ways on from a tip the LEAD_WAYS outermost are tried; LEAD_PATHS chains at most."""
        found: list[tuple[list, bool]] = []
        stack = [[(first, start, end)]]
        while stack and len(found) < LEAD_PATHS:
            path = stack.pop()
            tip = path[-1][2]
            arrow = self.has_arrowhead(tip, path[-1][1:])
            found.append((path, arrow))
            if arrow or len(path) >= LEAD_SEGMENTS:
                continue
            used = {step[0] for step in path}
            ways = sorted(((_away(far, centre), i, near, far) for _, i, near, far in self.ending(tip, LEAD_JOIN) if i not in used), reverse=True)
            stack += [[*path, way[1:]] for way in reversed(ways[:LEAD_WAYS])]
        return found


def _leads(rows: list[tuple]) -> list[tuple]:
    """Chains with an arrowhead from each block of a page: (block, start rank, path rank, place of start and tip, segments)."""
    ids = [r[1] for r in rows if r[0] == 0]
    drawn = Drawn([((r[2], r[3]), (r[4], r[5])) for r in rows if r[0] == 0])
    out = []
    for _, block, x, y, _, _ in (r for r in rows if r[0] == 1):
        starts = sorted(drawn.ending((x, y), BLOCK_START), key=lambda s: s[0])
        for k, (_, first, near, far) in enumerate(starts):
            chains = sorted(drawn.chains((x, y), first, near, far), key=lambda c: (c[1], len(c[0])), reverse=True)
            for j, (path, arrow) in enumerate(chains):
                if arrow:
                    out.append((block, k, j, *path[0][1], *path[-1][2], [ids[step[0]] for step in path]))
    return out


def coordinate_leads(blocks: DataFrame, segments: DataFrame, vertices: DataFrame) -> DataFrame:
    """What each of blocks(page, block_id, x, y) points at: (page, block_id, vertex, gap, start_rank, path_rank, x0, y0, x1, y1, path), nulls where there is nothing.

    A lead is a chain over segments(page, seg_id, x0, y0, x1, y1) from an end within BLOCK_START of the block's centre to an arrowhead within VERTEX_HIT of one of vertices(page, vertex, x, y).
    The first that succeeds counts: nearest start first, then the longest chain; ties in the order of segments."""
    both = segments.select("page", F.lit(0).alias("kind"), F.col("seg_id").cast("long").alias("id"), "x0", "y0", "x1", "y1").unionByName(blocks.select("page", F.lit(1).alias("kind"), F.col("block_id").cast("long").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")))
    found = by_page(both, _leads, "block_id long, start_rank int, path_rank int, x0 double, y0 double, x1 double, y1 double, path array<long>", "kind", "id")
    tips = found.withColumn("p", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    place = F.struct("x", "y")
    hit = gridded_within(tips, vertices.select("page", "vertex", place.alias("a"), place.alias("b")), "p", "vertex", VERTEX_HIT)
    rank = F.struct("start_rank", "path_rank", "d2", "near_id")
    best = hit.groupBy("page", "block_id").agg(F.min_by(F.struct(F.col("near_id").alias("vertex"), F.sqrt("d2").alias("gap"), "start_rank", "path_rank", "x0", "y0", "x1", "y1", "path"), rank).alias("b")).select("page", "block_id", "b.*")
    return blocks.select("page", "block_id").join(best, ["page", "block_id"], "left")


def _is_straight(path: list[tuple], near: tuple, far: tuple) -> bool:
    """Every step keeps to the way from start to end and to the step before, and ends there."""

    def unit(p: tuple, q: tuple) -> tuple | None:
        size = _away(p, q)
        return None if size <= 0.01 else ((q[0] - p[0]) / size, (q[1] - p[1]) / size)

    whole, before, here = unit(near, far), None, near
    for a, b in path:
        after = b if _away(here, a) <= _away(here, b) else a
        step = unit(here, after)
        if whole is None or step is None or any(step[0] * w[0] + step[1] * w[1] < STRAIGHT for w in (whole, before) if w):
            return False
        before, here = step, after
    return _away(here, far) <= NUMBER_JOIN


def _nearest_place(p: tuple, a: tuple, b: tuple) -> tuple[float, float, tuple]:
    dx, dy = b[0] - a[0], b[1] - a[1]
    long = dx * dx + dy * dy
    t = 0.0 if long <= 1e-9 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / long))
    q = (a[0] + t * dx, a[1] + t * dy)
    return _away(p, q), t, q


def _target(drawn: Drawn, long: list[int], tip: tuple, used: set[int]) -> tuple[int, tuple, float] | None:
    """The nearest long segment that a tip touches: its number, the place and the gap; none if it is touched near an end."""
    near = [(*_nearest_place(tip, *drawn.segments[i]), i) for i in long if i not in used]
    gap, at, place, i = min((x for x in near if x[0] <= TARGET_NEAR), key=lambda x: x[0], default=(0.0, -1.0, None, -1))
    return (i, place, gap) if TARGET_PLACE[0] <= at <= TARGET_PLACE[1] else None


def _chains_from(drawn: Drawn, long: list[int], label: tuple) -> list[tuple]:
    """(score, path, near, far, target, place) of the first proven chain from each segment that starts near a number."""
    out = []
    for gap, seed, near, far in drawn.ending(label, NUMBER_START[1]):
        if gap < NUMBER_START[0]:
            continue
        if drawn.has_arrowhead(far, drawn.segments[seed]) and (hit := _target(drawn, long, far, {seed})):
            out.append((gap + hit[2] + ONE_SECTOR, [seed], near, far, *hit[:2]))
            continue
        queue = deque([(far, [seed])])
        while queue:
            tip, path = queue.popleft()
            if drawn.has_arrowhead(tip, drawn.segments[path[-1]]):
                steps = [drawn.segments[i] for i in path]
                if not _is_straight(steps, near, tip):
                    continue
                if hit := _target(drawn, long, tip, set(path)):
                    size, direct = sum(_away(*s) for s in steps), _away(near, tip)
                    if direct <= 0.01 or size / direct > STRETCH:
                        continue
                    out.append((gap + hit[2] + len(path) * EACH_SECTOR + size * EACH_LENGTH, path, near, tip, *hit[:2]))
                    break
            if len(path) < NUMBER_SEGMENTS:
                for _, i, *_ in drawn.ending(tip, NUMBER_JOIN):
                    if i not in path:
                        a, b = drawn.segments[i]
                        queue.append((b if _away(tip, a) <= NUMBER_JOIN else a, [*path, i]))
    return out


def _number_leads(rows: list[tuple]) -> list[tuple]:
    ids = [r[1] for r in rows if r[0] == 0]
    drawn = Drawn([((r[2], r[3]), (r[4], r[5])) for r in rows if r[0] == 0])
    long = [i for i, s in enumerate(drawn.segments) if _away(*s) >= TARGET_LENGTH]
    out = []
    for _, label, x, y, _, _ in (r for r in rows if r[0] == 1):
        found = min(_chains_from(drawn, long, (x, y)), key=lambda c: c[0], default=None)
        if found is None:
            continue
        score, path, near, far, target, place = found
        start = _away(near, (x, y))
        other = min((gap for gap, i, *_ in drawn.ending((x, y), OTHER_STARTS) if OTHER_LENGTHS[0] <= _away(*drawn.segments[i]) <= OTHER_LENGTHS[1]), default=None)
        if other is not None and start - other > OTHER_STARTS:  # another segment begins much nearer to the number
            continue
        out.append((label, score, *near, *far, [ids[i] for i in path], ids[target], *place))
    return out


def number_leads(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """The proven lead from each of labels(page, label_id, x, y) to a dimension line: (page, label_id, score, x0, y0, x1, y1, path, target, x, y); labels without one are left out.

    A chain of up to NUMBER_SEGMENTS segments(page, seg_id, x0, y0, x1, y1) starts within NUMBER_START of the number, is straight, ends at an arrowhead and touches a long segment away from
    its ends. One segment alone is better than several; the smallest score counts, unless another segment begins much nearer to the number."""
    both = segments.select("page", F.lit(0).alias("kind"), F.col("seg_id").cast("long").alias("id"), "x0", "y0", "x1", "y1").unionByName(labels.select("page", F.lit(1).alias("kind"), F.col("label_id").cast("long").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")))
    return by_page(both, _number_leads, "label_id long, score double, x0 double, y0 double, x1 double, y1 double, path array<long>, target long, x double, y double", "kind", "id")
