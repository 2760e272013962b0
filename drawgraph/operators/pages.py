"""Work within pages, many pages at a time: pairs of a page's rows, and steps that depend on order.

Rows are dealt by page and lie one page after another in a partition. Pairs are never rows of a table: they are numbers in arrays, a
block at a time, and only those that are asked for are given on. So what is sent and sorted grows with the rows, and memory holds
one page and one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import batched, chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that a task sends, and pairs of a block.
SENT, BLOCK = 10_000, 1_000_000
#: Tells pairs apart: (left's numbers, right's numbers) of a block, to the square of their distance; NaN for those that do not count.
Test = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over all shuffle partitions. What is done with a page's rows is much beside their few bytes, by which partitions would be joined again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _pages(batches: Iterator[pa.RecordBatch], work: Callable[[list[tuple]], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    found = ((page, *x) for page, mine in groupby(rows, key=lambda r: r[0]) for x in work([r[1:] for r in mine]))
    for some in batched(found, SENT):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def by_page(df: DataFrame, work: Callable[[list[tuple]], list[tuple]], made: str, *order: str) -> DataFrame:
    """work(rows) of each page, rows in an order and without the page; many pages one after another in a task, one of them in memory."""
    schema = T.StructType([df.schema["page"], *T.StructType.fromDDL(made).fields])
    rows = df.select("page", *[c for c in df.columns if c != "page"])
    return spread(rows, "page").sortWithinPartitions("page", *order).mapInArrow(partial(_pages, work=work, schema=to_arrow_schema(schema)), schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a page ends."""
    held: list[pa.RecordBatch] = []
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for b in batches:
        if not b.num_rows:
            continue
        others = np.flatnonzero(pc.not_equal(b.column(0), b.column(0)[-1]).to_numpy(zero_copy_only=False))
        if len(others):
            k = int(others[-1]) + 1
            yield joined([*held, b.slice(0, k)])
            held, b = [], b.slice(k)
        held.append(b)
    if held:
        yield joined(held)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def _blocks(left: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left rows, how many right rows each has, right rows) by blocks; left row k meets count[k] rows from start[k]."""
    done = np.cumsum(count)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + BLOCK, side="right")))
        yield left[at:to], count[at:to], _ranges(start[at:to], count[at:to])
        at = to


def _repeated(column: pa.Array) -> np.ndarray:
    """Whether a row is the same as the one before."""
    if pa.types.is_struct(column.type):
        parts = [_repeated(c) for c in column.flatten()]
        return np.logical_and.reduce(parts) if parts else np.zeros(len(column), bool)
    if pa.types.is_nested(column.type):
        rows = column.to_pylist()
        return np.array([k > 0 and rows[k] == rows[k - 1] for k in range(len(rows))], bool)
    a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate(([False][: len(column)], same.to_numpy(zero_copy_only=False))).astype(bool)


def _swept(first: int, mid: int, stop: int, x: np.ndarray, a: np.ndarray, b: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (left rows, right rows) of a crowded page: points that lie within most of a segment from left to right."""
    points = first + np.argsort(x[first:mid], kind="stable")
    right = np.arange(mid, stop)
    low = np.searchsorted(x[points], np.minimum(a, b)[right] - most, side="left")
    high = np.searchsorted(x[points], np.maximum(a, b)[right] + most, side="right")
    for rows, counts, met in _blocks(right, low, np.maximum(high - low, 0)):
        yield points[met], np.repeat(rows, counts)


def _paired(batches: Iterator[pa.RecordBatch], test: Test, own: tuple[str, ...], near: tuple[str, ...], kind: str, most: float | None, distinct: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in _whole(batches):
        if distinct:
            page, is_right = b.column(0), b.column(1).to_numpy()
            b = b.filter(pa.array(~(_repeated(b.column(2)) & _repeated(page) & (is_right == 0) & np.concatenate(([False], is_right[:-1] == 0)))))
        page, is_right = b.column(0), b.column(1).to_numpy()
        turns = np.flatnonzero(pc.not_equal(page.slice(1), page.slice(0, len(page) - 1)).to_numpy(zero_copy_only=False)) + 1
        first, stop = np.concatenate(([0], turns)), np.concatenate((turns, [len(page)]))
        if kind == "same":
            left = np.arange(len(page))
            start, count = left + 1, np.repeat(stop, stop - first) - left - 1
        else:
            lefts = np.add.reduceat(1 - is_right, first).astype(np.int64)
            left = _ranges(first, lefts)
            start, count = np.repeat(first + lefts, lefts), np.repeat(stop - first - lefts, lefts)
        number = lambda column, path: pc.struct_field(column, path.split(".")).to_numpy(zero_copy_only=False)
        l, r = b.column(2), b.column(2 if kind == "same" else 3)
        mine, theirs = [number(l, c) for c in own], [number(r, c) for c in near]

        def tested(pairs: np.ndarray, right: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):
                return test([c[pairs] for c in mine], [c[right] for c in theirs])  # noqa: B023

        found = []
        if most is not None:
            crowded = np.flatnonzero(lefts * (stop - first - lefts) > BLOCK)
            for k in crowded:
                found.append(_kept(i, j, tested(i, j)) for i, j in _swept(first[k], first[k] + lefts[k], stop[k], mine[0], theirs[0], theirs[2], most))
            count[np.repeat(np.isin(np.arange(len(first)), crowded), lefts)] = 0
        if kind == "least":
            found.append(_least(rows, counts, right, tested(np.repeat(rows, counts), right)) for rows, counts, right in _blocks(left, start, count))
        else:
            found.append(_kept(i := np.repeat(rows, counts), right, tested(i, right)) for rows, counts, right in _blocks(left, start, count))
        for i, j, value in chain(*found):
            if len(i):
                columns = [page.take(i), *(c.take(i) for c in l.flatten()), *(c.take(j) for c in r.flatten()), value]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _kept(left: np.ndarray, right: np.ndarray, value: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    kept = np.flatnonzero(~np.isnan(value))
    return pa.array(left[kept]), pa.array(right[kept]), pa.array(value[kept])


def _least(rows: np.ndarray, counts: np.ndarray, right: np.ndarray, value: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Every left row with the first right row of the least value; without one where it meets none."""
    some = counts > 0
    j, best = np.full(len(rows), -1), np.full(len(rows), np.nan)
    if some.any():
        n = counts[some]
        known = np.where(np.isnan(value), np.inf, value)
        least = np.minimum.reduceat(known, np.cumsum(n) - n)
        owner = np.repeat(np.arange(len(n)), n)
        hits = np.flatnonzero(known == least[owner])
        _, one = np.unique(owner[hits], return_index=True)
        j[some], best[some] = right[hits[one]], value[hits[one]]
    return pa.array(rows), pa.array(j, mask=~some), pa.array(best, mask=~some)


def paired(left: DataFrame, right: DataFrame | None, own: tuple[str, ...], near: tuple[str, ...], test: Test, *order: str, kind: str = "all", most: float | None = None, distinct: bool = False) -> DataFrame:
    """Pairs of rows of left and right that are on one page and pass a test: page, left's columns, right's columns and "d2", what the test gave.

    test gets the numbers named by own and near (fields of columns by dots). kind "least" keeps for every row of left the least pair alone, of equal ones the first by order, or nulls if there is none;
    kind "same" has no right: it pairs left's rows, each with those after it by order, the columns of the second as second_<name>. most says that the test is about points x, y within most of
    segments x, y, x, y, so that a crowded page is swept from left to right. With distinct, equal rows of left are one."""
    plain = lambda df: [c for c in df.columns if c != "page"]
    mine = left.select("page", F.lit(0).alias("is_right_"), F.struct(*plain(left)).alias("l_"))
    fields = [f for f in left.schema.fields if f.name != "page"]
    if right is None:
        rows = mine.filter("page is not null")
        fields += [T.StructField(f"second_{f.name}", f.dataType) for f in fields]
    else:
        theirs = right.filter("page is not null").select("page", F.lit(1).alias("is_right_"), F.struct(*plain(right)).alias("r_"), *[F.col(c).alias(f"o{k}_") for k, c in enumerate(order)])
        kinds = {f.name: f.dataType for f in theirs.schema.fields} | {"l_": mine.schema["l_"].dataType}
        none = lambda *names: [F.lit(None).cast(kinds[c]).alias(c) for c in names]
        places = [f"o{k}_" for k in range(len(order))]
        rows = (mine if kind == "least" else mine.filter("page is not null")).select("*", *none("r_", *places)).unionByName(theirs.select("*", *none("l_")))
        fields += [f for f in right.schema.fields if f.name != "page"]
    keys = [f"l_.{c}" for c in order] if right is None else [*(["l_"] if distinct else []), *places]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in (left.schema["page"], *fields, T.StructField("d2", T.DoubleType()))])
    dealt = spread(rows, "page").sortWithinPartitions("page", "is_right_", *keys)
    dealt = dealt.select("page", "is_right_", "l_", *([] if right is None else ["r_"]))
    return dealt.mapInArrow(partial(_paired, test=test, own=own, near=near, kind=kind, most=most, distinct=distinct, schema=to_arrow_schema(schema)), schema)


def squared(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """geometry.squared_to_segment of arrays, by the same steps."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    at = np.where(long <= 1e-9, 0.0, np.minimum(1.0, np.maximum(0.0, (dx * (px - ax) + dy * (py - ay)) / long)))
    x, y = px - (ax + at * dx), py - (ay + at * dy)
    return x * x + y * y


def within(value: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """What a test gives: the value where a pair counts."""
    return np.where(fits, value, np.nan)
