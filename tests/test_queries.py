"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
import re

import duckdb
import pandas as pd
import pytest

from drawgraph import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def rows(frame):
    return sorted(([cell(v) for v in r] for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name not in plans.ORACLES:
        assert len(got)
        return
    want = duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # whole numbers with nulls come as floats from either side
        if want[c].dtype.kind == "f" or got[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    assert rows(got) == rows(want)


def test_no_query_takes_some_ids_only():
    """SQL of pairs doesn't thin out the strokes and labels that it starts from."""
    for name in ("line_crossings", "overlapping_dimensions", "covered_dimensions", "parallel_nested_dimensions", "extension_strokes", "first_ray_hits", "crossing_legs", "near_marks", "merged_results"):
        assert not re.search(r"where (stroke|dim|label)_id % \d+ =", plans.ORACLES[name]), name


def test_leaders_of_all_strokes(spark, sf_dir):
    got = plans.QUERIES["leader_targets"](spark, sf_dir).collect()
    assert {r.leader_id % 3 for r in got} == {0, 1, 2} and all(r.leader_id != r.stroke_id for r in got)
