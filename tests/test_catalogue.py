"""Every named query against its SQL on the driver's tables."""

import math
from pathlib import Path

import duckdb
import pytest

from voxhull.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"fps", "segmentation", "medial_axis"}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(([plain(v) for v in row] for row in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, data, con, name):
    cols, got = table(catalogue.QUERIES[name](spark, data).toPandas())
    want_cols, want = table(con.execute(catalogue.ORACLES[name]).df())
    assert cols == want_cols and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 3e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_query_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0
