"""Every query with SQL gives the rows of that SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import feeds, series

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = series.QUERIES | feeds.QUERIES, series.SQL | feeds.SQL


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v.isoformat()[:10] if hasattr(v, "isoformat") else str(list(v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(rows.columns)
    want = [tuple(plain(r[columns.index(c)]) for c in rows.columns) for r in found.fetchall()]
    have = [tuple(map(plain, r)) for r in rows.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
