"""Queries of the training-data operators against their SQL."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(ORACLE_SQL[name])
    rows = QUERIES[name](spark, SF)
    assert [c[0] for c in found.description] == rows.columns
    assert sorted(map(tuple, rows.collect())) == sorted(found.fetchall())
