"""The queries of this package that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from corpusmill.llm.queries import QUERIES, SQL
from tests.test_queries import TABLES, canon


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = QUERIES[name](spark, sf_dir)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canon(frame.columns, [tuple(r) for r in frame.collect()]) == canon(columns, want.fetchall())
