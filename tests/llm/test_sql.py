"""The queries that SQL can express, against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from tests.test_queries import plain
from wakeline.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall())
