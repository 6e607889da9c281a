"""Every query against its SQL, on the smallest tables; what SQL cannot express is only run."""

import math
from pathlib import Path

import pytest

from wakeline.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows):
    value = lambda x: None if x is None else round(float(x), 6) if isinstance(x, float) and not math.isnan(x) else str(x)
    return sorted(str([value(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name in catalog.ORACLE_SQL:
        want = duck.execute(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
        assert plain(rows) == plain(want)
    assert rows or name in ("geofence", "area_relations", "area_intersections")  # which the smallest tables have too few rows for


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_where_a_module_of_the_llm_queries_is_absent(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "wakeline.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)
