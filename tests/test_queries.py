"""Queries against their SQL on the smallest tables, where these are there."""

from collections import Counter
from pathlib import Path

import pytest

from millrace.plans import item_queries, reader_queries, record_queries
from millrace.plans.catalogue import ORACLES, QUERIES

TABLES = Path("/root/testdata/sf0.001")
NAMES = sorted(n for n, q in QUERIES.items() if q.__module__ in {m.__name__ for m in (item_queries, reader_queries, record_queries)} and n in ORACLES)


@pytest.fixture(scope="module")
def duck():
    if not TABLES.is_dir():
        pytest.skip("no test tables")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in sorted(TABLES.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    out = QUERIES[name](spark, str(TABLES))
    columns = sorted(out.columns)
    rows = duck.sql(ORACLES[name])
    assert sorted(rows.columns) == columns
    at = [rows.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in out.collect()) == Counter(tuple(r[i] for i in at) for r in rows.fetchall())
