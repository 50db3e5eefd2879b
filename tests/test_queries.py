"""Every query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from forecourt.plans.oracles import ORACLES
from forecourt.plans.queries import QUERIES
from forecourt.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)]) for r in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.columns, map(tuple, df.collect())) == plain(columns, got.fetchall())
