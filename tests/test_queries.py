"""Every registered query of the library against its SQL."""

import math
import os

import duckdb
import pytest
from celestile.plans import queries, queries_more  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str([text(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(text(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(text(r[c]) for c in sorted(columns)) for r in df.collect()) == want
