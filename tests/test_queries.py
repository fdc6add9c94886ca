"""Every registered water-surface query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from hydroseries.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert df.columns and got is not None
        return
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = want.fetchall()
    order = sorted(names)
    mine = sorted(tuple(cell(r[c]) for c in order) for r in got)
    theirs = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in rows)
    assert mine == theirs
