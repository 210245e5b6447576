"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from cytolake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (bool, str)):
        return str(v)
    return repr(round(float(v), 9) + 0.0)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    c = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(k)]) for k in cols) for r in c.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == want
