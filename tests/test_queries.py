"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from probity.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    found = sql.sql(registry.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    theirs = [dict(zip(found.columns, r)) for r in found.fetchall()]
    assert sorted(tuple(shown(r[c]) for c in names) for r in df.collect()) == sorted(tuple(shown(r[c]) for c in names) for r in theirs)
