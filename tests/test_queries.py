"""Every registered query of the catalog engine against its SQL on DuckDB."""

import math

import duckdb
import pytest

from catalogspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def sf():
    """The scale that the correctness check takes; queries without SQL only have to run."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        return
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(got, df.columns) == plain(want.fetchall(), columns)
