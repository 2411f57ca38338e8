"""Every query with a DuckDB counterpart gives the same rows on the small tables; the others run."""

import decimal

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, (decimal.Decimal, float)):
        return None if x != x else float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(map(plain, x.values()))
    return x


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_duckdb(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalogue.SQL[name]})").fetchall()
    assert rows(df.select(*columns).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).collect() is not None
