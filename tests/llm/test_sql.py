"""The queries with a DuckDB counterpart give its rows."""

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({queries.SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want)


#: The table and key that a query's rows answer for; op11 gives words, not rows of a table.
KEYS = {"op13_extraction": ("pages", "page_id"), "op11_spelling": None}


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if KEYS.get(n, True)))
def test_covers_every_row(spark, name):
    table, key = KEYS.get(name, ("documents", "doc_id"))
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert queries.QUERIES[name](spark, SF).select(key).distinct().count() == n
