"""The driver's entry points: every query with SQL gives what the SQL gives."""

import importlib
import os

import duckdb
import pytest

from stemma import checklist_queries, queries  # noqa: F401  the first adds its queries to the second

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r) for r in rows)
    assert plain(got.select(*(f"`{c}`" for c in columns)).collect()) == plain(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0


def test_entry_imports():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
