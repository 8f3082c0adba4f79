"""Registered queries: those without SQL run, those with it are held against DuckDB; the entry works without the optional part."""

import subprocess
import sys

import duckdb
import pytest

from glyphsieve import queries

SF = "/root/testdata/sf0.001"


def rows(names, values):
    return sorted(repr(tuple(v for _, v in sorted(zip(names, r, strict=True)))) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels", "events", "orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_optional_part():
    code = "import sys; sys.modules['glyphsieve.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd="/".join(__file__.split("/")[:-2]))
    assert done.stdout.strip() == f"{len(queries.QUERIES)} []"
