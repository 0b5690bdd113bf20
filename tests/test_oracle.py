"""Every query with SQL gives DuckDB's rows; the others give rows with stable columns."""

import os

import duckdb
import pytest

from trellis.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


def normal(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_duckdb(spark, name):
    d = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    want = rows_of(names, want.fetchall())
    df = catalogue.QUERIES[name](spark, d)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE_SQL.keys()))
def test_gives_rows(spark, tiny, name):
    assert catalogue.QUERIES[name](spark, tiny).count() > 0
