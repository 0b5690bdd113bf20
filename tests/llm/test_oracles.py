"""Queries with SQL give DuckDB's rows, also on a small table of edge cases."""

import duckdb
import pytest

from trellis.llm import oracles, queries

TABLES = "documents pages benchmark labels".split()
KEY = "ab12" * 5
WORDS = [f"w{i}" for i in range(60)]
DOCS = [
    (1, None), (2, ""), (3, " \n "), (4, "é token = '" + KEY + "' x " + KEY), (4, "é token = '" + KEY + "' x " + KEY), (5, "TOKEN:short AKIA" + "Z" * 14 + " AKIAZ"),
    (6, " ".join(WORDS)), (7, " ".join(WORDS[:59]) + " y"), (None, " ".join(WORDS)), (8, " ".join(WORDS).upper()), (9, "w1 w2"), (10, "w1\x0bw2"), (11, "paſſword=abcdefghijkl toKen=abcdefghijkl"),
    (12, "a " * 300), (13, "a " * 290), (14, "-----BEGIN RSA PRIVATE KEY----- rk_live_" + "a1" * 9 + " ghp_" + "A" * 36 + "\U0001f600 xoxb-1234567890"),
]
PAGES = [(1, "u", None), (2, "u", ""), (3, "u", "é"), (9, "v", "é"), (5, None, "é"), (None, "u", "z"), (7, "u", "z")]
BENCH = [(1, " ".join(WORDS[:20])), (2, "w30 w31"), (3, None), (10, " ".join(WORDS[40:53])), (11, "..."), (12, "a a a")]


def both(spark, d, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(oracles.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, d).select(*names)
    assert sorted(df.columns) == sorted(queries.QUERIES[name](spark, d).columns)
    return sorted(map(tuple, df.collect()), key=repr), sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_same_as_duckdb(spark, tiny, name):
    got, want = both(spark, tiny, name)
    assert got == want and got


@pytest.fixture(scope="module")
def edge_tables(tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    d = tmp_path_factory.mktemp("edges")
    columns = {
        "documents": ([*zip(*DOCS, strict=True)], [("doc_id", pa.int64()), ("text", pa.string())]),
        "pages": ([*zip(*PAGES, strict=True)], [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
        "benchmark": ([*zip(*BENCH, strict=True)], [("item_id", pa.int64()), ("text", pa.string())]),
        "labels": (([1], [1], [0]), [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    }
    for name, (values, kinds) in columns.items():
        pq.write_table(pa.table([pa.array([*v], k) for v, (_, k) in zip(values, kinds, strict=True)], names=[n for n, _ in kinds]), f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_edges_same_as_duckdb(spark, edge_tables, name):
    got, want = both(spark, edge_tables, name)
    assert got == want
