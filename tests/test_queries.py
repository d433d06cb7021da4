"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from logquarry import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value if value is None else str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(plans.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    place = [theirs.index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in place) for row in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_growing_copies(spark, duck):
    """Every cut of a longer file is there, and each file begins the longer one it is joined with."""
    texts = {i: t.encode() for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    content = lambda i: texts[i % 10**9][: {0: None, 1: 600, 2: 900}[i // 10**9]]
    rows = {r["file_id"]: r["longest"] for r in entry.queries()["growing_copies"](spark, FOLDER).collect()}
    assert {k * 10**9 + i for i, t in texts.items() for k, n in ((1, 600), (2, 900)) if len(t) > n} <= set(rows)
    assert all(content(of).startswith(content(i)) and len(content(of)) > len(content(i)) for i, of in rows.items())
