"""Every driver query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from stratalex.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, name):
    df = own.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in own.oracle_sql():
        assert got
        return
    want = duck.sql(own.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(own.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["item_id", "doc_id", "score", "place"]
