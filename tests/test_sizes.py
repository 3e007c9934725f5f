"""Queries against their SQL on tables whose keys and counts go beyond those of the smallest."""

import duckdb
import pytest

from stratalex.plans import queries as own
from test_queries import rows


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """Parts of two volumes of the corpus (from 99,000 on headings come again)."""
    place = tmp_path_factory.mktemp("grown")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS p_partkey, p_name, p_brand, p_type, p_size FROM '/root/testdata/sf0.001/part.parquet', (SELECT unnest([0, 99000]) AS v), LATERAL (SELECT p_partkey + v AS k) WHERE p_partkey < 40) TO '{place}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{place}/part.parquet'")
    return str(place), con


def same(spark, place, con, name):
    df = own.queries()[name](spark, place)
    want = con.sql(own.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["heading_labels", "leaves_by_heading", "schedule_wordings", "stored_tariff"])
def test_headings_of_two_volumes(spark, grown, name):
    same(spark, *grown, name)


@pytest.fixture(scope="module")
def long_schedule(tmp_path_factory):
    """One brand of so many parts that its chapters number more than 99."""
    place = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT p_partkey + 1000 * v AS p_partkey, p_name, 'Brand#1' AS p_brand, p_type, p_size FROM '/root/testdata/sf0.001/part.parquet', range(6) r(v) WHERE p_partkey < 100) TO '{place}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{place}/part.parquet'")
    return str(place), con


@pytest.mark.parametrize("name", ["schedule_chapters", "schedule_counts", "schedule_tariff"])
def test_chapters_beyond_two_digits(spark, long_schedule, name):
    same(spark, *long_schedule, name)


@pytest.mark.parametrize("name", ["schedule_chapters", "schedule_counts", "schedule_tariff"])
def test_schedules_without_a_name(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT p_partkey, p_name, nullif(p_brand, 'Brand#13') AS p_brand, p_type, p_size FROM '/root/testdata/sf0.001/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert con.sql("SELECT count(*) FROM part WHERE p_brand IS NULL").fetchall()[0][0] > 3
    same(spark, str(tmp_path), con, name)


def test_files_are_dealt_over_tasks(spark, monkeypatch):
    """A table that is one task as Spark reads it is more where each row is decoded."""
    from stratalex.plans import generated

    seen = []

    def decode(files, *_, real=generated.documents.decode_documents):
        seen.append(files.rdd.getNumPartitions())
        return real(files, *_)

    monkeypatch.setattr(generated.documents, "decode_documents", decode)
    generated.decoded_documents(spark, "/root/testdata/sf0.001")
    assert spark.read.parquet("/root/testdata/sf0.001/part.parquet").rdd.getNumPartitions() == 1 and seen[0] > 1


@pytest.mark.parametrize("name, table, at_most", [("bm25_topk", "terms", 2), ("search_topk", "postings", 1)])
def test_texts_are_dealt_and_tokenized_once(spark, monkeypatch, name, table, at_most):
    """A text is tokenized once, in a task of several (the queries of bm25_topk stand in the same plan, once)."""
    seen = {}

    def store(df, to, real=own.materialise):
        seen[to] = df
        return real(df, to)

    monkeypatch.setattr(own, "materialise", store)
    own.queries()[name](spark, "/root/testdata/sf0.001")
    plan = seen[table]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and plan.count("regexp_extract_all(") == at_most


def test_bm25_leaves_texts_without_words_out_of_the_mean(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/benchmark.parquet') TO '{tmp_path}/benchmark.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'of the 12' ELSE text END AS text FROM '/root/testdata/sf0.001/documents.parquet') TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    for table in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    same(spark, str(tmp_path), con, "bm25_topk")


def test_wares_are_dealt_over_tasks(spark):
    from stratalex.plans import generated

    assert generated._wares(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
