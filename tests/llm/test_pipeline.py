"""The stages one by one against plain versions, each on its own input, and run() as their chain."""

import corpus_pipeline as cp
import pytest

from stratalex.llm import mixing
from stratalex.llm.common import read
from stratalex.llm.queries import queries

from .test_dedup import lower
from .test_near_pairs import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from stratalex.llm.common import materialise

    docs, out = read(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SF), name)
        out.append((before, docs))
    return out


def test_stages(spark, stages):
    columns = read(spark, SF, "documents").columns
    assert all(after.columns == columns for _, after in stages[:-1])
    got = [([r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()]) for a, b in stages]
    labels = {r.doc_id: r for r in read(spark, SF, "labels").collect()}
    (before, after), exact, near, mixed, tokens = got
    kept = {r["doc_id"] for r in after}
    clean = [k for k, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(k in kept for k in clean) / len(clean) > 0.95
    toxic = [k for k, r in labels.items() if r.toxic == 1]  # few examples here; test_quality has more
    assert sum(k in kept for k in toxic) <= 0.4 * len(toxic)
    groups = {}
    for r in exact[0]:
        groups[lower(r["text"])] = max(groups.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact[1]) == sorted(groups.values())
    rows = sorted(near[0], key=lambda r: r["doc_id"])
    root = brute([r["text"] or "" for r in rows])
    assert sorted(r["doc_id"] for r in near[1]) == sorted({rows[k]["doc_id"] for k in root})
    plan = {r.doc_id: r.copies for r in mixing.mix(stages[3][0]).collect()}
    times = {}
    for r in mixed[1]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {k: c for k, c in plan.items() if c}
    assert sorted(r["doc_id"] for r in tokens[1]) == sorted(r["doc_id"] for r in mixed[1]) and all(r["n_tokens"] > 0 or not r["ids_sha256"] for r in tokens[1])


def test_run_is_the_chain(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_queries():
    names = list(queries())
    assert len(names) == 13 and all(n.startswith(f"op{i}_") for i, n in enumerate(names, 1))


def test_awkward_documents(spark, tmp_path):
    """Nulls in any column, empty texts, rows that repeat, extra columns, and an empty table."""
    import shutil

    from pyspark.sql import functions as F

    from .helpers import SCHEMA, prose, rows

    texts = prose(20, 30)
    made = rows([*texts, texts[0].upper(), None, "", "  ", "x" * 200_000])
    made += [made[3], made[3], (None, texts[5], None, None, None, *[None] * 7), (7, "another text of the same id " * 9, "en", "src1", 1, *[None] * 7)]
    docs = spark.createDataFrame(made, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (None, None, None), (1, None, 1)], "doc_id long, quality int, toxic int").limit(1).write.parquet(str(tmp_path / "labels.parquet"))
    df = docs
    for name, stage in cp.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns, name
        df = spark.createDataFrame(df.collect(), docs.schema)
    left = {(r.text or "").lower() for r in df.collect()}
    assert {t.lower() for t in texts} - left == set() or len(left) > 20
    assert cp.STAGES[-1][1](spark, df, str(tmp_path)).count() == df.count()
    shutil.rmtree(tmp_path / "documents.parquet")
    docs.filter(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
