"""Documents that outweigh their block, in several blocks of a source."""

from stratalex.llm import mixing


def test_long_documents_in_several_blocks(spark):
    texts = [("a", "w " * 40) for _ in range(6400)] + [("a", "w " * (60_000 + i)) for i in range(8)] + [("b", "w " * 5_900) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    a = [r for r in got if r.doc_id < 6408]
    share = sum(r.taken for r in a) / a[0].target
    assert abs(share - 1) < 0.005, share
    assert 0 < sum(r.copies > 0 for r in a if r.size == 40) < 6400 and max(r.copies for r in a) <= mixing.MOST
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect())) == sorted(map(tuple, got))
