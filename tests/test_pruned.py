"""Pruned top-k against the full score, and how much of it is never scored."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.operators import index, pruned


def plain(asked, gains, k, cover, digits=6):
    out = []
    for q, terms in asked.items():
        scores = []
        for d, row in gains.items():
            got = [row[t] for t in terms if t in row]
            if got:
                scores.append((round(sum(got) * (cover[0] + cover[1] * len(got) / len(terms)), digits), d))
        out += [(q, d, s, n) for n, (s, d) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def tables(spark, seed, docs=400, vocabulary=120):
    rng = random.Random(seed)
    draw = lambda n: {min(vocabulary - 1, int(rng.expovariate(0.05))) for _ in range(n)}
    gains = {d: {t: round(rng.choice([0.1, 0.5, 1.0]) * (1 + t / 10), 3) for t in draw(rng.randrange(1, 25))} for d in range(docs)}
    asked = {q: draw(rng.randrange(1, 14)) for q in range(12)} | {99: {10_000}}
    rows = spark.createDataFrame([(t, d, float(g)) for d, row in gains.items() for t, g in row.items()], "term long, id long, gain double").repartition(3)
    ask = spark.createDataFrame([(q, t, len(ts)) for q, ts in asked.items() for t in ts], "q long, term long, n int")
    return asked, gains, ask, rows


@pytest.mark.parametrize("cover", [(1.0, 0.0), (0.65, 0.35)])
@pytest.mark.parametrize("block, seeds", [(16, 60), (1000, 1)])
def test_equals_the_full_score(spark, cover, block, seeds):
    asked, gains, ask, rows = tables(spark, block)
    blocks = pruned.in_blocks(rows, "id", block)
    got = pruned.pruned_top_k(ask, blocks, 5, "q", "id", cover, seeds=seeds)
    got, want = sorted((r.q, r.place, r.score, r.id) for r in got.collect()), sorted((q, n, s, d) for q, d, s, n in plain(asked, gains, 5, cover))
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))
    assert sum(a[3] != b[3] for a, b in zip(got, want)) <= 2  # sums in another order may round the other way


def test_most_pairs_are_not_scored(spark):
    asked, gains, ask, rows = tables(spark, 3, docs=800)
    blocks = pruned.in_blocks(rows, "id", 16).cache()
    met, _ = pruned.candidates(ask, blocks, 3, "q", "id", (0.65, 0.35), seeds=60)
    every = ask.join(rows, "term").select("q", "id").distinct().count()
    assert met.count() < 0.7 * every and met.filter("hopes").count() < 0.25 * every


def closed_form(ask, posted, freq, long, enough):
    """All hits of all tokens, then the cut."""
    known = ask.join(freq, "token")
    ranked = known.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("df", "token"))).filter((F.col("rank") == 1) | (F.col("df") <= long))
    hits = ranked.join(posted, "token").groupBy("q", "id").agg(F.min("rank").alias("rank"))
    new = hits.groupBy("q", "rank").agg(F.count(F.lit(1)).alias("new"))
    found = F.coalesce(F.sum("new").over(W.partitionBy("q").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return hits.join(new.withColumn("found", found).filter(F.col("found") <= enough).select("q", "rank"), ["q", "rank"]).select("q", "id")


@pytest.mark.parametrize("long, enough", [(30, 20), (5, 0), (1000, 90)])
def test_staged_lookup(spark, long, enough):
    _, _, ask, rows = tables(spark, long)
    ask, posted = ask.select("q", F.col("term").alias("token")), rows.select(F.col("term").alias("token"), "id")
    freq = index.doc_frequency(posted)
    got = index.capped_candidates(ask, posted, freq, "q", "id", long, enough)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed_form(ask, posted, freq, long, enough).collect()))
    assert index.capped_candidates(ask.limit(0), posted, freq, "q", "id").collect() == []
