"""The dual of the mixture against a plain solver, clashing names, and ids that repeat."""

import math
import random

from pyspark.sql import functions as F

from stratalex.llm import mixing

from .helpers import frame, prose


def plain_rates(sizes, targets, most=3.0, ridge=mixing.RIDGE):
    """By nested bisection: sizes {source: [size]}, targets {source: target} -> (beta, {(source, size): rate})."""
    every = [x for xs in sizes.values() for x in xs]
    centre = sum(x * math.log(x) for x in every) / sum(every)
    total = sum(targets.values())
    rate = lambda lam, beta, x: min(most, math.exp(lam + beta * (math.log(x) - centre)))

    def bisect(f, low, high):
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) > 0 else (low, mid)
        return (low + high) / 2

    def lambdas(beta):
        out = {}
        for s, xs in sizes.items():
            if targets[s] >= most * sum(xs) * (1 - 1e-9):
                out[s] = 60.0
            else:
                out[s] = bisect(lambda lam: targets[s] - sum(x * rate(lam, beta, x) for x in xs), -60, 60)  # noqa: B023
        return out

    def slope(beta):
        lam = lambdas(beta)
        return -sum(x * rate(lam[s], beta, x) * (math.log(x) - centre) for s, xs in sizes.items() for x in xs) - ridge * total * beta

    beta = bisect(slope, -20, 20)
    lam = lambdas(beta)
    return beta, {(s, x): rate(lam[s], beta, x) for s, xs in sizes.items() for x in xs}


def test_dual_against_a_plain_solver(spark):
    """Long documents are in the source that shrinks, so the closed form of single sources would shorten the mixture."""
    rng = random.Random(3)
    sizes = {"a": [rng.choice([rng.randint(5, 60), rng.randint(300, 900)]) for _ in range(90)], "b": [rng.choice([rng.randint(5, 60), rng.randint(100, 300)]) for _ in range(80)], "c": [rng.randint(5, 400) for _ in range(90)], "d": [rng.randint(1, 9) for _ in range(6)]}
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.select("source", mixing.word_count(F.col("text")).alias("size"))
    sources = mixing.targets(sized).cache()
    targets = {r.source: r.target for r in sources.collect()}
    beta, want = plain_rates(sizes, targets)
    state, got_beta = mixing.solve(sized.withColumnRenamed("source", "sized_source"), sources)
    assert abs(got_beta - beta) < 1e-6 and abs(beta) > 0.05
    level = {r.source: r for r in state.join(sources, "place").collect()}
    for (s, x), r in want.items():
        own = 3.0 if level[s].level is None else min(3.0, level[s].level * math.exp(got_beta * (math.log(x) - level[s].centre)))
        assert abs(own - r) < 1e-5, (s, x)
    off = max(abs(r - targets[s] / sum(sizes[s])) for (s, _), r in want.items())
    assert off > 0.05  # where the closed form fails
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target + 30 for r in got)
    mean = lambda pairs: sum(n * x * math.log(x) for n, x in pairs) / sum(n * x for n, x in pairs)
    plain = mean([(1, x) for xs in sizes.values() for x in xs])
    closed = mean([(targets[s] / sum(xs), x) for s, xs in sizes.items() for x in xs])
    ours = mean([(r, x) for (s, x0), r in want.items() for x in sizes[s] if x == x0])
    assert abs(ours - plain) < abs(closed - plain) / 2


def test_documents_of_one_length(spark):
    """Lengths that cannot be kept, or do not differ, leave beta finite and the targets met."""
    docs = spark.createDataFrame([(i, "w " * (10 if i % 2 else 200), "short" if i % 2 else "long") for i in range(200)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 200 for r in got)
    same = docs.filter("source = 'long'")
    assert {r.copies for r in mixing.mix(same).collect()} == {1}


def test_names_in_use(spark):
    names = ["id", "row", "copies", "place", "rate", "f", "lam", "hash", "p_id", "p_hash", "_id", "_hash", "_copies", "_n", "docs", "rows", "target", "source_size"]
    docs = frame(spark, prose(30, 40) + [None, ""])
    wide = docs.select("*", *(F.lit("q").alias(n) for n in names if n not in docs.columns))
    assert sorted(map(tuple, mixing.mix(wide).collect())) == sorted(map(tuple, mixing.mix(docs).collect()))
    taken = mixing.take(wide)
    assert taken.columns == wide.columns and sorted(r.doc_id for r in taken.collect()) == sorted(r.doc_id for r in mixing.take(docs).collect())


def test_ids_that_repeat(spark):
    """A third of all rows are one row without an id; another third share an id.  Blocks stay small, totals are kept."""
    rows = [(None, "one two three four", "a")] * 3000 + [(7, f"w{i} " * 20, "a") for i in range(3000)] + [(i, f"x{i} " * 30, "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs)
    sums = got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sorted(r.n for r in sums) == [3000, 6000] and all(abs(r.taken - r.target) < 0.005 * r.target for r in sums)
    copies = got.filter("doc_id is null").groupBy("copies").count().collect()
    assert max(r.copies for r in copies) <= 3 and sum(r["count"] for r in copies) == 3000
    assert mixing.take(docs).count() == got.agg(F.sum("copies")).first()[0]
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))
