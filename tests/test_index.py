"""The capped lookup and the fuzzy tail against plain loops, numbering over ranges, ancestors of any length."""

import random

from pyspark.sql import functions as F

from stratalex.operators import hierarchy, index, rank, windows


def test_capped_candidates_like_a_loop(spark):
    rng = random.Random(2)
    lines = {i: {f"t{int(rng.expovariate(0.15))}" for _ in range(rng.randint(1, 6))} for i in range(300)}
    queries = {q: {f"t{rng.randrange(30)}" for _ in range(rng.randint(1, 7))} for q in range(40)}
    by = {}
    for i, ts in lines.items():
        for t in ts:
            by.setdefault(t, set()).add(i)
    want = set()
    for q, ts in queries.items():
        found = set()
        for n, t in enumerate(sorted((t for t in ts if t in by), key=lambda t: (len(by[t]), t))):
            if n and len(by[t]) > 25:
                continue
            if len(found) > 12:
                break
            found |= by[t]
        want |= {(q, i) for i in found}
    posted = spark.createDataFrame([(t, i) for i, ts in lines.items() for t in ts], "token string, id int")
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "q int, token string")
    got = index.capped_candidates(asked, posted, index.doc_frequency(posted), "q", "id", long=25, enough=12)
    assert {tuple(r) for r in got.collect()} == want


def test_fuzzy_keeps_the_tail(spark):
    rows = [("q", f"c{i:02}", float(20 - i), "red steel bolt", "blue brass nut" if i < 7 else "red steel bolt") for i in range(12)]
    got = rank.fuzzy_rerank(spark.createDataFrame(rows, "q string, id string, score double, a string, b string"), "a", "b", "q", "id").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 13)) and [r.id for r in got[8:]] == ["c08", "c09", "c10", "c11"]
    assert [r.score for r in got[8:]] == [12.0, 11.0, 10.0, 9.0] and {r.id for r in got[:8]} == {f"c{i:02}" for i in range(8)}


def test_numbering_with_one_large_document(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), i) for i in rng.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "doc string, o int").repartition(5)
    got = {(r.doc, r.o): r.line_number for r in windows.number_all(df, "doc", "o").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == {k: n for n, k in enumerate(order, 1)}


def test_extended_like_a_loop(spark):
    rng, data, want = random.Random(6), [], set()
    for doc in range(30):
        rows = [rng.choice(["0101", "0102"]) + "".join(rng.choice("12") for _ in range(rng.choice([0, 1, 2, 4]))) for _ in range(rng.randint(1, 20))]
        for pos, d in enumerate(rows):
            data.append((doc, pos, d, "x"))
            for later in rows[pos + 1 :]:
                if later[:4] != d[:4]:
                    break
                if later.startswith(d) and len(later) > len(d):
                    want.add((doc, pos))
    df = spark.createDataFrame(data, "source_file int, pos int, digits string, description string")
    assert {tuple(r) for r in hierarchy.extended(df).select("source_file", "pos").collect()} == want
    assert df.filter(F.lit(False)).count() == 0 == hierarchy.ancestors(df.limit(0)).count()
