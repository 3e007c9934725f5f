"""The join against all pairs, its lemma and its candidates on their own."""

import random
from itertools import combinations

import numpy as np
import pytest

from stratalex.llm import jaccard_join
from stratalex.llm.components import components

from .helpers import frame
from .test_near_pairs import frequent_passage, words


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(n, m, both, least=80):
    return 100 * both >= least * (n + m - both)


def brute(ids, texts, least=80):
    sets, root = [sets_of(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and linked(len(sets[i]), len(sets[j]), len(sets[i] & sets[j]), least):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    best = {}
    for r, i in zip(root, ids):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return sorted(((i, len(s), i if not s else best.get(r)) for i, s, r in zip(ids, sets, root)), key=repr)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("xyz") * 5
    return " ".join(w)


def corpus(seed):
    """Copies with words changed, around the threshold; chains; short and odd texts; equal sets of different texts."""
    rng = random.Random(seed)
    texts = [None, "", "  \t\n", "one", "ONE", "one two three", "one two three", "a b c d e", "A b c d E", "a b c d e f", "ü é", "é ü", "x " * 40, "x " * 50]
    for _ in range(12):
        base = " ".join(words(rng, rng.randrange(20, 120)))
        texts += [base, base.upper(), *(edited(rng, base, rng.randrange(1, 6)) for _ in range(4))]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, 1)
            texts.append(chain)
    passage = words(rng, 60)
    texts += [" ".join(passage + words(rng, k)) for k in range(2, 30)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, crossing", [(0, 4), (1, 0), (2, 4)])
def test_all_pairs(spark, monkeypatch, seed, crossing):
    monkeypatch.setattr(jaccard_join, "CROSSING", crossing)  # 0: all rounds of drawn pairs
    texts = corpus(seed)
    ids = [i % 90 if i % 17 else None for i in range(len(texts))]  # repeated and null ids
    got = jaccard_join.join(frame(spark, texts, ids=ids))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ids, texts)


def test_frequent_passage(spark):
    for seed, others in enumerate([20, 150]):
        texts = frequent_passage(seed, others)
        got = jaccard_join.join(frame(spark, texts))
        assert sorted(map(tuple, got.collect()), key=repr) == brute(range(len(texts)), texts)


def test_long_repeated_and_empty(spark):
    rng = random.Random(5)
    long = " ".join(words(rng, 60_000))
    texts = [long, long + " end", long[: len(long) // 2], *["copy of a text of many words"] * 300]
    got = jaccard_join.join(frame(spark, texts))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(range(len(texts)), texts)
    assert jaccard_join.join(frame(spark, [])).collect() == []
    assert [tuple(r) for r in jaccard_join.join(frame(spark, [None])).collect()] == [(0, 0, 0)]


def test_matches_of_prefixes():
    """Sets that are alike share l of their first n - required + l, and the pair's bound holds, for random orders."""
    rng = random.Random(2)
    for _ in range(3000):
        both, x, y = rng.randrange(1, 40), rng.randrange(8), rng.randrange(8)
        n, m = both + x, both + y
        if not linked(n, m, both):
            continue
        items = rng.sample(range(1000), both + x + y)
        a, b = sorted(items[: both + x]), sorted(items[:both] + items[both + x :])
        for k in range(1, min(jaccard_join.MATCHES, jaccard_join.required(max(n, m))) + 1):
            first, second = a[: n - jaccard_join.required(n) + k], b[: m - jaccard_join.required(m) + k]
            assert len(set(first) & set(second)) >= k
            px, py = (min(s.index(t) for t in set(first) & set(second)) for s in (a, b))
            assert min(n - px, m - py) * 180 >= (n + m) * 80


@pytest.mark.parametrize("verify, run, meet", [(0, 64, 500_000), (0.02, 2, 10), (1, 1, 3), (1, 8, 40)])
def test_candidates_lose_no_link(spark, monkeypatch, verify, run, meet):
    """Without stars and drawn pairs the candidates alone hold every link, whatever each class asks for."""
    monkeypatch.setattr(jaccard_join, "VERIFY", verify)
    rng = np.random.default_rng(4)
    base = [rng.choice(400, 40, replace=False) for _ in range(12)]
    sets = [np.unique(np.r_[rng.choice(b, rng.integers(30, 41), replace=False), rng.choice(400, rng.integers(0, 6))]) for b in base for _ in range(8)]
    rows = []
    for c, s in enumerate(sets):
        spare = len(s) - jaccard_join.required(len(s))
        rows += [(int(t), c, c, len(s), p, max(1, p - spare + 1)) for p, t in enumerate(s[: spare + jaccard_join.MATCHES])]
    open_ = spark.createDataFrame(rows, "token long, class long, root long, n int, p int, level int")
    monkeypatch.setattr(jaccard_join, "RUN", run)
    monkeypatch.setattr(jaccard_join, "MEET", meet)
    found = [frozenset(r) for r in jaccard_join.candidates(open_).collect()]
    got = set(found)
    assert len(got) == len(found)
    links = {frozenset((i, j)) for i, j in combinations(range(len(sets)), 2) if linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])))}
    asked = {r.matches for r in jaccard_join._matches(open_, open_.groupBy("token").count().withColumnRenamed("count", "held"), 80).collect()}
    assert links and links <= got and asked == {1} if verify == 0 else max(asked) > 1
    assert links <= got
    assert len(got) < len(sets) * (len(sets) - 1) / 2


def test_components_of_many_tasks(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2200)] + [(i, i + 1) for i in range(5000, 5400)] + [(7000, i) for i in range(7001, 7400)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = sorted((x, find(x)) for x in {x for e in edges for x in e} if find(x) != x)
    for parts in (1, 13):
        df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
        assert sorted(map(tuple, components(df).collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bitmaps_lose_no_pair(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in [1, 2, 3, 31, 32, 33, 100, 130, 700]:
        for change in (0, 1, n // 9, n // 5, n):
            a = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
            b = np.r_[a[: n - change], rng.integers(0, 1 << 64, change + n // 12, np.uint64, endpoint=False)]
            a, b = np.unique(a), np.unique(b)
            if len(a) and len(b):
                for x, y in ((a, b), (b, a)):
                    rows.append((len(x), jaccard_join.bits_of(x).tolist(), len(y), jaccard_join.bits_of(y).tolist(), bool(linked(len(x), len(y), len(np.intersect1d(x, y))))))
    df = spark.createDataFrame(rows, "na int, bita array<long>, nb int, bitb array<long>, alike boolean")
    got = [(r.alike, r.may) for r in df.withColumn("may", jaccard_join.may_be_alike(80)).collect()]
    assert all(may for alike, may in got if alike) and any(alike for alike, _ in got)
    assert sum(may for alike, may in got if not alike) < sum(not alike for alike, _ in got)


def test_near_copies_without_ids(spark):
    """Rows that no id tells apart: their sets come more than once, and each class is still compared once."""
    rng = random.Random(12)
    base = " ".join(words(rng, 60))
    texts = [base, *(edited(rng, base, 1) for _ in range(12))] * 2 + [" ".join(words(rng, 60))]
    ids = [None] * 20 + list(range(20, len(texts)))
    got = jaccard_join.join(frame(spark, texts, ids=ids)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(ids, texts)


def test_many_pairs_of_one_class(spark):
    """The bitmap of a class goes to lists of its pairs, not to each pair; the pairs found are those of whole sets."""
    rng = random.Random(13)
    base = words(rng, 40)
    sets = [jaccard_join.shingles(" ".join(base[: 40 - i % 12] + words(rng, i % 12))) for i in range(60)]
    rows = [(i, [int(x) for x in s.view(np.int64)], [int(x) for x in jaccard_join.bits_of(s)]) for i, s in enumerate(sets)]
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long")
    want = {(0, i) for i in range(1, 60) if linked(len(sets[0]), len(sets[i]), len(np.intersect1d(sets[0], sets[i])))}
    assert {tuple(r) for r in jaccard_join.verified(pairs, spark.createDataFrame(rows, "class long, shingles array<long>, bits array<long>")).collect()} == want
    assert 0 < len(want) < 59


def test_shuffle_files_go_with_their_step(spark):
    """What was shuffled for a table that is written goes at once, and the session's setting is as before."""
    import time

    from stratalex import storage

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    setting = spark.conf.get(storage._CLEAN, None)
    before = files()
    out = storage.materialise(spark.range(5000).selectExpr("id % 70 as k").groupBy("k").count(), "counted")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 70 and spark.conf.get(storage._CLEAN, None) == setting


def _exchanged(df, column):
    """Shuffles of df's plan that are dealt by the column alone."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({column}#")


def test_lists_stay_where_they_are_dealt(spark):
    """Lists are dealt by their shingle once: stars move only their pairs, and lists that are open are dealt alike."""
    rows = [(t, c, 40 + c % 3, c % 5, 1 + c % 2) for t in range(40) for c in range(t, t + 1 + t % 4)]
    entries = spark.createDataFrame(rows + rows[:7], "token long, class long, n int, p int, level int")
    listed = jaccard_join._listed(entries)
    count = {t: sum(r[0] == t for r in rows + rows[:7]) for t in range(40)}
    assert sorted(map(tuple, listed.collect())) == sorted(r for r in rows if count[r[0]] > 1)
    stars = jaccard_join._stars(listed, 80)
    assert _exchanged(stars, "token") == _exchanged(stars, "band") == 0
    labels = spark.createDataFrame([(c, c - c % 3) for c in range(50)], "class long, root long")
    open_ = jaccard_join._open(listed, labels)
    roots = {t: {c - c % 3 for u, c, *_ in rows if u == t} for t in range(40)}
    assert sorted((r["token"], r["class"], r.root, r.n, r.p, r.level) for r in open_.collect()) == sorted((t, c, c - c % 3, n, p, k) for t, c, n, p, k in rows if count[t] > 1 and len(roots[t]) > 1)
    held = open_.groupBy("token").count()
    assert _exchanged(held, "token") == 0 and held.count() == sum(len(r) > 1 for r in roots.values())


def test_stars_of_lists(spark):
    """Each class with the least of its list and band of lengths, where their lengths allow a link."""
    rng = random.Random(21)
    rows = sorted({(rng.randrange(12), c): (rng.randrange(5, 60), rng.randrange(3), rng.randrange(1, 3)) for c in range(120) for _ in range(3)}.items())
    rows = [(t, c, 5 + c % 50, p, k) for (t, c), (_, p, k) in rows]
    near = [(t, int(np.floor(np.log(n) / np.log(1.25))), c, n) for t, c, n, _, k in rows if k == 1]
    want = set()
    for t, band, c, n in near:
        a, na = min((d, m) for u, of, d, m in near if (u, of) == (t, band))
        if a != c and min(n, na) * 100 >= max(n, na) * 80:
            want.add((a, c))
    got = list(map(tuple, jaccard_join._stars(jaccard_join.bucketed(spark.createDataFrame(rows, "token long, class long, n int, p int, level int"), "rows", "token"), 80).collect()))
    assert want and len(got) == len(set(got)) and set(got) == want


def test_copies_of_one_task_are_written_once(spark):
    text = " ".join(words(random.Random(3), 50))
    got = jaccard_join._prefixes(spark.createDataFrame([(text,)] * 9, "text string").coalesce(1), np.zeros(jaccard_join.BUCKETS, np.uint8), 0, 80)
    assert got.count() == got.select("token").distinct().count() == 46 - jaccard_join.required(46) + jaccard_join.MATCHES
