"""Near duplicates against all pairs: a passage that many texts hold, and copies with single words changed."""

import random
from itertools import combinations

import corpus_pipeline as cp

from stratalex.llm import minhash, simhash

from .helpers import frame


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def frequent_passage(seed, others):
    """Pairs of 0.82 that share a passage with longer texts, which are less like them."""
    rng = random.Random(seed)
    passage = words(rng, 300)
    texts = [" ".join(passage + words(rng, 130 + k % 20)) for k in range(others)]
    return texts + [" ".join(passage + words(rng, 33)) for _ in range(2)]


def test_frequent_passage(spark):
    missed = []
    for seed, others in enumerate([20, 40, 40, 100, 100, 300]):
        texts = frequent_passage(seed, others)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts)).collect()}
        if [got[i] for i in range(len(texts))] != brute(texts):
            missed.append((seed, others))
    assert missed == []


def test_candidates_of_either_kind(spark, monkeypatch):
    """Links within two bits are candidates too, and only verified ones count."""
    rng = random.Random(11)
    base = words(rng, 400)
    texts = [" ".join(base), " ".join(base + words(rng, 1)), " ".join(words(rng, 400)), "", None, "a b", "a b", "a b c"]
    want = brute([t or "" for t in texts])
    # Texts without words are alike, and so are equal short ones.
    assert want[3:7] == [3, 3, 5, 5]
    plain = {r.doc_id: r.component_id for r in simhash.verified_duplicates(frame(spark, texts)).collect()}
    assert [plain[i] for i in range(len(texts))] == want
    monkeypatch.setattr(minhash, "BANDS", 1)
    monkeypatch.setattr(minhash, "ROWS", 128)  # no band is shared by different texts
    few = {r.doc_id: r.component_id for r in simhash.verified_duplicates(frame(spark, texts)).collect()}
    assert [few[i] for i in range(len(texts))] == want
    assert simhash.verified_duplicates(frame(spark, ["x"]).limit(0)).count() == 0


def test_recall_of_the_bands(spark):
    """Pairs at 0.8 and above, found without the prefix join's help: one text and one edited copy each."""
    rng, texts = random.Random(23), []
    for k in range(150):
        base = words(rng, 300)
        texts.append(" ".join(base))
        at = rng.randrange(0, 300 - 33)
        base[at : at + 20 + k % 8] = words(rng, 20 + k % 8)
        texts.append(" ".join(base))
    want = brute(texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    linked = [i for i in range(len(texts)) if want[i] != i]
    assert len(linked) > 100 and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == want[i] for i in range(len(texts)) if i not in linked)


def test_near_stage_finds_scattered_edits(spark):
    rng, texts, kept = random.Random(5), [], []
    for n in (100, 300, 1000):
        for edits in (1, n // 60):
            base = words(rng, n)
            kept.append(len(texts))
            texts.append(" ".join(base))
            for at in rng.sample(range(n), edits):
                base[at] = "edited"
            texts.append(" ".join(base))
    assert sorted(r.doc_id for r in cp.near_stage(spark, frame(spark, texts), "").collect()) == kept == sorted(set(brute(texts)))


def test_queries_against_all_rows(spark):
    """The rows asked for, with the count and the least id of all that are alike, against brute force."""
    from pyspark.sql import functions as F

    rng, texts = random.Random(31), []
    for k in range(60):
        base = words(rng, rng.choice([3, 40, 200]))
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base[:-1] + ["end"])] + [" ".join(base)] * (k % 3)
    texts += [None, "", "  "]
    ids = [i * 5 for i in range(len(texts))]
    docs = frame(spark, texts, ids=ids)
    got = {r.doc_id: r for r in minhash.fingerprint_chain(docs, every=10).collect()}
    sets = [shingles(t or "") for t in texts]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    for i, k in enumerate(ids):
        r = got[k]
        if k % 10:
            assert r.n_alike is None and r.alike_id is None
            continue
        mine = [ids[j] for j in range(len(texts)) if j != i and like(sets[i], sets[j])]
        assert (r.n_alike, r.alike_id) == (len(mine), min(mine, default=None)), k
    assert minhash.fingerprint_chain(docs.limit(0)).count() == 0
    by_name = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r.n_alike for r in minhash.fingerprint_chain(by_name).collect()} == {None}


def test_queries_in_slots(spark, monkeypatch):
    rng = random.Random(41)
    base = words(rng, 120)
    texts = [" ".join(base[:-1] + [f"end{i}"]) for i in range(60)]
    whole = sorted(map(tuple, minhash.fingerprint_chain(frame(spark, texts), every=2).collect()))
    monkeypatch.setattr(minhash, "SLOT", 3)
    assert sorted(map(tuple, minhash.fingerprint_chain(frame(spark, texts), every=2).collect())) == whole
    assert {r[-2] for r in whole} == {None, 59}
