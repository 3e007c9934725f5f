"""Exact, line and SimHash deduplication against brute force."""

import hashlib
import random

import numpy as np

from stratalex.llm import common, exact_dedup, line_dedup, simhash

from .helpers import frame, prose

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text):
    return (text or "").translate(str.maketrans(UP, LOW))


EXACT = ["Same Text", "same text", "SAME TEXT", "same texu", None, "", "É é", "É É", "é é", "x" * 5000, "x" * 4999 + "y", "X" * 5000] + ["hot"] * 30


def test_exact(spark):
    got = exact_dedup.exact_duplicates(frame(spark, EXACT), digest_all=True).collect()
    assert len(got) == len(EXACT)
    groups = {}
    for i, t in enumerate(EXACT):
        groups.setdefault(lower(t), []).append(i)
    for r in got:
        g = groups[lower(EXACT[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
        assert r.text_sha256 == hashlib.sha256(lower(EXACT[r.doc_id]).encode()).hexdigest()
    lazy = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, EXACT)).collect()}
    assert lazy[3].text_sha256 is None and lazy[0].keep_id == 2


def test_exact_rows_that_repeat(spark):
    texts, ids = ["a", "A", "a", "b", "b", "c", "c"], [1, 1, 0, None, None, None, 7]
    got = exact_dedup.exact_duplicates(frame(spark, texts, ids=ids)).collect()
    assert sum(r.kept for r in got) == 3 and {(r.doc_id, r.keep_id) for r in got if r.group_size == 3} == {(1, 1), (0, 1)}
    kept = exact_dedup.drop_exact_duplicates(frame(spark, texts, ids=ids))
    assert sorted(lower(r.text) for r in kept.collect()) == ["a", "b", "c"] and kept.columns == frame(spark, ["x"]).columns
    assert exact_dedup.exact_duplicates(frame(spark, ["x"]).limit(0)).count() == 0


def test_exact_with_names_in_use(spark):
    from pyspark.sql import functions as F

    names = ["id", "row", "_id", "_keep", "_sha", "_here", "keep_id", "group_size", "kept", "text_sha256", "whole_text", "n_bytes", "word", "bit", "bits", "candidate", "grouped", "ties", "first"]
    docs = frame(spark, EXACT + ["a b", "A b"], ids=[*range(len(EXACT)), None, None])
    wide = docs.select("*", *(F.lit("q").alias(n) for n in names if n not in docs.columns))
    assert sorted(map(repr, exact_dedup.exact_duplicates(wide).collect())) == sorted(map(repr, exact_dedup.exact_duplicates(docs).collect()))
    kept = exact_dedup.drop_exact_duplicates(wide)
    assert kept.columns == wide.columns
    want = sorted(repr(r.doc_id) for r in exact_dedup.exact_duplicates(docs).filter("kept").collect())
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want


def test_exact_with_a_full_bitmap(spark, monkeypatch):
    """More surviving groups than bits: more texts are hashed, the result is the same."""
    texts = prose(12, 60) * 2 + prose(13, 60)
    plain = sorted(map(repr, exact_dedup.exact_duplicates(frame(spark, texts), digest_all=True).collect()))
    kept = sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(frame(spark, texts)).collect())
    monkeypatch.setattr(common, "BITMAP_WORDS", 1)
    assert sorted(map(repr, exact_dedup.exact_duplicates(frame(spark, texts), digest_all=True).collect())) == plain
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(frame(spark, texts)).collect()) == kept


def brute_lines(docs, size=3):
    first, out = {}, []
    order = sorted(docs.items())
    for k, text in order:
        ls = text.split("\n")
        for p in range(len(ls) - size + 1):
            first.setdefault(tuple(ls[p : p + size]), (k, p))
    for k, text in order:
        ls = text.split("\n")
        gone = {q for p in range(len(ls) - size + 1) if first[tuple(ls[p : p + size])] != (k, p) for q in range(p, p + size)}
        out.append((k, "\n".join(x for i, x in enumerate(ls) if i not in gone), len(ls), len(gone)))
    return out


def test_lines(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["same\n" * 50, "same\n" * 50, "", None, "one\ntwo", "x\n" * 20000]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, texts)).collect())
    assert got == brute_lines({i: t or "" for i, t in enumerate(texts)})
    twice = line_dedup.dedup_lines(frame(spark, ["a\nb\nc", "a\nb\nc", "q\na\nb\nc"], ids=[3, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.text) for r in twice) == [(-1, "q\na\nb\nc"), (3, ""), (3, "")]
    assert line_dedup.dedup_lines(frame(spark, ["x"]).limit(0)).count() == 0


def brute_components(fps, bits=2):
    f = np.array(fps, np.uint64)
    root = list(range(len(f)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= bits)):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def plain_fingerprint(text):
    import xxhash

    w = lower(text).encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(spark):
    texts = prose(2, 80) + [None, "", " \t\n", "One", "one two", "ONE two", "éa É b"] + ["hot copy of a text " * 5] * 9
    texts += [t + " tail" for t in texts[:20]] + [texts[0] * 40]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)
    assert simhash.near_duplicates(frame(spark, ["x"]).limit(0)).count() == 0
    odd = simhash.near_duplicates(frame(spark, ["a b c d", "a b c d", "zz"], ids=[4, None, None])).collect()
    assert sorted((r.doc_id is None, r.component_id or -1) for r in odd) == [(False, 4), (True, -1), (True, 4)]


def test_links_of_a_hot_group(spark, monkeypatch):
    """Many fingerprints that differ in few bits: groups are dealt anew, and no link is lost."""
    monkeypatch.setattr(simhash, "HOT_GROUP", 20)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(500):
        f = rng.choice(fps[150:] or fps[:3]) if rng.random() < 0.6 else fps[0]
        for _ in range(rng.randint(1, 3)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    from stratalex.llm.components import components

    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    tree = {r.node: r.root for r in components(simhash.links(df)).collect()}
    root = brute_components(fps)
    groups = {}
    for f, r in zip(signed, root):
        groups.setdefault(r, set()).add(tree.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_either_size(spark, monkeypatch):
    """One task for few edges, rounds for more: the same components as a plain union, chains and hubs included."""
    from stratalex.llm import components as c

    rng = random.Random(9)
    pairs = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root if find(x) != x}
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    for few in (c.FEW, 10):
        monkeypatch.setattr(c, "FEW", few)
        assert {tuple(r) for r in c.components(edges).collect()} == want
    assert c.components(edges.limit(0)).count() == 0


def test_index():
    rng = np.random.default_rng(4)
    codes = np.unique(np.r_[rng.integers(0, 2**63, 300, np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 63, 200, np.uint64))])
    index = simhash.GrayIndex(codes)
    for bits in (0, 1, 2, 5):
        got = {tuple(sorted((int(index.codes[i]), int(index.codes[j])))) for a, b in index.pairs(bits, 64) for i, j in zip(a, b)}
        want = {tuple(sorted((int(codes[i]), int(codes[j])))) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits, 1)))}
        assert got == want


def test_index_memory_of_a_dense_group():
    """Many codes that nearly all lie within a few bits: clusters as by pairs, in memory that does not grow with the pairs."""
    import tracemalloc

    rng = np.random.default_rng(6)
    codes = np.full(12_000, 0x123456789ABCDEF0, np.uint64)
    for _ in range(8):
        codes ^= np.uint64(1) << rng.integers(0, 32, len(codes), np.uint64)
    codes = np.unique(codes)
    tracemalloc.start()
    root = simhash.GrayIndex(codes).roots(2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    few = codes[np.argsort(np.bitwise_count(codes ^ np.uint64(0x123456789ABCDEF0)), kind="stable")[:600]]
    got, want = simhash.GrayIndex(few).roots(2), brute_components([int(c) for c in few])
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist())) < 600
