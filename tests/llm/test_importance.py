"""The resampling against a plain count, over small chunks and many slices."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from stratalex.llm import importance

from .helpers import frame, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(ids, texts, target, buckets=10_000):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for x in some for f in features(x)) for some in (texts, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, x in zip(ids, texts):
        f = features(x)
        weight = sum(gain(at(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = len(may) * 25 // 100
    ranked = [(*r, n if n <= drawn else None) for n, r in enumerate(may, 1)]
    return sorted(ranked + [(*r, None) for r in out if r[1] < 39], key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("chars, slices", [(16_000_000, 64), (300, 7), (2000, 1)])
def test_against_a_plain_count(spark, monkeypatch, chars, slices):
    monkeypatch.setattr(importance, "CHUNK_CHARS", chars)
    monkeypatch.setattr(importance, "SLICES", slices)
    texts = [None, "", " .,-", "one", "One TWO", "ünï 漢字 x1 é", "a\x00b`c{d~e", *prose(5, 60), *["the same words again"] * 30]
    ids = [i % 70 if i % 11 else None for i in range(len(texts))]  # repeats and nulls
    target = [None, "", *prose(5, 8), "ünï 漢字 and others"]
    got = importance.resample(frame(spark, texts, ids=ids), frame(spark, target))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows(got) == plain(ids, texts, target)


def test_long_texts_and_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "gumbel", lambda i, seed: 0)
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefghijklm") * rng.randrange(1, 4) for _ in range(200_000))
    texts = [long, *["w " * 30] * 12]
    got = [r for r in importance.resample(frame(spark, texts), frame(spark, ["w w"])).collect()]
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    # Workers may have the real variate; here only the order by score, then id, is asked.
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert drawn == sorted(drawn, key=lambda r: (-r.score, r.doc_id))
    assert {r.doc_id: r.n_features for r in got}[0] == 399_999


def test_empty_tables(spark):
    assert importance.resample(frame(spark, []), frame(spark, ["a b"])).collect() == []
    texts = prose(8, 30)
    assert rows(importance.resample(frame(spark, texts), frame(spark, []))) == plain(range(30), texts, [])
    assert rows(importance.resample(frame(spark, [None, ""]), frame(spark, []))) == plain(range(2), [None, ""], [])


def test_each_distinct_tuple_is_hashed_once(spark, monkeypatch):
    """Of a slice's messages each distinct tuple meets the hash once, however many chunks have it."""
    import pyarrow as pa

    seen = Counter()
    monkeypatch.setattr(importance.zlib, "crc32", lambda x, f=zlib.crc32: (seen.update([x]), f(x))[1])

    class Part:
        @staticmethod
        def get():
            return Part

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(importance, "TaskContext", Part)
    monkeypatch.setattr(importance, "CHUNK_CHARS", 40)
    texts = ["a b c d", "b c a b c d e", "d e a b", "c d e a b c"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([False] * 12), pa.array(range(12)), pa.array(texts)], names=["target", "id", "text"])
    chunks = list(importance._chunks(pa.int64())(iter([batch])))
    assert len(chunks) > 2
    sent = pa.Table.from_batches(list(importance._messages(5)(iter(chunks)))).sort_by([("slice", "ascending"), ("chunk", "ascending")])
    list(importance._hashed(100)(iter(sent.to_batches())))
    assert set(seen) == {f.encode() for t in texts for f in features(t)} and set(seen.values()) == {1}
