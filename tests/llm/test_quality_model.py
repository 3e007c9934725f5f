"""The ordinal classifier against a plain version: screen, likelihood, thresholds, grades."""

import math
import random

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalex.llm import quality

from .helpers import frame, prose


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def loss(score, theta, y):
    up = [1.0, *(sigmoid(score - t) for t in theta), 0.0]
    return -math.log(max(up[y] - up[y + 1], 1e-9))


def slope(f, x, h=1e-6):
    return (f(x + h) - f(x - h)) / (2 * h)


def plain_screen(rows):
    n, out = len(rows), set()
    for b in {b for _, bs in rows for b in bs}:
        for k in (1, 2):
            held = sum(b in bs for _, bs in rows)
            ups = sum(y >= k for y, _ in rows)
            both = sum(b in bs and y >= k for y, bs in rows)
            spread = held * (n - held) * ups * (n - ups)
            if spread > 0 and n * (both * n - held * ups) ** 2 / spread > min(quality.SCREEN, 3 * math.log(n)):
                out.add(b)
    return out


def plain_fit(rows, kept, epochs=12, rate=0.3, l1=0.1, l2=0.1):
    """Gradients by differences of the loss itself, one weight at a time."""
    z, n = dict.fromkeys(kept, 0.0), dict.fromkeys(kept, 0.0)
    weight = lambda b: -(z[b] - math.copysign(l1, z[b])) / ((1 + math.sqrt(n[b])) / rate + l2) if abs(z[b]) > l1 else 0.0
    theta = [-math.log(max(p, 1e-3) / max(1 - p, 1e-3)) for p in (sum(y >= k for y, _ in rows) / len(rows) for k in (1, 2))]
    order, clip = np.random.default_rng(7), lambda x: max(-1.0, min(1.0, x))
    for epoch in range(epochs):
        for i in order.permutation(len(rows)):
            y, bs = rows[i][0], sorted(rows[i][1] & kept)
            w = {b: weight(b) for b in bs}
            s = sum(w.values())
            g = clip(slope(lambda x: loss(x, theta, y), s))
            moves = [clip(slope(lambda t, k=k: loss(s, [*theta[:k], t, *theta[k + 1 :]], y), theta[k])) for k in (0, 1)]
            theta = [t - 0.05 / (1 + epoch) * m for t, m in zip(theta, moves)]
            theta[1] = max(theta)
            for b in bs:
                z[b] += g - (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / rate * w[b]
                n[b] += g * g
    return {b: weight(b) for b in kept if weight(b)}, theta


@pytest.fixture(scope="module")
def graded():
    rng = random.Random(9)
    good, poor = prose(21, 40), [t.upper() + " !!!" for t in prose(22, 20)]
    toxic = [f"vile {t}" for t in prose(23, 15)]
    texts = [*good, *poor, *toxic, *good[:3], None, ""]
    grades = [2] * 40 + [1] * 20 + [0] * 15 + [2] * 3 + [1, 0]
    together = list(zip(texts, grades))
    rng.shuffle(together)
    return together


def test_model(spark, graded):
    docs = frame(spark, [t for t, _ in graded])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(graded)], "doc_id long, grade int")
    model = quality.train(docs, labels)
    last = {}
    for i, (t, y) in enumerate(graded):  # equal features and grade count once
        last[y, frozenset(quality.bucket(x) for x in quality.tokens(t or ""))] = i
    rows = [(y, bs) for (y, bs), _ in sorted(last.items(), key=lambda x: x[1])]
    kept = plain_screen(rows)
    weights, theta = plain_fit(rows, kept)
    assert len(rows) < len(graded) and set(model.weights) == set(weights)
    assert all(abs(model.weights[b] - w) < 1e-4 for b, w in weights.items()) and max(abs(a - b) for a, b in zip(model.thresholds, theta)) < 1e-4
    got = quality.score(docs.select(F.struct("*").alias("row")), model).select("row.doc_id", "expected_grade", "tail_probability").collect()
    for r in got:
        s = sum(model.weights.get(b, 0.0) for b in map(quality.bucket, quality.tokens(graded[r.doc_id][0] or "")))
        tails = [sigmoid(s - t) for t in model.thresholds]
        assert abs(r.expected_grade - sum(tails)) < 1e-6 and abs(r.tail_probability - tails[-1]) < 1e-6


def test_threshold_is_inclusive_and_long_texts_count_whole(spark):
    docs = frame(spark, ["a b", "c " * 400_000 + "vile"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    exact = quality.scored_rows(docs, none).select("tail_probability").first()[0]
    assert quality.select_documents(docs, none, least=exact).count() == 2 and quality.select_documents(docs, none, least=exact + 1e-12).count() == 0
    model = quality.Model({quality.bucket("vile"): -9.0}, [-5.0, -5.0])
    got = {r.doc_id: r.tail_probability for r in quality.score(docs.select(F.struct("*").alias("row")), model).select("row.doc_id", "tail_probability").collect()}
    assert got[0] > 0.9 > 0.1 > got[1]


def test_stage_keeps_the_callers_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, ["a b c", None, "d"]).select("*", F.lit("mine").alias("expected_grade"), F.col("doc_id").alias("Tail_Probability"), F.lit(1).alias("row"))
    out = cp.quality_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    wide = quality.select_documents(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert wide.columns == [c for c in docs.columns if c.lower() not in ("expected_grade", "tail_probability")] + ["expected_grade", "tail_probability"]
