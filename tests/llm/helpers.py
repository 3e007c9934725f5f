"""Small tables with every awkward case: nulls anywhere, empty and long texts, ties, repeats, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, word string, n int, chunk string, hash string, head string"


def rows(texts, sources=None, ids=None):
    out = []
    for i, text in enumerate(texts):
        out.append((i if ids is None else ids[i], text, "en" if i % 3 else None, None if i % 7 == 3 else f"src{(i if sources is None else sources[i]) % 4}", 5, "x", "y", None, 3, "c", "h", None))
    return out


def frame(spark, texts, sources=None, ids=None):
    return spark.createDataFrame(rows(texts, sources, ids), SCHEMA).repartition(3)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90))) for _ in range(n)]
