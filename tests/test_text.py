"""Scalar functions against values worked out by hand, and against plain Python for random input."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalex.functions import similarity as sim
from stratalex.functions import text as t


def each(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_stem(spark):
    words = ["berries", "boxes", "glasses", "dishes", "machines", "gas", "glass", "cases", "pies", "shoes", "this"]
    assert each(spark, words, t.stem) == ["berry", "box", "glass", "dish", "machine", "gas", "glass", "cas", "pie", "sho", "thi"]


def tokens(text, pack=False):
    """Word by word, with a flag for a pending negation."""
    words, out, skip = re.findall("[a-z0-9]+", text.lower()), [], False
    for i, w in enumerate(words):
        if w in t.NEGATORS and not (w == "not" and words[max(0, i - 2) : i] == ["whether", "or"]):
            skip = True
        elif skip:
            skip = False
        elif not w.isdigit() and len(w) >= 3:
            s = stem(w)
            if len(s) >= 3 and s not in t.STOPWORDS and not (pack and s in t.PACK_WORDS):
                out.append(s)
    return out


def stem(w):
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 4 and re.search("([sxz]es|ches|shes|oes)$", w):
        return w[:-2]
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("whether or not non without excluding roasted coffee beans boxes 12 ab tins the steel".split()), max_size=9).map(" ".join), min_size=20, max_size=60))
def test_tokenize_like_a_loop(spark, texts):
    assert each(spark, texts, t.tokenize) == [tokens(x) for x in texts]
    assert each(spark, texts, lambda c: t.tokenize(c, True)) == [tokens(x, True) for x in texts]


def test_negation_and_null(spark):
    got = each(spark, ["Coffee, not roasted", "whether or not roasted", "non-refractory bricks", None, ""], t.tokenize)
    assert got == [["coffee"], ["roasted"], ["brick"], [], []]


def test_codes(spark):
    assert each(spark, ["321410", "3214.10.00", "3214.1", "", None], t.format_code) == ["3214.10.00", "3214.10.00", None, None, None]
    assert each(spark, ["3214", "101", "3214.10.00"], t.format_heading) == ["32.14", "01.01", "32.14"]
    texts = ["1  3214.90", "x 3506-10-00 y", "2715.00", "9901.10", "A3214.90", "3214.901", "0000.12 then 3403.19.10", None]
    assert each(spark, texts, t.find_code) == ["3214.90.00", "3506.10.00", None, None, None, None, "3403.19.10", None]
    assert each(spark, ['1 "', "ditto", "''", "3214.90 \"", "none", None], t.noted_code) == ['"', '"', '"', "3214.90.00", None, None]


def test_numbers(spark):
    assert each(spark, ["5", "1,000", "1,5", "1,234.5", "2.50", "x", "", None, "1 000"], t.number) == [5.0, 1000.0, 1.5, 1234.5, 2.5, None, None, None, 1000.0]
    assert each(spark, ["750g", "25 kg drum", "1,500 g", "20 mg", "5L", "3 kilograms", None], t.mass_kg) == [0.75, 25.0, 0.0015, 0.00002, None, 3.0, None]


def test_wording(spark):
    assert each(spark, ["2026-08-28", "", "soon", None], t.schedule_date) == ["28 August 2026", "the current SARS Schedule 1 Part 1", "soon", "the current SARS Schedule 1 Part 1"]
    assert each(spark, ["one two three", "one  two"], lambda c: t.clip(c, 10)) == ["one two…", "one two"]
    assert each(spark, ["abcdefghijk", "abc"], lambda c: t.clip_mid_word(c, 5)) == ["abcd…", "abc"]
    assert each(spark, ["done", "done!", " "], t.sentence) == ["done.", "done!", ""]
    assert each(spark, ["_ 12 A1 éclair Sealing 5 -", "--", "AB12 AC730 Paint"], t.tidy_description) == ["éclair Sealing 5", "", "Paint"]


def test_parts(spark):
    got = each(spark, ["BK210 Frame", "HOSE -REEL large", "kg 5", "tin can", "B-", ""], lambda c: t.take_part(t.words_of(c)))
    assert [(g.part, g.rest) for g in got] == [("BK210", ["Frame"]), ("HOSE-REEL", ["large"]), (None, ["kg", "5"]), (None, ["tin", "can"]), ("B-", []), (None, [])]


def test_nearest(spark):
    assert [sorted(x) for x in each(spark, ["Engines | Of steel parts | Other", "Other", None], t.nearest_tokens)] == [["part", "steel"], [], []]


def test_similarity():
    assert sim.token_set_ratio("b a", "a b c") == 100.0
    assert sim.token_set_ratio("", "x") == 0.0
    assert round(sim.indel_ratio("kitten", "sitting"), 4) == round(200 * 4 / 13, 4)
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "agreed": "agre", "happy": "happi", "generalization": "gener", "adjustable": "adjust", "controlling": "control"}
    assert {w: sim.porter(w) for w in words} == words


def test_ratios_of_a_batch():
    """Pairs in blocks give what each gives alone: no letters, letters beyond a word of bits, repeats, nothing shared."""
    import random

    from stratalex.functions import similarity

    rng = random.Random(1)
    words = ["bolt", "steel", "hex", "ünï", "漢字", "nut", "of", "m8", "x" * 70, "a long word", ""]
    said = [None, "", " ", *(" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(700))]
    left, right = (rng.sample(said, len(said)) for _ in "ab")
    assert similarity.token_set_ratios(left, right).tolist() == [similarity.token_set_ratio(a, b) for a, b in zip(left, right)]
    left, right = (["".join(rng.choice("ab c") for _ in range(rng.randrange(200))) for _ in range(700)] for _ in "ab")
    assert similarity.indel_ratios(left, right).tolist() == [similarity.indel_ratio(a, b) for a, b in zip(left, right)]
    assert similarity.token_set_ratios([], []).tolist() == []
