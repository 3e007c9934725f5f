"""BPE, HTML, mixing, fingerprints, quality and chats against plain versions."""

import hashlib
import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalex.llm import bpe, chat, html_extract, minhash, mixing, quality
from stratalex.llm.queries import vocabulary_path

from .helpers import frame, prose

BPE = ["Hello  world's, it's 42\n\n\nok", "", None, "<|endoftext|> a<|endoftext|>", "Ünïcödé ß Привет 你好 😀 ͸  x　y", "a" * 3000, "\x00\x1c\x85", " lead", "tail ", "repeat", "repeat"] + prose(5, 20)


def test_bpe(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CHUNK_CHARS", 300)
    path = vocabulary_path()
    model = Tokenizer.from_file(path)
    got = bpe.encode_decode(frame(spark, BPE, ids=[None, *range(1, len(BPE))]), path).collect()
    assert len(got) == len(BPE)
    for r in got:
        text = BPE[r.doc_id or 0] or ""
        ids = model.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == model.decode(ids, skip_special_tokens=False) == text
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(frame(spark, ["x"]).limit(0), path).count() == 0


def test_word_table(spark, monkeypatch):
    """Each distinct word is one row, with the library's ids; parts and buckets of any number agree."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    monkeypatch.setattr(bpe, "PART_TASKS", 1)
    path = vocabulary_path()
    model = Tokenizer.from_file(path)
    got = bpe.word_table(frame(spark, BPE), path).collect()
    splitter = bpe.Splitter(bpe.Vocabulary(path).source, ["<|endoftext|>"])
    assert sorted(r.word for r in got) == sorted({w for t in BPE for w in splitter.words(t or "")})
    assert all(r.ids == model.encode(r.word, add_special_tokens=False).ids for r in got)


def test_batches_are_bounded_by_bytes(spark):
    from stratalex.llm.common import BATCH_BYTES, tune

    tune(spark)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["n", "rows"]) for b in batches)
    long = spark.createDataFrame([("x" * 1_000_000,)] * 12, "text string").coalesce(1)
    got = long.mapInArrow(sizes, "n long, rows long").collect()
    assert sum(r.rows for r in got) == 12 and max(r.n for r in got) <= BATCH_BYTES + 1_100_000


def test_splitter_on_every_character():
    from tokenizers import Tokenizer

    with open(vocabulary_path()) as f:
        source = f.read()
    own, library = bpe.Splitter(source, ["<|endoftext|>"]), Tokenizer.from_str(source).pre_tokenizer
    for c in [*range(0, 0x3200), *range(0x3200, 0xD800, 5), *range(0xE000, 0x20000, 7), 0x10FFFF]:
        s = f"a{chr(c)}1 {chr(c)} {chr(c)}"
        assert own.plain(s) == [s[a:b] for _, (a, b) in library.pre_tokenize_str(s)], hex(c)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href='/b>'>News</a></ul></nav><!-- ad --><div class="cookie-notice">We use cookies on this site.</div><header>Site name and slogan.</header>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>text of the article,\n long   enough to read.<br>Next&nbsp;line &lt;here&gt;.<p>Second paragraph of the article without end tag
<div class="ad">Buy this now, it is a very good thing indeed.</div><figure><figcaption>A caption.</figcaption></figure><form><label>Your name</label><input></form>
<p>Short.</p><ul><li>Point one of the list.</li><li>Point two.</li></ul></article>
<section id="comments"><h2>Comments</h2><p>I liked this article very much, it was a good read.</p></section>
<aside><p>Related stories that you may like as well, with long text.</p></aside><footer>&copy; site</footer></body></html>"""


def test_extract():
    assert html_extract.extract(PAGE) == "Title & more First boldtext of the article, long enough to read. Next line <here>. Second paragraph of the article without end tag A caption. Short. Point one of the list. Point two."
    for odd in (None, "", "<", "<p", "</p></p>", "<!-- never closed", "<script>x", "<article>", "&#x;&bogus;<b", "<div>" * 3000 + "deep", "<p>" + "word " * 50000):
        assert isinstance(html_extract.extract(odd), str)
    assert html_extract.extract("<main><p>Only this is content here.</p></main><div role='navigation'>Go away from here now.</div>") == "Only this is content here."
    wrapped = "<form id='aspnet'><div class='menu'>Home page of us.</div><article><div class='article-header'><h1>A title</h1></div><p>The text goes here, some words.</p><div class='comment-body'>I like it a lot, thanks.</div></article></form>"
    assert html_extract.extract(wrapped) == "A title The text goes here, some words."


def test_min_cut():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda x: sum(max(z, 0) * (not k) + max(-z, 0) * k for z, k in zip(odds, x)) + sum(w for a, b, w in ties if x[a] != x[b])  # noqa: B023, E731
        assert math.isclose(cost(html_extract.min_cut(odds, ties)), min(map(cost, itertools.product([False, True], repeat=n))), abs_tol=1e-6)


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "v", "", "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(html_extract.extract(PAGE))] + [len(html_extract.extract(PAGE))]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """sizes by source -> targets, by resharing what is above the cap until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


@pytest.mark.parametrize("hot", [0, 120])
def test_mixing(spark, hot):
    texts = prose(6, 160) + [None, "", "  "] + ["tiny"] * 3 + prose(7, hot)
    sources = [i % 11 for i in range(166)] + [1] * hot
    docs = frame(spark, texts, sources)
    got = mixing.mix(docs).withColumn("x", F.col("doc_id")).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == len(texts)
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert all(r.size == size[r.doc_id] and r.taken == r.size * r.copies <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r.size
    want = plain_targets(by)
    for s in by:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == by[s] and math.isclose(r.target, want[s], rel_tol=1e-9) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.02 * want[s] + 30
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    taken = mixing.take(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {r.doc_id: r.copies for r in got if r.copies}


def test_mixing_repeats_and_empty(spark):
    docs = frame(spark, ["a b c"] * 4 + ["d e"], ids=[1, 1, 1, None, None])
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and mixing.take(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = prose(8, 40) + [None, "", "one", "éé " * 900, "same words here again and again", "same words here again and again"]
    texts[0] = texts[0].upper()
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in minhash.fingerprint_chain(docs).collect()}
    assert len(got) == len(texts)
    whole = [t or "" for t in texts]
    for i, a in enumerate(whole):
        b, n = whole[(i + 1) % len(whole)], len(a) // 4
        e = a[: len(a) - n] + b[:n]
        fa, fe, fb = minhash.fingerprint(a), minhash.fingerprint(e), minhash.fingerprint(b)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(a), hashlib.sha256(e.encode()).hexdigest(), fa.hex(), fe.hex())
        assert r.near_edited == minhash.likeness(fa, fe) and r.near_next == minhash.likeness(fa, fb)
    assert minhash.fingerprint_chain(docs.limit(0)).count() == 0
    (one,) = minhash.fingerprint_chain(frame(spark, ["only one row of text here ok"])).collect()
    assert one.near_next == 1.0
    assert minhash.fingerprint_chain(frame(spark, ["a", "b", "b"], ids=[None, None, None])).count() == 3


def test_likeness_estimates_jaccard():
    import random

    rng = random.Random(2)
    for share in (0.2, 0.5, 0.8, 0.95):
        a = [f"w{rng.random()}" for _ in range(400)]
        b = a[: int(400 * share)] + [f"v{rng.random()}" for _ in range(400 - int(400 * share))]
        sa, sb = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        j = len(sa & sb) / len(sa | sb)
        assert abs(minhash.likeness(minhash.fingerprint(" ".join(a)), minhash.fingerprint(" ".join(b))) - j) < 0.15


def test_minhash_near_duplicates(spark):
    base = prose(9, 30)
    texts = base + [t + " more" for t in base if len(t.split()) > 40] + base[:3] + [None, ""]
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_quality(spark):
    good, bad = prose(10, 300), [" ".join(f"{w}%%%" for w in t.split()) for t in prose(11, 60)]
    toxic = [" ".join([*t.split()[:4], ("vile", "awful")[i % 2], *t.split()[4:]]) for i, t in enumerate(prose(10, 360)[300:])]
    texts = good + bad + toxic + [None, ""]
    labels = [(i, 1, 0) for i in range(0, 300, 2)] + [(300 + i, 0, 0) for i in range(0, 60, 2)] + [(360 + i, 1, 1) for i in range(0, 60, 3)] + [(None, 1, 1), (9999, 1, 1), (2, None, None), (0, 1, 0)]
    docs = frame(spark, texts)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.select_documents(docs, lab).collect()
    kept = {r.doc_id for r in got}
    held = lambda a, b, step: [i for i in range(a, b) if (i - a) % step]
    share = lambda ids: sum(i in kept for i in ids) / len(ids)
    assert share(held(0, 300, 2)) > 0.95 and share(held(300, 360, 2)) < 0.1 and share(held(360, 420, 3)) < 0.15
    assert all(r.tail_probability <= r.expected_grade <= 2 for r in got)
    assert quality.select_documents(docs, lab.limit(0)).count() == len(texts)
    clash = quality.select_documents(docs.withColumn("expected_grade", F.lit("x")), lab.limit(0))
    assert dict(clash.dtypes)["expected_grade"] == "double" and quality.select_documents(docs.limit(0), lab).count() == 0


CALL = {"tool_calls": [{"id": "b", "name": "sum", "arguments": {"y": "$result:a", "x": 2.0}}, {"id": "a", "name": "get", "arguments": '{"k": "é"}'}, {"id": "z", "name": "sum", "arguments": {"x": "no"}}], "content": "working"}
TOOLS = {"tools": [{"name": "sum", "parameters": {"type": "object", "properties": {"x": {"type": "number"}}, "required": ["x"]}}]}


def test_chat(spark):
    rows = [
        (1, 0, "system", json.dumps(TOOLS), "x"),
        (1, 1, "user", "hi \"there\"\n", "x"),
        (1, 2, "assistant", json.dumps(CALL), "x"),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": {"v": 1.0}}), "x"),
        (1, 4, "tool", json.dumps({"tool_call_id": "b", "content": "ok"}), "x"),
        (1, 5, "tool", json.dumps({"tool_call_id": "b", "content": "late"}), "x"),
        (1, 6, "tool", json.dumps({"tool_call_id": "q", "content": "?"}), "x"),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "c", "name": "f", "arguments": {"p": "$result:d"}}, {"id": "d", "name": "f", "arguments": {"p": "$result:c"}}]}), "x"),
        (2, 1, "user", '{"not": "a call"}', "x"),
        (2, 2, "user", "{broken", "x"),
        (None, None, None, None, "x"),
        (3, 0, "user", "same", "x"),
        (3, 0, "user", "same", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, calls string")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    call = json.loads(by[1, 2].message_json)
    assert [c["id"] for c in call["tool_calls"]] == ["a", "z", "b"] and [c["depth"] for c in call["tool_calls"]] == [0, 0, 1]
    assert [c["result_turn"] for c in call["tool_calls"]] == [3, None, 4] and [c["problems"] for c in call["tool_calls"]] == [None, ["$.x: not of type number"], []]
    assert (by[1, 2].n_calls, by[1, 2].n_linked, by[1, 2].n_invalid) == (3, 2, 1) and call["tool_calls"][2]["arguments"] == {"x": 2, "y": "$result:a"}
    assert by[1, 1].message_json == '{"content":"hi \\"there\\"\\n","role":"user","turn":1}'
    assert by[1, 3].message_json == '{"content":"{\\"v\\":1}","role":"tool","tool_call_id":"a","turn":3}'
    assert by[1, 6].orphan_result and not by[1, 3].orphan_result
    assert [c["depth"] for c in json.loads(by[2, 0].message_json)["tool_calls"]] == [None, None]
    assert json.loads(by[2, 1].message_json)["content"] == '{"not": "a call"}' and by[None, None].message_json == '{"content":"","role":null,"turn":null}'
    assert chat.format_chats(df.limit(0)).count() == 0


def test_schema_problems():
    p = chat.problems
    assert p(3, {"type": "integer", "maximum": 2}) == ["$: over the maximum"] and p(True, {"type": "integer"}) and not p(3.0, {"type": "integer"})
    assert p({"a": [1, "x"]}, {"properties": {"a": {"type": "array", "items": {"type": "number"}}}, "additionalProperties": False}) == ["$.a[1]: not of type number"]
    assert p({"b": 1}, {"additionalProperties": False}) == ["$.b: nothing is allowed"] and p("abc", {"pattern": "^z", "minLength": 4}) == ["$: too short", "$: pattern"]
