"""Any message has a defined result, and linking agrees with a plain version on random conversations."""

import json
import random

import pytest

from stratalex.llm import chat

BAD = [
    {"pattern": "("},
    {"minimum": "3"},
    {"minLength": "1"},
    {"required": 3},
    {"properties": [1]},
    {"type": [{}]},
    {"type": "strange"},
    {"enum": 4},
    {"anyOf": []},
    {"items": 3},
    {"multipleOf": 0},
    {"patternProperties": {"(": True}},
    {"dependencies": {"a": 3}},
    {"maxItems": -1},
    {"$ref": 3},
]


@pytest.mark.parametrize("schema", BAD)
def test_malformed_schema(schema):
    for value in ({"a": 1}, "text", 3, [1], None, 10**399, 2.5):
        assert chat.judge(value, schema) == [f"schema: {next(iter(schema))} is malformed"]
    assert chat.judge({"a": 1}, {"properties": {"a": schema}}) == [f"schema: {next(iter(schema))} is malformed"]


def test_awkward_values():
    assert chat.judge(10**399, {"type": "integer", "minimum": 5, "multipleOf": 10}) == []
    assert chat.judge("a" * 40 + "!", {"pattern": "^(a|a?)+$"}) in (None, ["$: pattern"])
    assert chat.judge({}, 3) == ["schema: not a schema"]
    deep = "[" * 3000 + "]" * 3000
    text = '{"tool_calls": [{"id": "x", "name": "f", "arguments": %s}]}' % deep
    assert chat.parse(text) == {"calls": [], "result_of": None, "tools": [], "content": text}
    assert chat.parse('{"tool_call_id": "\\ud800x", "content": "\\udfff"}')["result_of"] == "�x"
    assert chat.parse('{"tool_call_id": "a", "content": {"n": NaN, "i": 1e999}}')["content"] == '{"i":null,"n":null}'
    for text in ("{", '{"a": %s}' % ("9" * 5000), "{]", '{"tools": 3, "tool_calls": "x"}', "[" * 100_000, '{"tool_calls": [3, {"id": 4}, {"id": "a", "name": 3}]}'):
        assert chat.parse(text)["content"] == text


def say(**x):
    return json.dumps(x)


def test_job_survives(spark):
    rows = [(1, 0, "system", say(tools=[{"name": f"f{i}", "parameters": s} for i, s in enumerate(BAD)]))]
    rows += [(1, 1, "assistant", say(tool_calls=[{"id": f"c{i}", "name": f"f{i}", "arguments": {"n": 10**399}} for i in range(len(BAD))]))]
    rows += [(1, 2, "tool", '{"tool_call_id": "\\ud800", "content": "x"}'), (1, 3, "assistant", '{"tool_calls": [{"id": "\\ud800", "name": "f", "arguments": %s}]}' % ("[" * 5000 + "]" * 5000))]
    rows += [(None, None, None, None), (None, 1, "user", say(tool_calls=[{"id": "c0", "name": "f0", "arguments": {}}])), (None, 2, "tool", say(tool_call_id="c0")), (2, None, "tool", say(tool_call_id="c0")), (2, 5, "user", "x" * 1_000_000)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    calls = next(r for r in got if r.turn == 1 and r.conv_id == 1)
    assert calls.n_calls == calls.n_invalid == len(BAD) and calls.n_linked == 0
    lone = next(r for r in got if r.turn == 1 and r.conv_id is None)
    assert (lone.n_calls, lone.n_linked) == (1, 0) and json.loads(lone.message_json)["tool_calls"][0]["depth"] is None


def plain(rows):
    """conv -> (call -> depth), (conv, turn) -> first later result of each call in it."""
    calls, results = {}, {}
    for conv, turn, _, text in rows:
        m = json.loads(text)
        for c in m.get("tool_calls", []):
            calls.setdefault(conv, []).append((turn, c["id"], c["arguments"]["uses"]))
        if "tool_call_id" in m:
            results.setdefault((conv, m["tool_call_id"]), []).append(turn)
    depth = {}
    for conv, cs in calls.items():
        needs = {}
        for _, i, uses in cs:
            needs.setdefault(i, set()).update(u.split(":")[1] for u in uses)
        needs = {i: {u for u in us if u in needs} for i, us in needs.items()}
        known = {}
        while True:
            new = {i: 1 + max((known[u] for u in us), default=-1) for i, us in needs.items() if i not in known and us <= known.keys()}
            if not new:
                break
            known.update(new)
        depth[conv] = {i: known.get(i) for i in needs}
    links = {(conv, turn, i): min((t for t in results.get((conv, i), []) if t > turn), default=None) for conv, cs in calls.items() for turn, i, _ in cs}
    return depth, links


@pytest.mark.parametrize("gathered", [chat.GATHERED, 0])
def test_random_conversations(spark, monkeypatch, gathered):
    monkeypatch.setattr(chat, "GATHERED", gathered)
    rng, rows = random.Random(7), []
    for conv in range(12):
        n = rng.choice([3, 12, 40])
        for turn in range(n):
            ids = [f"k{rng.randrange(n)}" for _ in range(rng.choice([0, 1, 2]))]
            few = rng.choice([1, 1, 3])
            rows.append((conv, turn, "assistant", say(tool_calls=[{"id": i, "name": "f", "arguments": {"uses": [f"$result:k{rng.randrange(max(1, int(i[1:]))) if rng.random() < 0.97 else rng.randrange(n)}" for _ in range(rng.randrange(few + 1))]}} for i in ids])))
            rows.append((conv, turn, "tool", say(tool_call_id=f"k{rng.randrange(n)}")))
    chain = [{"id": f"k{i}", "name": "f", "arguments": {"uses": [f"$result:k{i - 1}"] if i else []}} for i in range(600)]
    rng.shuffle(chain)
    rows.append((99, 0, "assistant", say(tool_calls=chain)))
    depth, links = plain(rows)
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows) and depth[99]["k599"] == 599 and any(d is None for ds in depth.values() for d in ds.values())
    for r in got:
        calls = json.loads(r.message_json).get("tool_calls", [])
        for c in calls:
            assert c["depth"] == depth[r.conv_id][c["id"]] and c["result_turn"] == links[r.conv_id, r.turn, c["id"]]
        order = [float("inf") if c["depth"] is None else c["depth"] for c in calls]
        assert order == sorted(order) and r.n_linked == sum(c["result_turn"] is not None for c in calls)
