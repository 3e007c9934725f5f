"""Keywords of JSON schemas that judge a call's arguments."""

import json

import pytest

from stratalex.llm import chat

CASES = [
    ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "integer"}}}, 1, "x"),
    ({"definitions": {"t": {"properties": {"next": {"$ref": "#/definitions/t"}}, "required": ["v"]}}, "$ref": "#/definitions/t"}, {"v": 1, "next": {"v": 2}}, {"v": 1, "next": {}}),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 4, 2),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, 4, 6),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, 2, 3),
    ({"not": {"type": "null"}}, 0, None),
    ({"exclusiveMinimum": 0, "exclusiveMaximum": 1}, 0.5, 1),
    ({"multipleOf": 0.1}, 0.3, 0.35),
    ({"uniqueItems": True}, [1, True, "1"], [1, 1.0]),
    ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, {"x1": 1}, {"x1": "a"}),
    ({"minProperties": 1, "maxProperties": 2}, {"a": 1}, {}),
    ({"dependencies": {"a": ["b"]}}, {"a": 1, "b": 2}, {"a": 1}),
    ({"dependentSchemas": {"a": {"required": ["b"]}}}, {"b": 1}, {"a": 1}),
    ({"contains": {"const": 3}}, [1, 3], [1]),
    ({"prefixItems": [{"type": "string"}], "items": False}, ["a"], ["a", 1]),
    ({"if": {"minimum": 5}, "then": {"multipleOf": 5}, "else": {"const": 1}}, 10, 6),
    ({"propertyNames": {"maxLength": 2}}, {"ab": 1}, {"abc": 1}),
]


@pytest.mark.parametrize("schema, good, bad", CASES)
def test_keyword(schema, good, bad):
    assert chat.problems(good, schema) == [] and chat.problems(bad, schema)


@pytest.mark.parametrize("schema", [{"unevaluatedProperties": False}, {"$ref": "http://x/y"}, {"$ref": "#"}, {"properties": {"a": {"strange": 1}}}])
def test_not_judged(schema):
    assert chat.judge({"a": 1}, schema) is None


def test_calls(spark):
    tools = [{"name": n, "parameters": s} for n, s in (("f", {"properties": {"x": {"exclusiveMinimum": 0}}}), ("g", {"unevaluatedProperties": False}))]
    calls = [{"id": n, "name": n, "arguments": {"x": 0}} for n in "fg"]
    rows = [(1, 0, "system", json.dumps({"tools": tools})), (1, 1, "assistant", json.dumps({"tool_calls": calls}))]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("turn = 1").first()
    assert got.n_invalid == 1 and [c["problems"] for c in json.loads(got.message_json)["tool_calls"]] == [["$.x: not over the minimum"], None]


def test_patterns_take_linear_time():
    """A pattern that backtracks for ages elsewhere is judged; what a linear engine lacks is not, whatever the text."""
    assert chat.problems("a" * 50_000 + "b", {"pattern": "^(a+)+$"}) and not chat.problems("a" * 50_000, {"pattern": "^(a+)+$"})
    assert chat.problems("xay", {"pattern": "^a$"})
    for pattern in (r"(a)\1", "(?=a)a", "(?<!b)a"):
        with pytest.raises(chat.NotJudged):
            chat.problems("aa", {"pattern": pattern})
