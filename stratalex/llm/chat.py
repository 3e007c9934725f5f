"""Chat formatting with tool-call linking.

Messages come as rows (conversation, turn, role, text).  A message whose text is a JSON object may carry
    "tool_calls": [{"id": ..., "name": ..., "arguments": {...}}]     (an assistant's calls)
    "tool_call_id": ..., "content": ...                              (a tool's result)
    "tools": [{"name": ..., "parameters": <JSON schema>}]            (what the conversation offers)
and is plain content otherwise.  Calls and results are hash-joined on (conversation, identifier); calls are ordered
topologically (a call comes after those whose results its arguments name as "$result:<identifier>"); arguments are
validated against the schema of their tool; every message is serialised as canonical JSON.

All joins are by conversation and identifier, and the result has a row per message: texts of a conversation are never
gathered.  The identifiers of a conversation with at most GATHERED needs are ordered in one pass in Python; longer ones by
DataFrame rounds (see _long_depths), so no task holds an unbounded group.

No message fails a job: what is not JSON, or nested deeper than DEEPEST, is plain content; lone surrogates are replaced; a
schema with malformed keywords is a problem of the calls that it judges.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.llm.common import discard, materialise, tune, type_of

#: Levels of nesting from which JSON is plain content.
DEEPEST = 100
#: Needs of a conversation that one task orders in memory.
GATHERED = 100_000
_REFERENCE = re.compile(r"\$result:([\w.-]+)")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no white space and no escapes beyond the needed; integral floats are written as integers."""

    def tidy(x):
        if isinstance(x, dict):
            return {str(k): tidy(v) for k, v in x.items()}
        if isinstance(x, list):
            return [tidy(v) for v in x]
        if isinstance(x, float):
            return int(x) if x.is_integer() and abs(x) < 1e15 else x if x == x and abs(x) != float("inf") else None
        return x

    return json.dumps(tidy(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def clean(value, deepest: int = DEEPEST):
    """A JSON value with lone surrogates replaced; ValueError where it is nested deeper than `deepest`."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, (dict, list)):
        if deepest <= 0:
            raise ValueError("nested too deep")
        if isinstance(value, list):
            return [clean(v, deepest - 1) for v in value]
        return {clean(k): clean(v, deepest - 1) for k, v in value.items()}
    return value


class NotJudged(ValueError):
    """The schema has something that is not supported."""


class Malformed(ValueError):
    """A keyword of the schema has a value that it cannot have."""


_JUDGED = set("""type enum const $ref allOf anyOf oneOf not if then else minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength
maxLength pattern minItems maxItems uniqueItems items prefixItems additionalItems contains required properties patternProperties additionalProperties
propertyNames minProperties maxProperties dependencies dependentRequired dependentSchemas""".split())
#: Keywords that allow and forbid nothing.
_NOTES = set("$schema $id $comment $defs definitions title description default examples format deprecated readOnly writeOnly contentEncoding contentMediaType".split())


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _is_names(x) -> bool:
    return isinstance(x, list) and all(isinstance(k, str) for k in x)


def _is_schema(x) -> bool:
    return isinstance(x, (bool, dict))


def _is_pattern(x) -> bool:
    try:
        return isinstance(x, str) and bool(regex.compile(x))
    except regex.error:
        return False


def _is_type(x) -> bool:
    return all(isinstance(k, str) and (k in _TYPES or k in ("number", "integer")) for k in (x if isinstance(x, list) else [x]))


_SCHEMAS = lambda x: isinstance(x, list) and len(x) > 0 and all(map(_is_schema, x))
_BY_NAME = lambda x: isinstance(x, dict) and all(map(_is_schema, x.values()))
_COUNT = lambda x: _is_number(x) and x >= 0 and x == int(x)
#: What a keyword's value must be.
_SHAPES = {
    **dict.fromkeys(("minimum", "maximum"), _is_number),
    **dict.fromkeys(("exclusiveMinimum", "exclusiveMaximum"), lambda x: isinstance(x, bool) or _is_number(x)),
    "multipleOf": lambda x: _is_number(x) and x > 0,
    **dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"), _COUNT),
    "pattern": _is_pattern,
    "type": _is_type,
    "enum": lambda x: isinstance(x, list),
    "$ref": lambda x: isinstance(x, str),
    **dict.fromkeys(("allOf", "anyOf", "oneOf"), _SCHEMAS),
    "prefixItems": lambda x: isinstance(x, list) and all(map(_is_schema, x)),
    **dict.fromkeys(("not", "if", "then", "else", "additionalItems", "contains", "additionalProperties", "propertyNames"), _is_schema),
    "items": lambda x: _is_schema(x) or isinstance(x, list) and all(map(_is_schema, x)),
    "uniqueItems": lambda x: isinstance(x, bool),
    "required": _is_names,
    **dict.fromkeys(("properties", "dependentSchemas"), _BY_NAME),
    "patternProperties": lambda x: _BY_NAME(x) and all(map(_is_pattern, x)),
    "dependentRequired": lambda x: isinstance(x, dict) and all(map(_is_names, x.values())),
    "dependencies": lambda x: isinstance(x, dict) and all(_is_names(v) or _is_schema(v) for v in x.values()),
}


def _found(pattern: str, text: str) -> bool:
    """By an engine of linear time.  What it does not know (references back, looking around, very many repeats) is not
    judged: the pattern alone decides, never the time."""
    try:
        return pc.match_substring_regex(pa.scalar(text), pattern).as_py()
    except pa.ArrowInvalid:
        raise NotJudged(pattern) from None


def _target(root, ref):
    """The part of the schema that a reference names."""
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        raise NotJudged(ref)
    for part in ref.split("/")[1:]:
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        try:
            root = root[int(part)] if isinstance(root, list) else root[part]
        except (KeyError, IndexError, TypeError, ValueError):
            raise NotJudged(ref) from None
    return root


def problems(value, schema, at: str = "$", root=None) -> list[str]:
    """What in the value breaks the schema: the keywords of _JUDGED, with references into the schema (root, if the schema
    is part of another).  Raises NotJudged where it meets a schema with any other keyword but those of _NOTES, and
    Malformed where it meets a keyword whose value makes no sense."""
    if not _is_schema(schema):
        raise Malformed("not a schema")
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed"]
    root = schema if root is None else root
    if not schema.keys() <= _JUDGED | _NOTES:
        raise NotJudged(", ".join(sorted(schema.keys() - _JUDGED - _NOTES)))
    for keyword, fits in _SHAPES.items():
        if keyword in schema and not fits(schema[keyword]):
            raise Malformed(f"{keyword} is malformed")
    wrong = lambda v, s, place=at: problems(v, s, place, root)
    out = []
    number = _is_number(value)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    fits = lambda k: number if k == "number" else number and (isinstance(value, int) or value.is_integer()) if k == "integer" else isinstance(value, _TYPES[k])
    if kinds and not any(map(fits, kinds)):
        return [f"{at}: not of type {'/'.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not one of the values")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the value")
    if "$ref" in schema:
        out += wrong(value, _target(root, schema["$ref"]))
    for s in schema.get("allOf", []):
        out += wrong(value, s)
    if "anyOf" in schema and all([wrong(value, s) for s in schema["anyOf"]]):
        out.append(f"{at}: none of anyOf")
    if "oneOf" in schema and (n := sum(not wrong(value, s) for s in schema["oneOf"])) != 1:
        out.append(f"{at}: {n} of oneOf")
    if "not" in schema and not wrong(value, schema["not"]):
        out.append(f"{at}: not allowed")
    if "if" in schema:
        out += wrong(value, schema.get("else" if wrong(value, schema["if"]) else "then", True))
    if number:
        out += [f"{at}: under the minimum"] * ("minimum" in schema and value < schema["minimum"]) + [f"{at}: over the maximum"] * ("maximum" in schema and value > schema["maximum"])
        low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        if isinstance(low, bool) or isinstance(high, bool):  # of draft 4
            raise NotJudged("exclusiveMinimum, exclusiveMaximum")
        out += [f"{at}: not over the minimum"] * (low is not None and value <= low) + [f"{at}: not under the maximum"] * (high is not None and value >= high)
        if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            out.append(f"{at}: not a multiple")
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
        if "pattern" in schema and not _found(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if isinstance(value, list):
        out += [f"{at}: too few"] * (len(value) < schema.get("minItems", 0)) + [f"{at}: too many"] * (len(value) > schema.get("maxItems", len(value)))
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            out.append(f"{at}: not unique")
        if "contains" in schema and all([wrong(x, schema["contains"]) for x in value]):
            out.append(f"{at}: contains none")
        listed = isinstance(schema.get("items"), list)
        first = schema["items"] if listed else schema.get("prefixItems", [])
        rest = schema.get("additionalItems", True) if listed else schema.get("items", True)
        for i, x in enumerate(value):
            out += wrong(x, first[i] if i < len(first) else rest, f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{at}: too few properties"] * (len(value) < schema.get("minProperties", 0)) + [f"{at}: too many properties"] * (len(value) > schema.get("maxProperties", len(value)))
        for k, x in value.items():
            own = [known[k]] if k in known else []
            own += [s for p, s in schema.get("patternProperties", {}).items() if _found(p, k)]
            for s in own or [schema.get("additionalProperties", True)]:
                out += wrong(x, s, f"{at}.{k}")
            out += wrong(k, schema.get("propertyNames", True), f"{at}.{k}")
        for name in ("dependencies", "dependentRequired", "dependentSchemas"):
            for k, needs in schema.get(name, {}).items():
                if k in value:
                    out += [f"{at}.{x}: missing" for x in needs if x not in value] if isinstance(needs, list) else wrong(value, needs)
    return out


def judge(value, schema) -> list[str] | None:
    """problems(); of a malformed schema that it is; None where they cannot be told."""
    try:
        return problems(value, schema)
    except Malformed as e:
        return [f"schema: {e}"]
    except (NotJudged, RecursionError):
        return None


def parse(text: str | None) -> dict:
    """The calls, the result identifier, the tools and the content of a message."""
    out = {"calls": [], "result_of": None, "tools": [], "content": text or ""}
    if not text or not text.lstrip().startswith("{"):
        return out
    try:
        data = clean(json.loads(text))
    except (ValueError, RecursionError):
        return out
    if not isinstance(data, dict):
        return out
    calls = data.get("tool_calls") if isinstance(data.get("tool_calls"), list) else []
    for c in calls:
        f = c.get("function", c) if isinstance(c, dict) else {}
        if isinstance(c, dict) and isinstance(f, dict) and isinstance(c.get("id"), str) and isinstance(f.get("name"), str):
            args = f.get("arguments", {})
            if isinstance(args, str):
                try:
                    args = clean(json.loads(args))
                except (ValueError, RecursionError):
                    pass
            out["calls"].append({"id": c["id"], "name": f["name"], "arguments": args})
    if isinstance(data.get("tool_call_id"), str):
        out["result_of"] = data["tool_call_id"]
    for t in data.get("tools") if isinstance(data.get("tools"), list) else []:
        f = t.get("function", t) if isinstance(t, dict) else {}
        if isinstance(f, dict) and isinstance(f.get("name"), str):
            out["tools"].append({"name": f["name"], "parameters": f.get("parameters", {})})
    if out["calls"] or out["result_of"] is not None or out["tools"]:
        content = data.get("content", "")
        out["content"] = content if isinstance(content, str) else canonical(content)
    return out


def _parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    key, at = type_of(messages, conv), type_of(messages, turn)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(x) for x in b.column(3).to_pylist()]
            calls = [[(c["id"], c["name"], canonical(c["arguments"]), sorted(set(_REFERENCE.findall(canonical(c["arguments"]))))) for c in g["calls"]] for g in got]
            calls = [[dict(zip(("call_id", "name", "arguments", "needs"), c)) for c in cs] for cs in calls]
            tools = [[{"name": t["name"], "parameters": canonical(t["parameters"])} for t in g["tools"]] for g in got]
            kind = pa.list_(pa.struct([("call_id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([g["content"] for g in got], pa.string()), pa.array([g["result_of"] for g in got], pa.string()), pa.array(calls, kind), pa.array(tools, pa.list_(pa.struct([("name", pa.string()), ("parameters", pa.string())])))],
                names=["conv", "turn", "role", "content", "result_of", "calls", "tools"],
            )

    return messages.select(conv, turn, role, text).mapInArrow(make, f"conv {key}, turn {at}, role string, content string, result_of string, calls array<struct<call_id:string,name:string,arguments:string,needs:array<string>>>, tools array<struct<name:string,parameters:string>>")


_KEY = ["conv", "call_id"]


def _depths(conv: list, of: list[str], need: list[str]) -> tuple[list, list[str], list[int]]:
    """Depths of the calls of whole conversations that have needs or are needed; those on or below a cycle are left out."""
    waits: dict = {}
    users: dict = {}
    for c, a, b in zip(conv, of, need):
        waits[c, a] = waits.get((c, a), 0) + 1
        waits.setdefault((c, b), 0)
        users.setdefault((c, b), []).append((c, a))
    ready = [k for k, n in waits.items() if n == 0]
    depth = dict.fromkeys(ready, 0)
    for k in ready:  # grows while it is read: needs come before their users
        for u in users.get(k, ()):
            depth[u] = max(depth.get(u, 0), depth[k] + 1)
            waits[u] -= 1
            if waits[u] == 0:
                ready.append(u)
    done = [(k, depth[k]) for k in ready]
    return [k[0] for k, _ in done], [k[1] for k, _ in done], [d for _, d in done]


def _short_depths(edges: DataFrame) -> DataFrame:
    """edges(conv, of, need) of conversations with at most GATHERED -> (conv, call_id, depth)."""

    def order(table: pa.Table) -> pa.Table:
        conv, of, depth = _depths(*(table[c].to_pylist() for c in ("conv", "of", "need")))
        return pa.table([pa.array(conv, table.schema.field("conv").type), pa.array(of, pa.string()), pa.array(depth, pa.int32())], names=["conv", "call_id", "depth"])

    return edges.select("conv", "of", "need").groupBy("conv").applyInArrow(order, f"conv {type_of(edges, 'conv')}, call_id string, depth int")


def _long_depths(edges: DataFrame) -> DataFrame:
    """As _short_depths, for conversations of any length.

    A call with one need points to it; pointers double, so all of a chain know its end and their distance from it after
    log2(length) rounds.  The other calls are then settled level by level over these shortcuts; the number of rounds is the
    longest chain of calls with several needs.
    """
    n_needs = edges.groupBy("conv", F.col("of").alias("call_id")).agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("up"))
    n_needs = materialise(n_needs, "needs")
    ptr = materialise(n_needs.filter("n = 1").select(*_KEY, "up", F.lit(1).alias("far")), "pointers")
    rounds = math.ceil(math.log2(max(2, ptr.count()))) + 1
    for _ in range(rounds):
        over = ptr.select("conv", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        nxt = materialise(ptr.join(over, ["conv", "up"], "left").select(*_KEY, F.coalesce("up2", "up").alias("up"), F.least(F.col("far") + F.coalesce("far2", F.lit(0)), F.lit(1 << 29)).alias("far")), "pointers")
        discard(ptr)
        ptr = nxt
    # Whose end still points is on or below a cycle of single needs.
    ends = materialise(ptr.join(ptr.select("conv", F.col("call_id").alias("up")), ["conv", "up"], "left_anti"), "ends")
    several = n_needs.filter("n > 1").select(*_KEY)
    hops = edges.withColumnRenamed("of", "call_id").join(several, _KEY, "left_semi").select(*_KEY, "need")
    end = ends.select("conv", F.col("call_id").alias("need"), F.col("up").alias("end"), "far")
    lost = ptr.join(ends.select(*_KEY), _KEY, "left_anti").select("conv", F.col("call_id").alias("need"))
    stuck = hops.join(lost, ["conv", "need"], "left_semi").select(*_KEY).distinct()
    hops = hops.join(end, ["conv", "need"], "left").select(*_KEY, F.coalesce("end", "need").alias("end"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))
    hops = materialise(hops.groupBy(*_KEY, "end").agg(F.max("far").alias("far")).join(stuck, _KEY, "left_anti"), "hops")
    roots = edges.select("conv", F.col("need").alias("call_id")).distinct().join(n_needs, _KEY, "left_anti")
    done = materialise(roots.select(*_KEY, F.lit(0).alias("depth")), "depths")
    while True:
        known = done.select("conv", F.col("call_id").alias("end"), "depth")
        met = hops.join(done.select(*_KEY), _KEY, "left_anti").join(known, ["conv", "end"], "left")
        ready = met.groupBy(*_KEY).agg(F.max(F.col("depth") + F.col("far")).alias("depth"), F.count(F.when(F.col("depth").isNull(), 1)).alias("open")).filter("open = 0").drop("open")
        ready = materialise(ready, "ready")
        if ready.isEmpty():
            discard(ready)
            break
        grown = materialise(done.unionByName(ready), "depths")
        discard(done, ready)
        done = grown
    single = ends.join(done.select("conv", F.col("call_id").alias("up"), "depth"), ["conv", "up"]).select(*_KEY, (F.col("depth") + F.col("far")).alias("depth"))
    return done.unionByName(single)


def _ranked(calls: DataFrame) -> DataFrame:
    """calls with depth: 0 without needs among the conversation's calls, else one more than the deepest of them; null on a
    cycle or below one, and in a conversation without an identifier."""
    known = materialise(calls.select(*_KEY).distinct(), "known")
    edges = calls.select("conv", F.col("call_id").alias("of"), F.explode("needs").alias("need")).distinct()
    edges = materialise(edges.join(known.withColumnRenamed("call_id", "need"), ["conv", "need"], "left_semi").select("conv", "of", "need"), "needs")
    long_ = materialise(edges.groupBy("conv").count().filter(F.col("count") > GATHERED).select("conv"), "long")
    depths = _short_depths(edges.join(long_, "conv", "left_anti"))
    if not long_.isEmpty():
        depths = depths.unionByName(_long_depths(materialise(edges.join(long_, "conv", "left_semi"), "needs")))
    waiting = edges.select("conv", F.col("of").alias("call_id")).distinct().withColumn("waits", F.lit(True))
    out = calls.join(depths, _KEY, "left").join(waiting, _KEY, "left")
    depth = F.when(F.col("conv").isNull(), None).otherwise(F.coalesce("depth", F.when(F.col("waits").isNull(), 0)))
    return out.withColumn("depth", depth).drop("waits")


def _links(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(row, place, result_turn): the first turn after a call at which a result bears its identifier.  Calls and results of
    an identifier are read once from the last turn on, so that many of either do not multiply."""
    nothing = F.lit(None)
    asked = calls.select(*_KEY, "turn", F.lit(0).alias("kind"), "row", "place", nothing.cast(type_of(results, "result_turn")).alias("result_turn"))
    given = results.select(*_KEY, F.col("result_turn").alias("turn"), F.lit(1).alias("kind"), nothing.cast("long").alias("row"), nothing.cast("int").alias("place"), "result_turn")
    from_last = W.partitionBy(*_KEY).orderBy(F.desc("turn"), "kind").rowsBetween(W.unboundedPreceding, 0)
    both = asked.unionByName(given).filter("conv is not null and turn is not null")
    return both.withColumn("result_turn", F.min("result_turn").over(from_last)).filter("kind = 0 and result_turn is not null").select("row", "place", "result_turn")


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row of messages: conversation, turn, role, n_calls, n_linked, n_invalid, orphan_result, message_json.

    message_json is canonical JSON with content, role and turn, and where they occur tool_calls (in topological order:
    depth, then place; each with arguments, depth, id, name, problems and the turn of its first result, null without one)
    and tool_call_id.  A call links to the first result of its identifier at a later turn; of calls that share an
    identifier, each links on its own.  Calls of unknown tools, or whose schema has keywords that are not
    supported, are not judged (problems null); calls on a cycle have depth null
    and come last.  A null text is empty content, a null role is null.  Messages that repeat conversation and turn are
    told apart by order alone and each get a row.  Texts that are not such JSON are content as they are.  An empty table
    gives an empty result; other columns are ignored.
    """
    tune(messages.sparkSession)
    rows = materialise(_parsed(messages, conv, turn, role, text).withColumn("row", F.monotonically_increasing_id()), "messages")
    calls = rows.select("conv", "turn", "row", F.posexplode("calls").alias("place", "c")).select("conv", "turn", "row", "place", "c.*")
    calls = materialise(calls, "calls")  # read several times
    ranked = _ranked(calls)
    results = rows.filter(F.col("result_of").isNotNull()).select("conv", F.col("result_of").alias("call_id"), F.col("turn").alias("result_turn"))
    linked = _links(calls, results)
    tools = rows.select("conv", F.explode("tools").alias("t")).groupBy("conv", F.col("t.name").alias("name")).agg(F.max("t.parameters").alias("parameters"))
    full = ranked.join(linked, ["row", "place"], "left").join(tools, ["conv", "name"], "left")
    call = F.struct(F.coalesce("depth", F.lit(2**31 - 1)).alias("order"), "place", "depth", "call_id", "name", "arguments", "result_turn", "parameters")
    by_row = full.groupBy("row").agg(F.sort_array(F.collect_list(call)).alias("linked"))  # the calls of one message
    orphans = rows.filter(F.col("result_of").isNotNull()).select("row", "conv", F.col("result_of").alias("call_id")).join(calls.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti").select("row", F.lit(True).alias("orphan"))
    out = rows.join(by_row, "row", "left").join(orphans, "row", "left").select("conv", "turn", "role", "content", "result_of", "linked", "orphan")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, said, columns = [], [], b.to_pydict()
            for at, who, content, of, linked in zip(columns["turn"], columns["role"], columns["content"], columns["result_of"], columns["linked"]):
                message, bad = {"content": content, "role": who, "turn": at}, 0
                if of is not None:
                    message["tool_call_id"] = of
                for c in linked or ():
                    wrong = None if c["parameters"] is None else judge(json.loads(c["arguments"]), json.loads(c["parameters"]))
                    bad += bool(wrong)
                    message.setdefault("tool_calls", []).append({"arguments": json.loads(c["arguments"]), "depth": c["depth"], "id": c["call_id"], "name": c["name"], "problems": wrong, "result_turn": c["result_turn"]})
                n.append((len(linked or ()), sum(c["result_turn"] is not None for c in linked or ()), bad))
                said.append(canonical(message))
            counts = [pa.array([x[k] for x in n], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *counts, pa.array([bool(x) for x in columns["orphan"]], pa.bool_()), pa.array(said, pa.string())], names=[conv, turn, role, "n_calls", "n_linked", "n_invalid", "orphan_result", "message_json"])

    return out.mapInArrow(make, f"`{conv}` {type_of(messages, conv)}, `{turn}` {type_of(messages, turn)}, `{role}` string, n_calls long, n_linked long, n_invalid long, orphan_result boolean, message_json string")
