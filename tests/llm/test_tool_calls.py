import json
import random

import pytest

from starlace.llm.tool_calls import _deep, canonical, link, order, parsed, validate

CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"
SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


@pytest.mark.parametrize("x,text", [
    ({"b": 1, "a": [True, None, 1.0, 1.5, 1e30, 1e-7, "é\n\"\\"]}, '{"a":[true,null,1,1.5,1e+30,1e-7,"é\\n\\"\\\\"],"b":1}'), ({}, "{}"), (0.000001, "0.000001"), (-0.0, "0"), ({"": 1, "😀": 2}, '{"😀":2,"":1}'),
])
def test_canonical(x, text):
    assert canonical(x) == text and json.loads(canonical(x)) == x


def test_validate():
    s = {"type": "object", "properties": {"a": {"type": ["integer", "null"]}, "b": {"enum": [1, "x"]}, "c": {"type": "array", "items": {"type": "string", "pattern": "^z"}, "maxItems": 2}, "d": {"type": "string", "maxLength": 2}, "e": {"const": True}}, "required": ["a"], "additionalProperties": {"type": "boolean"}}
    assert validate({"a": None, "b": "x", "c": ["z"], "d": "ab", "e": True, "o": False}, s) == []
    assert len(validate({"b": True, "c": ["q", 1, "z"], "d": "abc", "e": 1, "o": 1}, s)) == 8
    assert validate([], s) == ["$: not object"]


def test_order_against_brute_force():
    r = random.Random(3)
    for _ in range(100):
        n = r.randint(1, 7)
        calls = [(f"c{k}", r.randint(0, 3), [f"c{r.randint(0, n)}" for _ in range(r.randint(0, 2))]) for k in range(n)]
        got = order(calls)
        done, known = [], {c[0] for c in calls}
        while True:
            free = sorted((t, i) for i, t, d in calls if i not in done and all(x in done or x not in known for x in d))
            if not free:
                break
            done.append(free[0][1])
        assert got == {i: k for k, i in enumerate(done)}


def test_link(spark):
    calls = [
        (1, "a", 1, "f", '{"x": 1}', []), (1, "b", 0, "f", '{"x": -1, "y": 2}', ["a"]), (1, "c", 3, "g", None, ["zz"]), (1, "d", 4, "f", "[1]", ["e"]), (1, "e", 5, "f", "{", ["d", None]), (1, "a", 9, "f", '{"x": 2}', None),
        (None, "a", 0, "f", '{"x": 3}', None), (2, None, 0, "f", '{"x": 1, "x": 2}', None), (3, "a", None, None, None, None),
    ]
    results = [(1, "a", 2, "late"), (1, "a", 1, "soon"), (1, "q", 1, "lost"), (None, "a", 1, None), (2, None, 1, "x")]
    got = {(r.conv_id, r.call_id, r.turn): r for r in link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}
    assert len(got) == 11
    first = got[1, "a", 1]
    assert first.place == 0 and first.problems == ["results repeated"] and json.loads(first.canonical)["result"] == "soon"
    assert got[1, "b", 0].place == 1 and got[1, "b", 0].problems == ["arguments: $.x: out of bounds", "arguments: $.y: not allowed", "no result"]
    assert got[1, "c", 3].place == 2 and set(got[1, "c", 3].problems) == {"arguments: not an object", "unknown tool", "unknown dependency", "no result"}
    assert got[1, "d", 4].place is None and "cycle" in got[1, "d", 4].problems and "arguments: no JSON" in got[1, "e", 5].problems
    assert "id repeated" in got[1, "a", 9].problems and got[1, "a", 9].place is None
    assert got[1, "q", 1].problems == ["no call"] and not got[1, "q", 1].valid
    assert got[None, "a", 0].valid and got[None, "a", 0].place == 0
    assert set(got[2, None, 0].problems) == {"no id", "no result", "arguments: no JSON"} and got[2, None, 1].problems == ["no call"]


@pytest.mark.parametrize("schema,good,bad", [
    (True, [1, None], []), (False, [], [1, {}]), ({"exclusiveMinimum": 3}, [3.5, "a"], [3, 2]), ({"exclusiveMaximum": 3}, [2], [3]), ({"multipleOf": 0.1}, [0.3, 7], [0.35]), ({"multipleOf": 3}, [9, -3, 0], [10]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [1, 7.5], [7, 1.5]), ({"anyOf": [{"type": "string"}, {"type": "null"}]}, ["", None], [1]), ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2], [0, 4]), ({"not": {"type": "object"}}, [[], 1], [{}]),
    ({"$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}}, "additionalProperties": False}}, "$ref": "#/$defs/n"}, [{}, {"next": {"next": {}}}], [{"next": {"x": 1}}, 1]),
    ({"$ref": "#/nowhere"}, [], [1]), ({"$ref": "#"}, [], [1]), ({"allOf": [{"$ref": "#"}]}, [], [1]), ({"$ref": "http://example.org/s"}, [], [1]),
    ({"patternProperties": {"^n": {"type": "integer"}}, "additionalProperties": False}, [{"n1": 1}], [{"n1": "a"}, {"m": 1}]), ({"uniqueItems": True}, [[1, True, "1"]], [[1, 1.0], [{"a": 1}, {"a": 1}]]),
    ({"items": {"enum": [1, True]}}, [[1.0, True]], [["1"], [0]]), ({"prefixItems": [{"type": "string"}], "items": False}, [["a"], []], [[1], ["a", 1]]), ({"contains": {"const": 1}}, [[2, 1]], [[], [2]]),
    ({"propertyNames": {"maxLength": 1}, "minProperties": 1}, [{"a": 1}], [{}, {"ab": 1}]), ({"dependentRequired": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": 2}], [{"a": 1}]), ({"if": {"minimum": 5}, "then": {"multipleOf": 2}, "else": {"multipleOf": 3}}, [6, 3], [7, 4]),
    ({"unheardOf": 1}, [], [1]), ({"pattern": "("}, [1], ["a"]), ({"items": True, "additionalProperties": True}, [[1], {"a": 1}], []), ({"const": {"a": [1]}}, [{"a": [1.0]}], [{"a": [True]}]),
])
def test_keywords(schema, good, bad):
    assert [x for x in good if validate(x, schema)] == [] and [x for x in bad if not validate(x, schema)] == []


def test_parser_of_deep_texts_is_the_usual_one():
    r = random.Random(4)

    def value(depth):
        k = r.randint(0, 7 if depth else 5)
        return [None, True, -1.5e-7, 12, "a\"\\\n,]}é", ""][k] if k < 6 else [value(depth - 1) for _ in range(r.randint(0, 3))] if k == 6 else {f"k{j}:": value(depth - 1) for j in range(r.randint(0, 3))}

    for _ in range(300):
        x = value(4)
        text = json.dumps(x, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        assert _deep(text) == x
        broken = list(text)
        broken[r.randrange(len(broken))] = r.choice('[]{},:"1 x')
        broken = "".join(broken)
        try:
            want = json.loads(broken, object_pairs_hook=lambda p: dict(p) if len(dict(p)) == len(p) else 1 / 0)
        except (ValueError, ZeroDivisionError):
            with pytest.raises(ValueError):
                _deep(broken)
        else:
            assert _deep(broken) == want
    deep = "[" * 100_000 + "]" * 100_000
    assert canonical(parsed(deep)) == deep
    with pytest.raises(ValueError):
        parsed(deep[:-1])


def test_what_once_ended_the_job(spark):
    """Infinite numbers, deep nesting, half pairs, boolean schemas, very long texts, clashing names."""
    node = {"type": "object", "properties": {"next": {"$ref": "#"}}}
    schemas = {"f": {"type": "object"}, "g": {"type": "object", "properties": {"x": True, "y": False}}, "n": node}
    deep = '{"x":' + "[" * 3000 + "]" * 3000 + "}"
    chain = '{"next":' * 5000 + "{}" + "}" * 5000
    some = {"a": ("f", '{"x":1e400}'), "b": ("f", deep), "c": ("f", '{"x":"\\ud800","\\udc00":1}'), "d": ("g", '{"x":1}'), "e": ("g", '{"y":1}'), "h": ("n", chain), "i": ("f", '{"x":' + "9" * 5000 + "}"), "j": ("f", json.dumps({"x": "long text " * 300_000}))}
    calls = spark.createDataFrame([(1, k, n, *some[k], []) for n, k in enumerate(some)], CALLS)
    results = spark.createDataFrame([(1, k, 99, "r") for k in some], RESULTS)
    calls = calls.selectExpr("*", "turn + 1 AS Turn_", "1 AS content", "2 AS results").toDF(*calls.columns, "Turn", "content", "is_call")
    results = results.selectExpr("*", "1 AS t").toDF(*results.columns, "CALL_ID")
    got = {r.call_id: r for r in link(calls, results, schemas).collect()}
    assert len(got) == len(some) and [got[k].turn for k in some] == list(range(len(some)))
    assert got["a"].problems == got["i"].problems == ["arguments: no JSON"] and '"arguments":null' in got["a"].canonical
    assert got["b"].valid and deep in got["b"].canonical and got["h"].valid
    assert got["c"].valid and '{"x":"\\ud800","\\udc00":1}' in got["c"].canonical
    assert got["d"].valid and got["e"].problems == ["arguments: $.y: not allowed"]
    assert got["j"].valid and len(got["j"].canonical) > 3_000_000


def test_without_conversation_or_id(spark):
    calls = [(None, "a", 0, "f", '{"x": 1}', ["b"]), (None, "b", 1, "f", '{"x": 1}', None), (None, None, 2, "f", '{"x": 1}', None)]
    results = [(None, "a", 1, "x"), (1, None, 3, "lone"), (1, None, 4, "lone"), (None, None, 5, None)]
    got = [(r.conv_id, r.call_id, r.turn, r.problems) for r in link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()]
    assert len(got) == 6
    assert (None, "a", 0, ["unknown dependency"]) in got and (None, "b", 1, ["no result"]) in got and (None, None, 2, ["no id", "no result"]) in got
    assert sum(p == ["no call"] for *_, p in got) == 3


def test_empty(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert link(calls, results, SCHEMAS).count() == 0
