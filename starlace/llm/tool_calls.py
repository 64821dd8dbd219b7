"""Tool calls linked to their results.

Calls and results are hash-joined by conversation and call id. Within a conversation the calls
are put in topological order of what they depend on (of those that are free, the earliest turn
first, then the least id). Arguments are validated against the tool's schema, and each call is
serialised as canonical JSON: keys sorted, no white space, numbers in their shortest form,
strings as they are, but for halves of surrogate pairs, which are escaped.

Schemas are JSON Schema without remote references: ``validate`` names the keywords. One that it
doesn't know, a reference that leads nowhere and a pattern that can't be read are problems of the
call, so nothing is passed as valid that wasn't looked at.

Defined results, each in ``problems``, sorted: a call without a result is "no result"; a result
without a call is a row of its own, "no call"; of several results the first by turn counts, and
"results repeated" says so; of several calls with one id the first by turn counts, the others
are "id repeated" and have no place in the order; a dependence on an unknown id is "unknown
dependency" and doesn't hold the call back; calls in or behind a cycle are "cycle", without a
place. Null, broken or non-object arguments are "arguments: ..." problems, and are serialised
as null, and so are numbers beyond what a double or 4,300 digits hold ("arguments: no JSON");
nesting may be of any depth. A tool without a schema is "unknown tool". Rows without a
conversation hang together only where their call ids are equal. A null call id links to nothing
and is "no id"; results without an id are "no call", a row each. Texts are whole, of any length;
empty tables give empty results. Columns other than those named are dropped, whatever their names;
of columns with one name the first is read.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import picked

OUT = "conv_id bigint, call_id string, turn bigint, place bigint, valid boolean, problems array<string>, canonical string"
_HALF = re.compile("[\ud800-\udfff]")


def _whole(text: str) -> str:
    """Text that can be encoded: halves of surrogate pairs are escaped."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _string(x: str) -> str:
    return _whole(json.dumps(x, ensure_ascii=False))


def _scalar(x) -> str:
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, str):
        return _string(x)
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    mantissa, _, exponent = text.partition("e")
    if not exponent:
        return text
    power = int(exponent)
    if -7 < power < 0:
        return f"{x:.{len(mantissa.replace('.', '').lstrip('-')) - 1 - power}f}"
    return f"{mantissa}e{'+' if power > 0 else '-'}{abs(power)}"


def canonical(x) -> str:
    """Canonical JSON text."""
    out, todo = [], [x]
    while todo:  # values, and in tuples what stands between them
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, list):
            todo.append(("]",))
            for k in range(len(x) - 1, -1, -1):
                todo += [x[k], (",",)] if k else [x[k]]
            out.append("[")
        elif isinstance(x, dict):
            todo.append(("}",))
            keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
            for k in range(len(keys) - 1, -1, -1):
                todo += [x[keys[k]], (("," if k else "") + _string(keys[k]) + ":",)]
            out.append("{")
        else:
            out.append(_scalar(x))
    return "".join(out)


def _strict(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key twice")
    return out


def _no(_: str):
    raise ValueError("not a JSON number")


def _float(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError("beyond a double")
    return x


_HOW = {"object_pairs_hook": _strict, "parse_constant": _no, "parse_float": _float}
_MARK = re.compile(r"[ \t\n\r]*([\[\]{},:]|\"(?:[^\"\\]|\\.)*\"|[^\s\[\]{},:\"]+)", re.S)


def parsed(text: str):
    """The value of a JSON text; ValueError where it is none."""
    try:
        return json.loads(text, **_HOW)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    """As json.loads, by a stack of its own."""
    root: list = []
    stack: list[tuple[list | dict | None, list]] = [(None, root)]  # (what it is, its parts so far)
    wants, at = "value", 0  # or "first" (or its end), "key", "first key", "colon", "next"
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _MARK.match(text, at)
        if not m:
            raise ValueError("no JSON")
        mark, at = m[1], m.end()
        kind, parts = stack[-1]
        if mark in "]}":
            if kind is None or (mark == "]") != isinstance(kind, list) or wants not in ("next", "first", "first key"):
                raise ValueError("no JSON")
            stack.pop()
            stack[-1][1].append(parts if mark == "]" else _strict(list(zip(parts[::2], parts[1::2]))))
            wants = "next"
        elif mark == ",":
            if wants != "next" or kind is None:
                raise ValueError("no JSON")
            wants = "value" if isinstance(kind, list) else "key"
        elif mark == ":":
            if wants != "colon":
                raise ValueError("no JSON")
            wants = "value"
        elif wants in ("key", "first key"):
            if mark[0] != '"':
                raise ValueError("no JSON")
            parts.append(json.loads(mark))
            wants = "colon"
        elif wants in ("value", "first"):
            if mark == "[":
                stack.append(([], []))
                wants = "first"
            elif mark == "{":
                stack.append(({}, []))
                wants = "first key"
            else:
                parts.append(json.loads(mark, **_HOW))
                wants = "next"
        else:
            raise ValueError("no JSON")
    if len(stack) > 1 or len(root) != 1:
        raise ValueError("no JSON")
    return root[0]


_KINDS = {
    "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list), "string": lambda x: isinstance(x, str), "boolean": lambda x: isinstance(x, bool), "null": lambda x: x is None,
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(), "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
}
_KNOWN = frozenset(
    "type enum const properties required additionalProperties patternProperties propertyNames minProperties maxProperties dependentRequired dependentSchemas items prefixItems additionalItems contains minContains maxContains "
    "minItems maxItems uniqueItems minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf allOf anyOf oneOf not if then else $ref "
    # of no effect on what is valid
    "$defs definitions $schema $id $comment title description default examples deprecated readOnly writeOnly format contentEncoding contentMediaType".split()
)


def _run(first: Generator) -> list[str]:
    """Generators that yield the ones they wait for: calls of any depth."""
    stack, value = [first], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def validate(x, schema: dict | bool, at: str = "$") -> list[str]:
    """What in x breaks the schema. Known are the keywords of _KNOWN, $ref within the schema, and
    true and false as schemas; any other keyword is a problem of its own."""
    return _run(_check(x, schema, schema, at, ()))


def _target(root, ref: str):
    """The part of the schema that a reference names; KeyError where there is none."""
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        raise KeyError(ref)
    for step in ref.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        root = root[int(step)] if isinstance(root, list) and step.isdigit() and int(step) < len(root) else root[step] if isinstance(root, dict) else {}[step]
    return root


def _multiple(x, step) -> bool:
    from fractions import Fraction

    return bool(step) and (Fraction(repr(x) if isinstance(x, float) else x) / Fraction(repr(step) if isinstance(step, float) else step)).denominator == 1


def _check(x, schema, root, at: str, refs: tuple) -> Generator:
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return [f"{at}: the schema is neither an object nor a boolean"]
    out = [f"{at}: keyword {k} isn't known" for k in schema if k not in _KNOWN]
    if "$ref" in schema:
        ref = schema["$ref"]
        try:
            aim = _target(root, ref)
        except KeyError:
            aim, out = True, [*out, f"{at}: reference {ref} leads nowhere"]
        if (ref, at) in refs:
            return [*out, f"{at}: reference {ref} leads to itself"]
        out += yield _check(x, aim, root, at, (*(r for r in refs if r[1] == at), (ref, at)))
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds is not None and not any(k in _KINDS and _KINDS[k](x) for k in kinds):
        return [*out, f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and canonical(x) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in the enumeration")
    if "const" in schema and canonical(x) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    for k, v in enumerate(schema.get("allOf", ())):
        out += yield _check(x, v, root, at, refs)
    for word in ("anyOf", "oneOf"):
        if word in schema:
            fit = 0
            for v in schema[word]:
                fit += not (yield _check(x, v, root, at, refs))
            if not fit or word == "oneOf" and fit > 1:
                out.append(f"{at}: fits {fit or 'none'} of {word}")
    if "not" in schema and not (yield _check(x, schema["not"], root, at, refs)):
        out.append(f"{at}: fits what it must not")
    if "if" in schema:
        fits = not (yield _check(x, schema["if"], root, at, refs))
        out += yield _check(x, schema.get("then" if fits else "else", True), root, at, refs)
    if isinstance(x, dict):
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in x]
        out += [f"{at}.{k}: missing beside {have}" for have, some in schema.get("dependentRequired", {}).items() if have in x for k in some if k not in x]
        for have, v in schema.get("dependentSchemas", {}).items():
            if have in x:
                out += yield _check(x, v, root, at, refs)
        if not schema.get("minProperties", 0) <= len(x) <= schema.get("maxProperties", math.inf):
            out.append(f"{at}: wrong number of properties")
        for k in sorted(x):
            if "propertyNames" in schema and (yield _check(k, schema["propertyNames"], root, at, refs)):
                out.append(f"{at}.{k}: wrong name")
            fit = k in known
            if fit:
                out += yield _check(x[k], known[k], root, f"{at}.{k}", refs)
            for pattern, v in schema.get("patternProperties", {}).items():
                found, wrong = _found(pattern, k, at)
                out += wrong
                if found:
                    fit = True
                    out += yield _check(x[k], v, root, f"{at}.{k}", refs)
            if not fit and rest is not True:
                out += yield _check(x[k], rest, root, f"{at}.{k}", refs)
    elif isinstance(x, list):
        if not schema.get("minItems", 0) <= len(x) <= schema.get("maxItems", math.inf):
            out.append(f"{at}: wrong number of items")
        if schema.get("uniqueItems") is True and len(set(map(canonical, x))) < len(x):
            out.append(f"{at}: an item twice")
        rest = schema.get("items", True)
        first, rest = (rest, schema.get("additionalItems", True)) if isinstance(rest, list) else (schema.get("prefixItems", ()), rest)
        for k, v in enumerate(x):
            if k < len(first):
                out += yield _check(v, first[k], root, f"{at}[{k}]", refs)
            elif rest is not True:
                out += yield _check(v, rest, root, f"{at}[{k}]", refs)
        if "contains" in schema:
            fit = 0
            for v in x:
                fit += not (yield _check(v, schema["contains"], root, at, refs))
            if not schema.get("minContains", 1) <= fit <= schema.get("maxContains", math.inf):
                out.append(f"{at}: contains {fit} of what it should")
    elif isinstance(x, str):
        if not schema.get("minLength", 0) <= len(x) <= schema.get("maxLength", math.inf):
            out.append(f"{at}: wrong length")
        if "pattern" in schema:
            found, wrong = _found(schema["pattern"], x, at)
            out += wrong
            if not found and not wrong:
                out.append(f"{at}: doesn't match the pattern")
    elif isinstance(x, (int, float)) and not isinstance(x, bool):
        if x < schema.get("minimum", -math.inf) or x > schema.get("maximum", math.inf) or x <= schema.get("exclusiveMinimum", -math.inf) or x >= schema.get("exclusiveMaximum", math.inf):
            out.append(f"{at}: out of bounds")
        if "multipleOf" in schema and not _multiple(x, schema["multipleOf"]):
            out.append(f"{at}: not a multiple")
    return out


def _found(pattern: str, text: str, at: str) -> tuple[bool, list[str]]:
    try:
        return bool(re.search(pattern, text)), []
    except re.error:
        return False, [f"{at}: the schema's pattern can't be read"]


def order(calls: list[tuple[str, int, list[str]]]) -> dict[str, int]:
    """Places of (id, turn, dependencies) in topological order; those in or behind a cycle have none."""
    turn = {i: t for i, t, _ in calls}
    needs = {i: {d for d in deps if d in turn} for i, _, deps in calls}
    behind: dict[str, list[str]] = {}
    for i, deps in needs.items():
        for d in deps:
            behind.setdefault(d, []).append(i)
    left = {i: len(d) for i, d in needs.items()}
    free = [(turn[i], i) for i, n in left.items() if not n]
    heapq.heapify(free)
    out: dict[str, int] = {}
    while free:
        _, i = heapq.heappop(free)
        out[i] = len(out)
        for b in behind.get(i, ()):
            left[b] -= 1
            if not left[b]:
                heapq.heappush(free, (turn[b], b))
    return out


def _linked(rows: list[dict], schemas: dict[str, dict]) -> list[dict]:
    """Output rows of one conversation."""
    out: list[dict] = []
    rows.sort(key=lambda r: (r["turn"] is None, r["turn"] or 0, r["call_id"] or "", r["name"] or "", r["arguments"] or ""))
    firsts: dict[str, dict] = {}
    for r in rows:
        if r["is_call"] and r["call_id"] is not None:
            firsts.setdefault(r["call_id"], r)
    places = order([(i, r["turn"] or 0, [d for d in r["depends_on"] or [] if d is not None]) for i, r in firsts.items()])
    for r in rows:
        problems, value = [], None
        if not r["is_call"]:
            out.append({"conv_id": r["conv_id"], "call_id": r["call_id"], "turn": r["turn"], "place": None, "valid": False, "problems": ["no call"], "canonical": canonical({"id": r["call_id"], "result": r["content"]})})
            continue
        place = None
        if r["call_id"] is None:
            problems.append("no id")
        elif firsts[r["call_id"]] is not r:
            problems.append("id repeated")
        else:
            place = places.get(r["call_id"])
            if place is None:
                problems.append("cycle")
            if any(d is not None and d not in firsts for d in r["depends_on"] or []):
                problems.append("unknown dependency")
        if not r["results"]:
            problems.append("no result")
        elif r["results"] > 1:
            problems.append("results repeated")
        try:
            value = parsed(r["arguments"]) if r["arguments"] is not None else None
            if not isinstance(value, dict):
                problems.append("arguments: not an object")
                value = None
        except ValueError:
            problems.append("arguments: no JSON")
        schema = schemas.get(r["name"])
        if schema is None:
            problems.append("unknown tool")
        elif value is not None:
            problems += [_whole(f"arguments: {p}") for p in validate(value, schema)]
        text = canonical({"id": r["call_id"], "name": r["name"], "arguments": value, "depends_on": sorted({d for d in r["depends_on"] or [] if d is not None}), "result": r["content"]})
        out.append({"conv_id": r["conv_id"], "call_id": r["call_id"], "turn": r["turn"], "place": place, "valid": not problems, "problems": sorted(problems), "canonical": text})
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls (conv_id, call_id, turn, name, arguments, depends_on), results (conv_id, call_id, turn,
    content) -> a row for each call, and for each result without one."""
    calls, results = picked(calls, "conv_id", "call_id", "turn", "name", "arguments", "depends_on"), picked(results, "conv_id", "call_id", "turn", "content")
    lone = results.where("call_id IS NULL").select("conv_id", "call_id", "turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("array<string>").alias("depends_on"), F.lit(False).alias("is_call"), "content", F.lit(0).cast("bigint").alias("results"))
    first = results.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.coalesce("turn", F.lit(1 << 62)).alias("t"), "content")).alias("r"), F.count("*").alias("results"), F.min("turn").alias("r_turn"))
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on", F.lit(True).alias("is_call"))
    a, b = calls.alias("a"), first.alias("b").hint("shuffle_hash")
    both = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.call_id") == F.col("b.call_id")), "full").select(
        F.coalesce("a.conv_id", "b.conv_id").alias("conv_id"), F.coalesce("a.call_id", "b.call_id").alias("call_id"), F.coalesce("a.turn", "b.r_turn").alias("turn"),
        "a.name", "a.arguments", "a.depends_on", F.coalesce("a.is_call", F.lit(False)).alias("is_call"), F.col("b.r.content").alias("content"), F.coalesce("b.results", F.lit(0)).alias("results"),
    ).unionByName(lone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("turn", pa.int64()), ("place", pa.int64()), ("valid", pa.bool_()), ("problems", pa.list_(pa.string())), ("canonical", pa.string())])
        some: list[dict] = []
        out: list[dict] = []
        for batch in batches:  # a conversation's rows are together, over batches too
            for r in batch.to_pylist():
                if some and (some[0]["conv_id"] != r["conv_id"] or r["conv_id"] is None and some[0]["call_id"] != r["call_id"]):
                    out += _linked(some, schemas)
                    some = []
                    if len(out) > 2000:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out = []
                some.append(r)
        if some:
            out += _linked(some, schemas)
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    alone = F.when(F.col("conv_id").isNull(), F.col("call_id"))
    return both.repartition("conv_id", alone).sortWithinPartitions("conv_id", alone).mapInArrow(run, OUT)


#: The tools that the query's conversations use.
SCHEMAS = {
    "search": {"type": "object", "required": ["limit", "query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 400}, "limit": {"type": "integer", "minimum": 1, "maximum": 6}}},
    "lookup": {"type": "object", "required": ["limit", "query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 4}}},
}


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table has no tool calls of its own, so turns are read as such: each assistant turn
    calls a tool with its text as the query and its turn as the limit, after the call before it in
    the conversation; any other turn is a result of the turn before it, so that those that don't
    follow an assistant's are results without a call."""
    from pyspark.sql import Window

    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    calls = c.where("role = 'assistant'").withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    calls = calls.select("conv_id", id(F.col("turn")).alias("call_id"), "turn", F.when(F.col("turn") % 4 == 1, "search").otherwise("lookup").alias("name"), F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit"))).alias("arguments"), F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.array(id(F.col("before")))).alias("depends_on"))
    results = c.where("NOT role <=> 'assistant'").select("conv_id", id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def query(spark, sf_dir: str) -> DataFrame:
    calls, results = as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link(calls, results, SCHEMAS).withColumn("problems", F.array_join("problems", "; "))


ORACLE = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
calls AS (
  SELECT conv_id, turn, 'c' || conv_id || '_' || turn AS call_id, CASE WHEN turn % 4 = 1 THEN 'search' ELSE 'lookup' END AS name, text,
    lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place
  FROM c WHERE role = 'assistant'
), results AS (SELECT conv_id, 'c' || conv_id || '_' || (turn - 1) AS call_id, turn, text FROM c WHERE role IS DISTINCT FROM 'assistant'),
linked AS (
  SELECT a.*, r.text AS result, r.call_id IS NULL AS lacks,
    a.turn < 1 OR a.turn > (CASE WHEN a.name = 'search' THEN 6 ELSE 4 END) AS beyond,
    length(a.text) < 1 OR (a.name = 'search' AND length(a.text) > 400) AS odd
  FROM calls a LEFT JOIN results r ON a.conv_id = r.conv_id AND a.call_id = r.call_id
)
SELECT conv_id, call_id, turn, place, NOT (lacks OR beyond OR odd) AS valid,
  concat_ws('; ', CASE WHEN beyond THEN 'arguments: $.limit: out of bounds' END, CASE WHEN odd THEN 'arguments: $.query: wrong length' END, CASE WHEN lacks THEN 'no result' END) AS problems,
  '{"arguments":{"limit":' || turn || ',"query":' || CAST(to_json(text) AS VARCHAR) || '},"depends_on":[' || coalesce('"c' || conv_id || '_' || before || '"', '') || '],"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS canonical
FROM linked
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, NULL, false, 'no call', '{"id":"' || r.call_id || '","result":' || CAST(to_json(r.text) AS VARCHAR) || '}'
FROM results r LEFT JOIN calls a ON a.conv_id = r.conv_id AND a.call_id = r.call_id WHERE a.call_id IS NULL
"""
