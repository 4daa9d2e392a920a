"""Chat formatting: tool calls and results linked, ordered, validated and written as canonical JSON.

1. Repeated calls and results of an identifier are combined before the shuffle:
   the one with the smallest turn (then name and content) stands for all.
2. Calls and results are hash-joined by conversation and identifier.
3. A call depends on each call that its arguments name as ``{"$ref": id}``.  Its
   level is one more than the highest level it depends on; (level, turn, call_id)
   is a topological order.  The dependencies of a conversation come to one task,
   sorted, and are folded there; those of a conversation with more than ``FOLD``
   of them stay distributed: a chain of calls that each depend on one other is
   halved in every round by pointer doubling, and calls with several dependencies
   wait for these.  Calls on or behind a cycle get no level.
4. Arguments are validated against the tool's schema (type, enum, const,
   required, properties, additionalProperties, items, anyOf, bounds, lengths,
   pattern); a reference stands for a value of any type.  A schema is checked
   once in a task; a malformed one is an error of every call of its tool.
5. Each row's JSON is canonical (RFC 8785): keys in order of UTF-16 units, no
   spaces, numbers as ECMAScript shows them; whole numbers of any size stay exact.

Edge cases: a call or result without an identifier or conversation is a row of
its own (``no_id``); a result without a call is ``no_call``; arguments that are
no JSON object are an error and written as null; an unknown tool or a reference
to a missing call is an error; a null text is a null value; of tools with one
name the schema that is first in order counts; empty tables give no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, n_parts, saved

#: Dependencies of one conversation that are folded in one task.
FOLD = 500_000
#: Characters of schemas that are broadcast, and parts that calls of one tool are dealt to where they are more.
SMALL_SCHEMAS, SALTS = 8_000_000, 32

_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
}


def _is_ref(x) -> bool:
    return isinstance(x, dict) and set(x) == {"$ref"} and isinstance(x["$ref"], str)


def references(x) -> list[str]:
    """Identifiers named anywhere in a value, without recursion."""
    found, todo = set(), [x]
    while todo:
        y = todo.pop()
        if _is_ref(y):
            found.add(y["$ref"])
        elif isinstance(y, dict):
            todo += y.values()
        elif isinstance(y, list):
            todo += y
    return sorted(found)


def validate(x, schema, at: str = "$") -> list[str]:
    """What is wrong with a value, as sentences that begin with its place."""
    if _is_ref(x) or schema is True or not isinstance(schema, dict):
        return [f"{at}: not allowed"] if schema is False else []
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES.get(k, lambda _: False)(x) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    if "enum" in schema and canonical(x) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(x) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if "anyOf" in schema and all(validate(x, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: fits none of anyOf")
    if isinstance(x, dict):
        props = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in x]
        for k in sorted(x):
            out += validate(x[k], props[k] if k in props else schema.get("additionalProperties", True), f"{at}.{k}")
    elif isinstance(x, list):
        out += _bounds(len(x), schema, "minItems", "maxItems", at)
        for i, y in enumerate(x):
            out += validate(y, schema.get("items", True), f"{at}[{i}]")
    elif isinstance(x, str):
        out += _bounds(len(x), schema, "minLength", "maxLength", at)
        if "pattern" in schema and not re.search(schema["pattern"], x):
            out.append(f"{at}: doesn't match the pattern")
    elif isinstance(x, (int, float)) and not isinstance(x, bool):
        out += _bounds(x, schema, "minimum", "maximum", at)
    return out


_NUMBERS = ("minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems")


def faults(schema, at: str = "schema") -> list[str]:
    """What makes a schema malformed, as sentences that begin with its place."""
    if isinstance(schema, bool):
        return []
    if not isinstance(schema, dict):
        return [f"{at}: no object"]
    out = []
    kinds = schema.get("type", "object")
    if not all(isinstance(k, str) and k in _TYPES for k in (kinds if isinstance(kinds, list) else [kinds])):
        out.append(f"{at}.type: unknown")
    out += [f"{at}.{k}: no number" for k in _NUMBERS if k in schema and not _TYPES["number"](schema[k])]
    out += [f"{at}.{k}: no list" for k in ("enum", "anyOf") if k in schema and not (isinstance(schema[k], list) and schema[k])]
    if not (isinstance(schema.get("required", []), list) and all(isinstance(k, str) for k in schema.get("required", []))):
        out.append(f"{at}.required: no list of names")
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except (re.error, TypeError, RecursionError, OverflowError):
            out.append(f"{at}.pattern: no pattern")
    props = schema.get("properties", {})
    if not isinstance(props, dict):
        return [*out, f"{at}.properties: no object"]
    inner = [(f"properties.{k}", x) for k, x in sorted(props.items())] + [(k, schema[k]) for k in ("items", "additionalProperties") if k in schema]
    inner += [(f"anyOf[{i}]", x) for i, x in enumerate(schema["anyOf"] if isinstance(schema.get("anyOf"), list) else [])]
    return out + [y for k, x in inner for y in faults(x, f"{at}.{k}")]


def _bounds(n, schema, low, high, at):
    return [f"{at}: under {low}"] * (low in schema and n < schema[low]) + [f"{at}: over {high}"] * (high in schema and n > schema[high])


def _number(x: float) -> str:
    """A finite number as ECMAScript shows it."""
    if not x:
        return "0"
    sign, (digits, power) = "-" * (x < 0), re.fullmatch(r"([\d.]+)(?:e([+-]\d+))?", repr(abs(x))).groups()
    whole, _, part = digits.partition(".")
    point = len(whole) + int(power or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    if len(digits) <= point <= 21:
        return sign + digits.ljust(point, "0")
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{point - 1:+d}"


def canonical(x) -> str:
    """JSON with keys in order of UTF-16 units, no spaces, and shortest numbers."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    if isinstance(x, float):
        return _number(x)
    return json.dumps(x, ensure_ascii=False)


def _refuse(name):
    raise ValueError(name)


def _finite(digits: str) -> float:
    x = float(digits)
    if x in (float("inf"), float("-inf")):
        raise ValueError(f"{digits}: no finite number")
    return x


def parse(raw: str | None):
    """The value, or None and False: what isn't JSON of finite numbers and whole characters."""
    try:
        x = json.loads(raw, parse_constant=_refuse, parse_float=_finite)
        canonical(x).encode()
        return x, True
    except (TypeError, ValueError, RecursionError, OverflowError):
        return None, False


@lru_cache(1000)
def _rule(raw: str | None):
    """(schema, what is wrong with it) of a tool, read and checked once in a task."""
    rule, known = parse(raw)
    if not known:
        return None, ["$: unknown tool"]
    return rule, [f"$: the tool's {x}" for x in faults(rule)]


def fold(edges) -> dict:
    """Levels of the calls of (call, call it depends on) that are on and behind no cycle."""
    waits, behind = defaultdict(set), defaultdict(list)
    for call, dep in edges:
        if dep not in waits[call]:
            waits[call].add(dep)
            behind[dep].append(call)
    left = {call: len(deps) for call, deps in waits.items()}
    level = {dep: 0 for dep in behind if dep not in waits}
    todo = list(level)
    for dep in todo:
        for call in behind[dep]:
            level[call] = max(level.get(call, 0), level[dep] + 1)
            left[call] -= 1
            if not left[call]:
                todo.append(call)
    return {call: level[call] for call in todo}


def _folded(edges: DataFrame) -> DataFrame:
    """Levels conversation by conversation, each in one task."""
    conv = edges.schema["conv"].dataType.simpleString()
    parts = n_parts(edges.sparkSession, 0)

    def run(it):
        now, held = None, []

        def rows(found):
            found = [(c, k, n) for c, x in found for k, n in fold(x).items()]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["conv", "id", "level"])

        kind = None
        for batch in it:
            kind = batch.schema.field("conv").type
            done = []
            for c, call, dep in zip(*(batch.column(k).to_pylist() for k in ("conv", "id", "dep")), strict=True):
                if held and c != now:
                    done.append((now, held))
                    held = []
                now = c
                held.append((call, dep))
            yield rows(done)
        if held:
            yield rows([(now, held)])

    return edges.repartition(parts, "conv").sortWithinPartitions("conv").mapInArrow(run, f"conv {conv}, id string, level long")


def _levels(edges: DataFrame) -> DataFrame:
    """conv, id, level of every call that depends on another, or is depended on, and is on no cycle; edges: conv, id, dep."""
    edges = saved(edges.distinct(), "edges")
    large = saved(edges.groupBy("conv").count().filter(F.col("count") > FOLD).select("conv"), "large")
    if large.isEmpty():
        return _folded(edges)
    return _folded(edges.join(large, "conv", "left_anti")).unionByName(_doubled(saved(edges.join(large, "conv", "left_semi"), "edges")))


def _doubled(edges: DataFrame) -> DataFrame:
    """The same by rounds of joins: what depends on one call points at the call ``up`` levels before it, twice as far in every round."""
    key = ["conv", "id"]
    several = edges.groupBy(key).count().filter("count > 1").select(key)
    calls = edges.select(key).distinct()
    n = calls.count()
    level = saved(edges.select("conv", F.col("dep").alias("id")).distinct().join(calls, key, "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    single = saved(edges.join(several, key, "left_anti").select(*key, "dep", F.lit(1).cast("long").alias("up")), "single")
    joins = saved(edges.join(several, key, "left_semi"), "joins")
    state = None
    while True:
        of = level.select("conv", F.col("id").alias("dep"), F.col("level").alias("_of"))
        on = single.join(of, ["conv", "dep"], "left")
        known = on.filter("_of IS NOT NULL").select(*key, (F.col("_of") + F.col("up")).alias("level"))
        whole = joins.join(of, ["conv", "dep"], "left").groupBy(key).agg((F.count("*") == F.count("_of")).alias("all"), (F.max("_of") + 1).alias("level")).filter("all").drop("all")
        ready = saved(known.unionByName(whole), "ready")
        jump = single.select("conv", F.col("id").alias("dep"), F.col("dep").alias("_then"), F.col("up").alias("_more"))
        rest = on.filter("_of IS NULL").join(jump, ["conv", "dep"], "left").select(*key, F.coalesce("_then", "dep").alias("dep"), (F.col("up") + F.coalesce("_more", F.lit(0))).alias("up"))
        # no chain is longer than the calls: what goes further circles
        old, single = [level, single, joins, ready], saved(rest.filter(F.col("up") <= n), "single")
        before, state = state, tuple(single.agg(F.count("*"), F.sum(F.xxhash64("conv", "id", "dep", "up").cast("decimal(38,0)"))).first())
        if ready.isEmpty() and state == before:
            return level
        level = saved(level.unionByName(ready), "levels")
        joins = saved(joins.join(ready.select(key), key, "left_anti"), "joins")
        discard(*old)


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments (JSON); results: conv_id, turn, call_id, content; tools: name, schema (JSON).

    Returns conv_id, call_id, turn, result_turn, name, level, status (linked,
    no_result, no_call, no_id, cycle), errors, json.
    """
    kind = dict(calls.dtypes)["conv_id"]
    c = calls.select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), "turn", "name", "arguments")
    r = results.select(F.col("conv_id").cast(kind).alias("conv"), F.col("call_id").alias("id"), F.col("turn").alias("result_turn"), "content")
    has = F.col("conv").isNotNull() & F.col("id").isNotNull()
    one_call = c.filter(has).groupBy("conv", "id").agg(F.min(F.struct("turn", "name", "arguments")).alias("c")).select("conv", "id", "c.*", F.lit(True).alias("called"))
    one_result = r.filter(has).groupBy("conv", "id").agg(F.min(F.struct("result_turn", "content")).alias("r")).select("conv", "id", "r.*", F.lit(True).alias("answered"))
    linked = one_call.join(one_result.hint("shuffle_hash"), ["conv", "id"], "full_outer")
    # a few small rows make a partition's worth of work, so they are dealt out before it
    linked = linked.repartition(n_parts(calls.sparkSession, 0), "conv", "id")
    alone = c.filter(~has).withColumn("called", F.lit(True)).unionByName(r.filter(~has).withColumn("answered", F.lit(True)), allowMissingColumns=True)
    t = saved(tools.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min("schema").alias("schema")), "tools")
    rows = linked.unionByName(alone, allowMissingColumns=True)
    if (t.agg(F.sum(F.length("schema") + F.length("name"))).first()[0] or 0) <= SMALL_SCHEMAS:
        rows = rows.join(F.broadcast(t), "name", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("conv", "id"), F.lit(SALTS)).cast("int")).join(t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["name", "salt"], "left").drop("salt")

    def check(it):
        for batch in it:
            col = {k: batch.column(k).to_pylist() for k in ("id", "name", "arguments", "content", "schema", "called")}
            errors, refs, text = [], [], []
            for call_id, name, raw, content, schema, called in zip(*col.values(), strict=True):
                args, ok = parse(raw)
                wrong = []
                if called:
                    rule, wrong = _rule(schema)
                    if not ok or not isinstance(args, dict):
                        wrong = ["$: not a JSON object"]
                    elif not wrong:
                        wrong = validate(args, rule)
                errors.append(wrong)
                refs.append(references(args) if called else [])
                text.append(canonical({"arguments": args if isinstance(args, dict) else None, "call_id": call_id, "name": name, "result": content}))
            keep = [k for k in batch.schema.names if k not in ("arguments", "content", "schema")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(errors, pa.list_(pa.string())), pa.array(refs, pa.list_(pa.string())), pa.array(text, pa.string())], names=[*keep, "errors", "refs", "json"])

    turn = dict(calls.dtypes)["turn"]
    rows = rows.select("conv", "id", "turn", "name", F.col("result_turn").cast(turn), F.coalesce("called", F.lit(False)).alias("called"), F.coalesce("answered", F.lit(False)).alias("answered"), "arguments", "content", "schema")
    rows = saved(rows.mapInArrow(check, f"conv {kind}, id string, turn {turn}, name string, result_turn {turn}, called boolean, answered boolean, errors array<string>, refs array<string>, json string"), "checked")
    named = rows.filter(has & F.col("called"))
    deps = named.select("conv", "id", F.explode("refs").alias("dep"))
    there = named.select("conv", F.col("id").alias("dep"), F.lit(True).alias("there"))
    deps = saved(deps.join(there, ["conv", "dep"], "left"), "dependencies")
    level = _levels(deps.filter("there").select("conv", "id", "dep"))
    missing = deps.filter("there IS NULL").groupBy("conv", "id").agg(F.array_sort(F.collect_set("dep")).alias("missing"))
    depends = deps.filter("there").select("conv", "id").distinct().withColumn("depends", F.lit(True))
    out = rows.join(level, ["conv", "id"], "left").join(missing, ["conv", "id"], "left").join(depends, ["conv", "id"], "left")
    errors = F.concat("errors", F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda x: F.concat(F.lit("$ref: no call "), x)))
    cycle = F.col("depends") & F.col("level").isNull()
    status = F.when(~has, "no_id").when(~F.col("called"), "no_call").when(cycle, "cycle").when(F.col("answered"), "linked").otherwise("no_result")
    return out.select(F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), "turn", "result_turn", "name", F.when(F.col("called") & ~F.coalesce(cycle, F.lit(False)), F.coalesce("level", F.lit(0)).cast("int")).alias("level"), status.alias("status"), F.when(F.col("called"), errors).alias("errors"), "json")
