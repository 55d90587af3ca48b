"""Chat records with linked tool calls, as canonical JSON.

A message of role ``assistant`` may be a JSON object with ``tool_calls``: a list
of objects with ``id``, ``name``, ``arguments`` (an object, or its JSON text) and
optionally ``after``, the ids of calls it depends on.  A message of role ``tool``
may be a JSON object with ``tool_call_id`` and ``content``.  Any other text is a
plain message.

Every call stays in its message's record.  Results are hash-joined with the calls by
conversation and identifier; a result answers the latest earlier call of its
identifier (identifiers may restart each turn), and the first result of a call
counts.  A call depends on the latest call of each identifier in ``after`` that does
not come behind it, or else on the first one behind it.  Calls are ordered
topologically, level by level, by joins over the edges; calls on a cycle get no
level.  Arguments are validated against the schema of their name: that of the table
of schemas or, without one, what the conversation declares.  A message of role
``system`` may be a JSON object with ``tools``: a list of objects with ``name`` and
``parameters`` (a JSON schema), or with these under ``function``; a call is held
against the latest declaration of its name that does not come behind it.  Names
without a schema take any object.  Nothing gathers a whole conversation: a record is one message,
so that a conversation with a third of all rows is no hot group.

Canonical JSON: keys sorted, no blanks, UTF-8 as it is.

Edge cases: null text is null content; null ids, turns and roles stay null and
link with nothing; calls in such rows are kept and validated, depend on nothing and
have no result.  Messages that share conversation and turn each keep their own
calls; of equal identifiers in a turn, the one that stands last in its message is
the latest.  Text that isn't valid JSON, or has no list of calls, is a
plain message.  Schemas that are malformed, or refer to another document, are met by
nothing; ``format`` and patterns that Python doesn't know are not checked.  Repeated
rows give repeated records.  An empty table gives none.
Other columns are not read.
"""
from __future__ import annotations

import json
import math
import re
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import add_columns


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _load(text: str):
    def no_constant(name):
        raise ValueError(name)
    return json.loads(text, parse_constant=no_constant)


def parse(text: str | None, role: str | None) -> tuple[list[dict], str | None, object]:
    """(calls, identifier that the message answers, content)."""
    if not text or role not in ("assistant", "tool") or not text.lstrip().startswith("{"):
        return [], None, text
    try:
        value = _load(text)
        canonical(value)
    except (ValueError, RecursionError):
        return [], None, text
    if role == "tool":
        ref = value.get("tool_call_id")
        return ([], ref, value.get("content")) if isinstance(ref, str) else ([], None, text)
    listed = value.get("tool_calls")
    if not isinstance(listed, list) or not all(
            isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in listed):
        return [], None, text
    calls = []
    for c in listed:
        arguments = c.get("arguments", {})
        if isinstance(arguments, str):
            try:
                arguments = _load(arguments)
                canonical(arguments)
            except (ValueError, RecursionError):
                pass
        after = c.get("after")
        calls.append({"call_id": c["id"], "name": c["name"], "arguments": canonical(arguments),
                      "after": [a for a in after if isinstance(a, str)] if isinstance(after, list) else []})
    return calls, None, value.get("content")


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _same(value) -> str:
    """Equal for values that JSON schema calls equal (1 and 1.0 are)."""
    def plain(v):
        if isinstance(v, float) and math.isfinite(v) and v == int(v):
            return int(v)
        return [plain(x) for x in v] if isinstance(v, list) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    return canonical(plain(value))


def _found(pattern: str, text: str) -> bool:
    try:
        return re.search(pattern, text) is not None
    except re.error:
        return True


def _referred(ref: str, root):
    """The schema that a pointer into the same document names."""
    if not ref.startswith("#") or (ref != "#" and not ref.startswith("#/")):
        raise ValueError(ref)
    at = root
    for part in unquote(ref[1:]).split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        at = at[int(part)] if isinstance(at, list) else at[part]
    return at


def _number_fits(value, schema: dict) -> bool:
    low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
    step = schema.get("multipleOf")
    return not (value < schema.get("minimum", value) or value > schema.get("maximum", value)
                or (low is True and value == schema.get("minimum")) or (high is True and value == schema.get("maximum"))
                or (_is_number(low) and value <= low) or (_is_number(high) and value >= high)
                or (step is not None and Fraction(str(value)) % Fraction(str(step)) != 0))


def _array_fits(value: list, schema: dict, root) -> bool:
    if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
        return False
    if schema.get("uniqueItems") and len({_same(v) for v in value}) < len(value):
        return False
    items = schema.get("items", True)
    first = schema.get("prefixItems", items if isinstance(items, list) else [])
    rest = schema.get("additionalItems", True) if isinstance(items, list) else items
    if not all(valid(v, first[i] if i < len(first) else rest, root) for i, v in enumerate(value)):
        return False
    if "contains" not in schema:
        return True
    n = sum(valid(v, schema["contains"], root) for v in value)
    return schema.get("minContains", 1) <= n <= schema.get("maxContains", n)


def _object_fits(value: dict, schema: dict, root) -> bool:
    if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
        return False
    if not all(k in value for k in schema.get("required", ())):
        return False
    known, patterns, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
    for k, v in value.items():
        own = [s for p, s in patterns.items() if _found(p, k)] + ([known[k]] if k in known else [])
        if not all(valid(v, s, root) for s in own or [rest]) or not valid(k, schema.get("propertyNames", True), root):
            return False
    needs = {**schema.get("dependencies", {}), **schema.get("dependentRequired", {}), **schema.get("dependentSchemas", {})}
    return all(all(x in value for x in need) if isinstance(need, list) else valid(value, need, root)
               for k, need in needs.items() if k in value)


def valid(value, schema, root=None) -> bool:
    """``value`` against a JSON schema: its assertions on types, numbers, strings,
    arrays and objects, combined schemas, conditions and pointers into ``root``."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return schema
    if "$ref" in schema and not valid(value, _referred(schema["$ref"], root), root):
        return False
    kinds = schema.get("type")
    if kinds is not None:
        def of(kind):
            if kind in ("integer", "number"):
                return _is_number(value) and (kind == "number" or isinstance(value, int) or
                                              (math.isfinite(value) and value == int(value)))
            return isinstance(value, _TYPES.get(kind, ()))
        if not any(of(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return False
    if "enum" in schema and _same(value) not in {_same(e) for e in schema["enum"]}:
        return False
    if "const" in schema and _same(value) != _same(schema["const"]):
        return False
    if _is_number(value) and not _number_fits(value, schema):
        return False
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return False
        if "pattern" in schema and not _found(schema["pattern"], value):
            return False
    if isinstance(value, list) and not _array_fits(value, schema, root):
        return False
    if isinstance(value, dict) and not _object_fits(value, schema, root):
        return False
    if not all(valid(value, s, root) for s in schema.get("allOf", ())):
        return False
    if "anyOf" in schema and not any(valid(value, s, root) for s in schema["anyOf"]):
        return False
    if "oneOf" in schema and sum(valid(value, s, root) for s in schema["oneOf"]) != 1:
        return False
    if "not" in schema and valid(value, schema["not"], root):
        return False
    return "if" not in schema or valid(value, schema.get("then" if valid(value, schema["if"], root) else "else", True), root)


def fits(value, schema: str) -> bool:
    """``value`` against the text of a schema."""
    try:
        return valid(value, json.loads(schema))
    except (ValueError, TypeError, LookupError, AttributeError, ArithmeticError, RecursionError):
        return False


_CALL = pa.struct([("call_id", pa.string()), ("name", pa.string()), ("arguments", pa.string()),
                   ("after", pa.list_(pa.string()))])


def _parsed(column: pa.Array) -> list[pa.Array]:
    got = [parse(t, r) for t, r in zip(column.field("text").to_pylist(), column.field("role").to_pylist())]
    content = [None if c is None else canonical(c) for _, _, c in got]
    return [pa.array([c for c, _, _ in got], pa.list_(_CALL)), pa.array([r for _, r, _ in got], pa.string()),
            pa.array(content, pa.string())]


def tools(text: str) -> list[dict]:
    """The (name, schema) that a message declares."""
    try:
        value = _load(text)
        canonical(value).encode()
    except (ValueError, RecursionError):
        return []
    listed = value.get("tools") if isinstance(value, dict) else None
    told = [t["function"] if isinstance(t, dict) and isinstance(t.get("function"), dict) else t for t in (listed if isinstance(listed, list) else [])]
    return [{"name": t["name"], "schema": canonical(t["parameters"])} for t in told
            if isinstance(t, dict) and isinstance(t.get("name"), str) and isinstance(t.get("parameters"), (dict, bool))]


def _declared(column: pa.Array) -> list[pa.Array]:
    return [pa.array([tools(t) for t in column.to_pylist()], pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())])))]


def _checked(column: pa.Array) -> list[pa.Array]:
    out = []
    for arguments, schema in zip(column.field("text").to_pylist(), column.field("schema").to_pylist()):
        value = json.loads(arguments)
        out.append(isinstance(value, dict) and (schema is None or fits(value, schema)))
    return [pa.array(out, pa.bool_())]


def _recorded(column: pa.Array) -> list[pa.Array]:
    """The canonical record of each message."""
    out = []
    for m in column.to_pylist():
        record = {"content": None if m["text"] is None else json.loads(m["text"]), "conv_id": m["conv_id"],
                  "role": m["role"], "turn": m["turn"]}
        if m["answers"] is not None:
            record["tool_call_id"] = m["answers"]
        if m["linked"]:
            calls = sorted(m["linked"], key=lambda c: (c["level"] is None, c["level"] or 0, c["place"]))
            record["tool_calls"] = [
                {"arguments": json.loads(c["arguments"]), "id": c["call_id"], "level": c["level"], "name": c["name"],
                 "result_turn": c["result_turn"], "valid": c["valid"]} for c in calls]
        out.append(canonical(record))
    return [pa.array(out, pa.string())]


TURNS = 1024                   # turns that are read in order in one group


def latest(asked: DataFrame, calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, turn): for each row of ``asked`` (conv_id, call_id, at) the last turn before ``at``
    with such a call; null if there is none.  No group holds more than TURNS turns, or one row for so many."""
    key = ["conv_id", "call_id"]
    turn, none = F.col("turn").cast("long"), F.lit(None).cast("long")
    events = (calls.select(*key, turn.alias("at"), turn.alias("called"))
              .unionByName(asked.select(*key, F.col("at").cast("long").alias("at"), none.alias("called")))
              .distinct().withColumn("range", F.floor(F.col("at") / TURNS)))
    ranges = events.groupBy(*key, "range").agg(F.max("called").alias("called")).withColumn("before", F.max("called").over(
        Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("called")
    within = F.max("called").over(Window.partitionBy(*key, "range").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    return (events.withColumn("within", within).filter("called is null").join(ranges, [*key, "range"])
            .select(*key, "at", F.coalesce("within", "before").alias("turn")))


def declared(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, schema): the tools that conversations declare, by name; of equal names in a turn the last."""
    rows = messages.filter((F.col("role") == "system") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").rlike(r"^\s*\{"))
    found = add_columns(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "text"), "text", ["conv_id", "turn"],
                        _declared, "tools array<struct<name:string,schema:string>>")
    return (found.select("conv_id", "turn", F.posexplode("tools").alias("place", "t"))
            .groupBy("conv_id", F.col("t.name").alias("call_id"), "turn").agg(F.max(F.struct("place", "t.schema")).alias("x"))
            .select("conv_id", "call_id", "turn", "x.schema"))


def schemas_of(calls: DataFrame, placed: DataFrame, messages: DataFrame) -> DataFrame:
    """``calls`` with the schema that their conversation declares for their name, if any."""
    key = ["conv_id", "call_id", "turn"]
    said = materialize(declared(messages), "call-schemas")
    behind = (F.col("turn").cast("long") + 1).alias("at")                     # a declaration of the same turn counts
    last = latest(placed.select("conv_id", F.col("name").alias("call_id"), behind), said).join(said, key)
    return calls.join(last.select("conv_id", F.col("call_id").alias("name"), (F.col("at") - 1).alias("turn"), "schema"),
                      ["conv_id", "name", "turn"], "left")


def dependencies(calls: DataFrame, last: DataFrame) -> DataFrame:
    """(call, needs): the calls that each call depends on."""
    named = calls.select("call", "conv_id", "turn", F.col("call_id").alias("own"), F.explode(F.array_distinct("after")).alias("call_id"))
    at = (F.col("turn").cast("long") + (F.col("own") != F.col("call_id")).cast("long")).alias("at")
    named = materialize(named.select("call", "conv_id", "call_id", at), "call-after")
    key = ["conv_id", "call_id"]
    found = materialize(latest(named, last), "call-before")
    behind = latest(found.filter("turn is null").select(*key, (1 - F.col("at")).alias("at")),
                    last.select(*key, (-F.col("turn").cast("long")).alias("turn")))
    found = found.filter("turn is not null").unionByName(
        behind.filter("turn is not null").select(*key, (1 - F.col("at")).alias("at"), (-F.col("turn")).alias("turn")))
    return named.join(found, [*key, "at"]).join(last, [*key, "turn"]).select("call", F.col("last").alias("needs")).distinct()


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(call, level) of calls without a cycle behind them; a call's level is one
    more than the highest of those it depends on.  ``edges``: call, needs."""
    keys = calls.select("call")
    edges = materialize(edges, "call-edges")
    done = keys.join(edges, "call", "left_anti").withColumn("level", F.lit(0).cast("long"))
    fresh, open_ = materialize(done, "call-levels"), edges
    done = fresh
    while not open_.isEmpty() and not fresh.isEmpty():
        # edges whose source is placed leave; calls left without open edges are placed next
        open_ = materialize(open_.join(fresh.select(F.col("call").alias("needs")), "needs", "left_anti"), "call-edges")
        ready = keys.join(done, "call", "left_anti").join(open_, "call", "left_anti")
        fresh = materialize(edges.join(ready, "call", "left_semi").join(done.withColumnRenamed("call", "needs"), "needs")
                            .groupBy("call").agg((F.max("level") + 1).alias("level")), "call-levels")
        done = done.unionByName(fresh)
    return done


def link(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, record, n_calls, n_linked,
    n_invalid, n_cyclic.  ``schemas``: name, schema (JSON text); without it calls are
    held against what their conversation declares."""
    rows = messages.select("conv_id", "turn", "role", F.struct("text", "role").alias("both"))
    parsed = add_columns(rows, "both", ["conv_id", "turn", "role"], _parsed,
                         "calls array<struct<call_id:string,name:string,arguments:string,after:array<string>>>, "
                         "answers string, content string")
    # a message by its keys and its calls; equal messages have equal records
    called = parsed.filter(F.size("calls") > 0).withColumn("message", F.xxhash64(
        "conv_id", F.col("conv_id").isNull(), "turn", F.col("turn").isNull(), "calls"))
    calls = materialize(called.select("message", "conv_id", "turn", F.posexplode("calls").alias("place", "c"))
                        .select(F.xxhash64("message", "place").alias("call"), "message", "conv_id", "turn", "place", "c.*")
                        .dropDuplicates(["call"]), "calls")
    plain = F.lit(None).cast("array<struct<place:int,call_id:string,name:string,arguments:string,level:bigint,result_turn:bigint,valid:boolean>>")
    placed = calls.filter("conv_id is not null and turn is not null")
    last = materialize(placed.groupBy("conv_id", "call_id", "turn").agg(F.max(F.struct("place", "call")).alias("x"))
                       .select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), F.col("x.call").alias("last")), "last-calls")
    results = parsed.filter("answers is not null and conv_id is not null and turn is not null").select(
        "conv_id", F.col("answers").alias("call_id"), F.col("turn").alias("at"))
    answered = (latest(results, last).join(last, ["conv_id", "call_id", "turn"]).groupBy(F.col("last").alias("call"))
                .agg(F.min("at").alias("result_turn")))
    known = schemas_of(calls, placed, messages) if schemas is None else calls.join(
        schemas.groupBy("name").agg(F.min("schema").alias("schema")), "name", "left")
    keep = ["call", "message", "place", "call_id", "name", "arguments"]
    checked = add_columns(known.select(*keep, F.struct(F.col("arguments").alias("text"), "schema").alias("check")),
                          "check", keep, _checked, "valid boolean")
    linked = (checked.join(levels(calls, dependencies(placed, last)), "call", "left").join(answered, "call", "left")
              .groupBy("message").agg(F.collect_list(F.struct(
                  "place", "call_id", "name", "arguments", "level", "result_turn", "valid")).alias("linked")))
    full = called.join(linked, "message").drop("message").unionByName(
        parsed.filter(F.size("calls") == 0).withColumn("linked", plain))
    whole = full.select("conv_id", "turn", "role", F.coalesce("linked", F.array()).alias("linked"), F.struct(
        F.col("content").alias("text"), "conv_id", "turn", "role", "answers", "linked").alias("whole"))
    out = add_columns(whole, "whole", ["conv_id", "turn", "role", "linked"], _recorded, "record string")
    count = lambda test: F.size(F.filter("linked", test)).cast("long")
    return out.select("conv_id", "turn", "role", "record", F.size("linked").cast("long").alias("n_calls"),
                      count(lambda c: c["result_turn"].isNotNull()).alias("n_linked"),
                      count(lambda c: ~c["valid"]).alias("n_invalid"), count(lambda c: c["level"].isNull()).alias("n_cyclic"))
