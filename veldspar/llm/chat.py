"""Chat formatting with tool-call linking, in native DataFrame operations.

Messages are rows (conv_id, turn, role, text).  An assistant text that is a JSON object with a ``tool_calls`` list in the
chat-completions form (``id``, ``function.name``, ``function.arguments`` as an object or as JSON text, and as an addition
``depends_on``, a list of ids) makes calls; a tool text that is a JSON object with ``tool_call_id`` is a result.  Any other
text is plain content.

* Calls and results are hash-joined by (conv_id, id).  A result whose call is missing is an orphan; a second call or result
  with an id that its conversation already used is a duplicate and isn't linked (the first by turn, then text, counts).
* Order: a call comes after the results that it depends on (``depends_on``, or a string ``"$id"`` among its arguments) and
  a result after its call.  Calls are placed level by level, a call when all that it depends on are placed; what can't be
  placed lies on or behind a cycle and is reported.  ``(order_turn, level, is_result, turn)`` sorts a conversation
  topologically, so no conversation has to fit into one task.
* Arguments are checked against JSON schemas: type, required, properties (type and enum) and additionalProperties.
* Each message becomes one canonical JSON line: sorted keys, no blanks, nulls left out.

A null or empty text is empty content, a null role "unknown", a null turn comes first.  Rows with a null conv_id are never
linked.  Repeated rows stay repeated, linked alike.  Other columns are not carried.
"""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

_TYPES = {
    "string": "^STRING$",
    "integer": r"^(?:BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
    "null": "^VOID$",
}

#: Schemas of the tools that the query knows; calls of other tools are reported as such.
TOOLS: dict[str, dict[str, Any]] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "weather": {"type": "object", "properties": {"place": {"type": "string"}, "unit": {"type": "string", "enum": ["C", "F"]}}, "required": ["place"]},
}


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(_TYPES[kind]), F.lit(False))


def _valid(args: Column, schema: dict[str, Any]) -> Column:
    """Whether a variant of arguments meets a schema; ``args`` is an object here."""
    text = F.to_json(args)
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    ok = F.lit(True)
    for name in schema.get("required", []):
        ok &= F.array_contains(keys, name)
    for name, rule in schema.get("properties", {}).items():
        value = F.try_variant_get(args, f"$['{name}']", "variant")
        good = F.lit(True)
        if kinds := rule.get("type"):
            good = F.lit(False)
            for kind in [kinds] if isinstance(kinds, str) else kinds:
                good |= _is(value, kind)
        if "enum" in rule:
            good &= F.coalesce(F.try_variant_get(args, f"$['{name}']", "string").isin([str(x) for x in rule["enum"]]), F.lit(False))
        ok &= ~F.array_contains(keys, name) | good
    if schema.get("additionalProperties") is False:
        ok &= F.size(F.array_except(keys, F.array(*[F.lit(x) for x in schema.get("properties", {})]).cast("array<string>"))) == 0
    return ok


def parse(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, uid, body, calls, tool_call_id): the parts of each message.  uid tells messages apart."""
    role = F.coalesce(F.lower(F.trim("role")), F.lit("unknown"))
    text = F.coalesce(F.col("text"), F.lit(""))
    looks = F.ltrim(text).startswith("{") & role.isin("assistant", "tool")
    row = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(looks, F.try_parse_json(text)).alias("v"))
    call = "array<struct<id:string,function:struct<name:string,arguments:variant>,depends_on:array<string>>>"
    calls = F.filter(F.coalesce(F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", call)), F.array().cast(call)), lambda c: c.isNotNull())
    result = F.when((F.col("role") == "tool") & F.col("conv_id").isNotNull(), F.try_variant_get("v", "$.tool_call_id", "string"))
    row = row.select("*", calls.alias("calls"), result.alias("tool_call_id"))
    structured = (F.size("calls") > 0) | F.col("tool_call_id").isNotNull()
    content = F.try_variant_get("v", "$.content", "variant")
    plain = F.when(structured, F.coalesce(F.try_variant_get("v", "$.content", "string"), F.to_json(content), F.lit(""))).otherwise(F.col("text"))
    uid = F.xxhash64(F.lit("message"), "conv_id", "turn", "role", "text")
    return row.select("conv_id", "turn", "role", uid.alias("uid"), plain.alias("content"), "calls", "tool_call_id")


def _calls(parsed: DataFrame, tools: dict[str, dict[str, Any]]) -> DataFrame:
    """One row per call, with its arguments as canonical JSON, what it depends on, and whether it is valid."""
    # repeated rows share their uid: their calls count once, and each of the rows gets them
    once = parsed.where("conv_id IS NOT NULL AND size(calls) > 0").select("conv_id", "turn", "uid", "calls").dropDuplicates(["conv_id", "uid"])
    one = once.select("conv_id", "turn", "uid", F.posexplode("calls").alias("i", "c")).select("conv_id", "turn", "uid", "i", F.col("c.id").alias("id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("a"), F.col("c.depends_on").alias("d"))
    as_text = F.try_variant_get("a", "$", "string")
    args = F.when(F.schema_of_variant("a") == "STRING", F.try_parse_json(as_text)).otherwise(F.col("a"))
    one = one.withColumn("args", args)
    one = one.withColumn("arguments", F.coalesce(F.to_json("args"), as_text))
    known = F.lit("unknown_tool")
    for name, schema in tools.items():
        known = F.when(F.col("name") == name, F.when(_valid(F.col("args"), schema), "valid").otherwise("invalid")).otherwise(known)
    check = F.when(F.col("id").isNull() | F.col("name").isNull(), "malformed").when(F.col("args").isNull() | ~_is(F.col("args"), "object"), "invalid").otherwise(known)
    named = F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r'"\$([A-Za-z0-9_\-]+)"'), F.lit(1))
    needs = F.array_distinct(F.concat(F.coalesce("d", F.array().cast("array<string>")), named))
    return one.select("conv_id", "turn", "uid", "i", "id", "name", "arguments", needs.alias("needs"), check.alias("check"))


def link(messages: DataFrame, tools: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, order_turn, level, is_result, n_calls, n_answered, n_invalid, status, json.

    status: ``plain``, ``calls``, ``linked``, ``orphan`` (a result without its call), ``duplicate`` (of an id already used)
    or ``cycle`` (calls that wait for each other).
    """
    parsed = parse(messages)
    calls = cut(_calls(parsed, TOOLS if tools is None else tools))
    order = F.struct(F.coalesce("turn", F.lit(-(1 << 62))), "uid", "i")
    first = calls.where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct(order.alias("o"), "turn", "uid", "i", "needs")).alias("f")).select("conv_id", "id", "f.turn", "f.uid", "f.i", "f.needs")
    results = parsed.where("tool_call_id IS NOT NULL").select("conv_id", F.col("tool_call_id").alias("id"), "turn", "uid")
    first_result = results.groupBy("conv_id", "id").agg(F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("o"), "uid", "turn")).alias("r")).select("conv_id", "id", F.col("r.uid").alias("r_uid"), F.col("r.turn").alias("r_turn"))
    linked = cut(first.join(first_result.hint("shuffle_hash"), ["conv_id", "id"], "left"))

    # levels: a call is placed when the results of all calls that it needs are
    needs = cut(linked.select("conv_id", "id", F.explode("needs").alias("need")).join(linked.select("conv_id", F.col("id").alias("need"), "turn", "r_turn"), ["conv_id", "need"]).select("conv_id", "id", "need"))
    late = F.greatest(F.coalesce("turn", F.lit(-(1 << 62))), F.coalesce("r_turn", F.lit(-(1 << 62))))
    waiting = needs.select("conv_id", "id").distinct()
    placed = linked.join(waiting, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).alias("level"), F.coalesce("turn", F.lit(-(1 << 62))).alias("at"), late.alias("done"))
    if needs.limit(1).count():
        placed = cut(placed)
        for level in itertools.count(1):
            left = linked.join(placed.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
            met = needs.join(placed.select("conv_id", F.col("id").alias("need"), F.col("done").alias("need_done")), ["conv_id", "need"], "left")
            ready = met.groupBy("conv_id", "id").agg(F.max(F.col("need_done").isNull()).alias("open"), F.max("need_done").alias("after")).where("NOT open")
            now = left.join(ready, ["conv_id", "id"]).withColumn("at", F.greatest(F.coalesce("turn", F.lit(-(1 << 62))), "after"))
            now = cut(now.select("conv_id", "id", F.lit(level).alias("level"), "at", F.greatest("at", F.coalesce("r_turn", F.lit(-(1 << 62)))).alias("done")))
            if not now.limit(1).count():
                break
            placed = cut(placed.unionByName(now))
    whole = linked.join(placed, ["conv_id", "id"], "left").select("conv_id", "id", "uid", "i", "r_uid", F.col("level").alias("call_level"), "at", "done")

    per_call = calls.join(whole.withColumnRenamed("uid", "f_uid").withColumnRenamed("i", "f_i"), ["conv_id", "id"], "left")
    mine = (F.col("f_uid") == F.col("uid")) & (F.col("f_i") == F.col("i"))
    per_call = per_call.withColumn("mine", F.coalesce(mine, F.lit(False)))
    shown = F.to_json(F.struct(F.struct("arguments", "name").alias("function"), "id", F.lit("function").alias("type")))
    by_message = per_call.groupBy("conv_id", "uid").agg(
        F.sum((F.col("mine") & F.col("r_uid").isNotNull()).cast("long")).alias("n_answered"),
        F.sum((F.col("check") != "valid").cast("long")).alias("n_invalid"),
        F.max((F.col("id").isNotNull() & ~F.col("mine")).cast("int")).alias("dup"),
        F.max((F.col("mine") & F.col("call_level").isNull()).cast("int")).alias("cycle"),
        F.max(F.when(F.col("mine"), F.col("call_level"))).alias("c_level"),
        F.max(F.when(F.col("mine"), F.col("at"))).alias("c_at"),
        F.array_sort(F.collect_list(F.struct("i", "check", shown.alias("j")))).alias("cs"),  # of one message
    ).withColumnRenamed("uid", "c_uid").withColumnRenamed("conv_id", "c_conv")
    answers = whole.where("r_uid IS NOT NULL").select(F.col("conv_id").alias("r_conv"), F.col("id").alias("r_id"), "r_uid", F.col("call_level").alias("r_level"), "done")
    out = parsed.select("conv_id", "turn", "role", "uid", "content", "tool_call_id", F.size("calls").cast("long").alias("n_calls"))
    out = out.join(by_message, (F.col("conv_id") == F.col("c_conv")) & (F.col("uid") == F.col("c_uid")) & (F.col("n_calls") > 0), "left")
    known = whole.select(F.col("conv_id").alias("k_conv"), F.col("id").alias("k_id"))
    out = out.join(answers, (F.col("conv_id") == F.col("r_conv")) & (F.col("tool_call_id") == F.col("r_id")) & (F.col("uid") == F.col("r_uid")), "left")
    out = out.join(known, (F.col("conv_id") == F.col("k_conv")) & (F.col("tool_call_id") == F.col("k_id")), "left")
    is_result = F.col("tool_call_id").isNotNull()
    status = (
        F.when(is_result & F.col("k_id").isNull(), "orphan").when(is_result & F.col("r_uid").isNull(), "duplicate").when(is_result, "linked")
        .when(F.coalesce("cycle", F.lit(0)) > 0, "cycle").when(F.coalesce("dup", F.lit(0)) > 0, "duplicate").when(F.col("n_calls") > 0, "calls").otherwise("plain")
    )
    entries = F.transform("cs", lambda c: F.parse_json(c.j))
    record = F.struct(F.col("content"), F.col("role"), F.when(is_result, F.col("tool_call_id")).alias("tool_call_id"), F.when(F.size("cs") > 0, entries).alias("tool_calls"))
    return out.select(
        "conv_id", "turn", "role",
        F.greatest("turn", F.when(is_result, F.col("done")).otherwise(F.col("c_at"))).alias("order_turn"),
        F.coalesce("c_level", "r_level", F.lit(0)).alias("level"), is_result.alias("is_result"), "n_calls",
        F.coalesce("n_answered", F.lit(0).cast("long")).alias("n_answered"), F.coalesce("n_invalid", F.lit(0).cast("long")).alias("n_invalid"),
        status.alias("status"), F.to_json(F.parse_json(F.to_json(record))).alias("json"),
    )
