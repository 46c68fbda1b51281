"""Chat formatting: tool calls linked to results, put in dependency order, checked and serialised as canonical JSON.

A message whose text is a JSON object with ``tool_calls`` (a list of objects
with ``id``, ``name`` and ``arguments``) makes calls; one with
``tool_call_id`` is a result. Everything else is plain text. Calls and results
are hash-joined on (conversation, identifier). The dependency order is the
order of turns, except that a result never stands before its call: one that
does moves right behind it. Arguments are checked against the JSON schema of
the tool (type, properties, required, additionalProperties, items, enum).

Output is one row per message, so a conversation of any length is never in one
place: rows are range-partitioned by (conversation, order), numbered in their
task, and a prefix sum over (task, conversation) counts gives positions.

``status`` is ``text``; for calls ``linked``, ``open`` (no result) or
``invalid`` (arguments against the schema, or unreadable); for results
``linked``, ``orphan`` (no call) or ``repeated`` (the call has an earlier
result). A message of several calls has its worst status.

Defined results: null role is ``unknown``, null text is empty; null
conv_id rows are one conversation; null turns come first; repeated rows and
equal turns are ordered by role and text and all stay; identifiers are looked
for in their conversation only, and of calls that share one, the first counts;
an empty table gives no rows; further columns are ignored. A text that is not
JSON (NaN and Infinity are not), or nested too deeply to read, is plain text;
such arguments are invalid and stay text; lone surrogates stay escapes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.llm.tables import table
from pinweave.storage import settled

#: Schemas of the tools that the query knows; calls of other tools are not checked.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}

_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
}

#: Characters of a text by which rows are dealt into ranges.
BEGINNING = 64


_LONE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; characters stay as they are, but for lone surrogates, which UTF-8 lacks and which stay escaped."""
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _escaped(text: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _number(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _refuse(digits)


def loaded(text: str) -> object:
    """The JSON value of a text. NaN and infinities, also by overflow, are not JSON."""
    return json.loads(text, parse_constant=_refuse, parse_float=_number)


def valid(value: object, schema: dict) -> bool:
    """Whether ``value`` fits the schema."""
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        own = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])):
            return False
        extra = schema.get("additionalProperties", True)
        for k, x in value.items():
            rule = own.get(k, extra)
            if rule is False or isinstance(rule, dict) and not valid(x, rule):
                return False
    return not isinstance(value, list) or "items" not in schema or all(valid(x, schema["items"]) for x in value)


def parsed(role: str, text: str, schemas: dict[str, dict]) -> tuple[str, list[str], bool, str]:
    """(kind, identifiers, all arguments valid, canonical message)."""
    try:
        return _parsed(role, text, schemas)
    except RecursionError:
        return "text", [], True, canonical({"content": text, "role": role})


def _parsed(role: str, text: str, schemas: dict[str, dict]) -> tuple[str, list[str], bool, str]:
    body = None
    if text.lstrip()[:1] == "{" and "tool_call" in text:
        try:
            body = loaded(text)
        except ValueError:
            body = None
    if isinstance(body, dict) and isinstance(body.get("tool_calls"), list) and body["tool_calls"]:
        calls, ids, fine = [], [], True
        for call in body["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            arguments = call.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = loaded(arguments)
                except ValueError:
                    fine = False
            name, id_ = str(call.get("name", "")), call.get("id")
            fine &= id_ is not None and (name not in schemas or valid(arguments, schemas[name]))
            calls.append({"arguments": arguments, "id": id_, "name": name})
            if id_ is not None:
                ids.append(_escaped(str(id_)))
        return "call", ids, fine, canonical({"content": body.get("content"), "role": role, "tool_calls": calls})
    if isinstance(body, dict) and body.get("tool_call_id") is not None:
        return "result", [_escaped(str(body["tool_call_id"]))], True, canonical({"content": body.get("content"), "role": role, "tool_call_id": body["tool_call_id"]})
    return "text", [], True, canonical({"content": text, "role": role})


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, position, turn, role, kind, status, message for every row of ``messages``."""
    schemas = SCHEMAS if schemas is None else schemas
    schema = "conv_id long, turn long, role string, text string, kind string, ids array<string>, fine boolean, message string"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed(r.as_py(), x.as_py(), schemas) for r, x in zip(batch.column("role"), batch.column("text"), strict=True)]
            kind, ids, fine, message = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(kind, pa.string()), pa.array(ids, pa.list_(pa.string())), pa.array(fine, pa.bool_()), pa.array(message, pa.string())], names)

    plain = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = settled(plain.mapInArrow(read, schema), "messages")

    # (turn, role, text) names a message in its conversation, and its copies alike
    order = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text")
    use = rows.where("kind <> 'text'").select("conv_id", "kind", order.alias("at"), F.explode("ids").alias("id"))
    firsts = {k: use.where(F.col("kind") == k).groupBy("conv_id", "id").agg(F.min("at").alias(f"{k}_at")) for k in ("call", "result")}
    both = firsts["call"].join(firsts["result"].toDF("_c", "_i", "result_at"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i")), "full")
    links = settled(both.select(F.coalesce("conv_id", "_c").alias("_conv"), F.coalesce("id", "_i").alias("_id"), "call_at", "result_at"), "links")

    results = rows.where("kind = 'result'").withColumn("_key", F.col("ids")[0]).join(links, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_key") == F.col("_id")), "left")
    status = F.when(F.col("call_at").isNull(), "orphan").when(order == F.col("result_at"), "linked").otherwise("repeated")
    results = results.select("conv_id", "turn", "role", "text", "kind", "message", status.alias("status"), F.greatest(order, F.col("call_at")).alias("anchor"), F.lit(1).alias("behind"))
    calls = rows.where("kind = 'call'").withColumn("_key", F.explode_outer("ids")).join(links, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_key") == F.col("_id")), "left")
    # copies of a message fall together here; their number comes back
    calls = calls.groupBy("conv_id", "turn", "role", "text", "kind", "message", "fine").agg(F.min(F.col("result_at").isNotNull().cast("int")).alias("answered"), (F.count("*") / F.greatest(F.max(F.size("ids")), F.lit(1))).cast("int").alias("copies"))
    calls = calls.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    calls = calls.select("conv_id", "turn", "role", "text", "kind", "message", F.when(~F.col("fine"), "invalid").when(F.col("answered") == 1, "linked").otherwise("open").alias("status"), order.alias("anchor"), F.lit(0).alias("behind"))
    texts = rows.where("kind = 'text'").select("conv_id", "turn", "role", "text", "kind", "message", F.lit("text").alias("status"), order.alias("anchor"), F.lit(0).alias("behind"))
    every = texts.unionByName(calls).unionByName(results)

    keys = ["conv_id", F.col("anchor.turn"), F.col("anchor.role"), F.col("anchor.text"), "behind", "turn", "role", "text"]
    out = "conv_id long, turn long, role string, kind string, status string, message string, shard int, nth long"
    columns = [x.split()[0] for x in out.split(", ")]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            nth = []
            for conv in batch.column("conv_id").to_pylist():
                now, n = conv, (n + 1 if conv == now else 0)
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:6]), pa.array([shard] * len(nth), pa.int32()), pa.array(nth, pa.int64())], columns)

    # whole texts would be sampled to the driver and kept as bounds; their beginnings part the rows in the same order
    ranges = ["conv_id", F.col("anchor.turn"), F.col("anchor.role"), F.substring("anchor.text", 1, BEGINNING)]
    placed = settled(every.repartitionByRange(*ranges).sortWithinPartitions(*keys).select(*columns[:6]).mapInArrow(numbered, out), "placed")
    counts = placed.groupBy("shard", "conv_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("shard").alias("_s"), F.col("conv_id").alias("_c"), before.alias("before")).where("before > 0")
    joined = placed.join(offsets, (F.col("shard") == F.col("_s")) & F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return joined.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("position"), "turn", "role", "kind", "status", "message")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in its place, as canonical JSON."""
    return format_chats(table(spark, sf_dir, "conversations"))


#: The tables' messages hold no tool calls; that calls and results are linked is tested on fixtures.
SQL = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS position,
  turn, coalesce(role, 'unknown') AS role, 'text' AS kind, 'text' AS status,
  '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, 'unknown')) AS VARCHAR) || '}' AS message
FROM conversations
"""
