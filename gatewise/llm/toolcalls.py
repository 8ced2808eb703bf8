"""Chat formatting (operator 7): tool calls are linked to their results, ordered, checked and written as canonical JSON.

Only DataFrame and SQL operations: no Python runs on the executors.

Calls and results are hash-joined by conversation and identifier. A call may need the result of another
(``after``); its depth is its distance from a call that needs none, found by pointer doubling, so a
chain of n calls takes log n joins. Arguments are parsed and each field of the tool's schema is
checked for presence and type. Canonical JSON has sorted keys, no spaces and one spelling of each
number. Messages are rows of their own, so a conversation of any length is never one group.

Defined results: text that is no JSON object has the error ``arguments``; a call of an unknown tool
the error ``tool``; missing, mistyped and unknown fields are named; a call without result has status
``open``; results without call are written as ``orphan``; of several results the first by turn is
linked, the others are orphans; of calls with the same identifier each is linked to that result;
calls in or behind a circle, or after an unknown call, have no depth; null identifiers match
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.llm.scratch import table

#: JSON kinds a schema may name, and the kinds a parsed value may have for each (fixed values).
KINDS = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DECIMAL\\(\\d+,\\d+\\)|DOUBLE|FLOAT",
    "boolean": "BOOLEAN",
    "object": "OBJECT<.*>",
    "array": "ARRAY<.*>",
}


def depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth`` of ``calls(conv_id, call_id, after)``, null in circles and behind them.

    Each round doubles the distance every call looks back; what still looks back once the distance
    passes the number of calls is in a circle.
    """
    own = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    steps = table(own.groupBy("conv_id", "call_id").agg(F.max("after").alias("after")).withColumn("depth", F.expr("CAST(IF(after IS NULL, 0, 1) AS BIGINT)")), "depths")
    reach, calls_there = 1, None
    while not steps.where("after IS NOT NULL").isEmpty():
        calls_there = calls_there or steps.count()
        if reach > calls_there:
            break
        ahead = steps.select("conv_id", F.col("call_id").alias("after"), F.col("after").alias("next"), F.col("depth").alias("more"), F.lit(True).alias("there"))
        steps = table(
            steps.join(ahead.hint("shuffle_hash"), ["conv_id", "after"], "left").select(
                "conv_id",
                "call_id",
                F.when(F.col("after").isNotNull() & F.col("there").isNull(), F.col("after")).otherwise(F.col("next")).alias("after"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            "depths",
        )
        reach *= 2
    return steps.select("conv_id", "call_id", F.when(F.col("after").isNull(), F.col("depth")).alias("depth"))


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, str]]) -> Column:
    """What is wrong with arguments (JSON text) by the schema of the tool: sorted texts, none if all is well.

    A schema names the kind of each field; a ``?`` behind it makes the field optional.
    """
    value = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(value).startswith("OBJECT<")
    found = F.when(F.lit(True), F.array().cast("array<string>"))
    out = F.array(F.lit("tool"))
    for tool, fields in schemas.items():
        wrong = []
        for field, kind in fields.items():
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            absent = got.isNull() | (got == "VOID")
            fault = F.when(~absent & ~got.rlike(f"^({KINDS[kind.rstrip('?')]})$"), f"{field}: not {kind.rstrip('?')}")
            wrong.append(fault if kind.endswith("?") else F.when(absent, f"{field}: missing").otherwise(fault))
        known = F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")
        extra = F.array_except(F.json_object_keys(F.to_json(value)), known)
        extra = F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda k: F.concat(k, F.lit(": unknown")))
        faults = F.concat(F.array_compact(F.array(*wrong)) if wrong else found, extra)
        checked = F.when(F.coalesce(is_object, F.lit(False)), F.array_sort(faults)).otherwise(F.array(F.lit("arguments")))
        out = F.when(name == tool, checked).otherwise(out)
    return out


def format_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, str]], messages: DataFrame | None = None) -> DataFrame:
    """Messages of a conversation, calls with their results: ``conv_id, turn, kind, call_id, depth, status, errors, json``.

    ``calls``: ``conv_id, turn, call_id, after, name, arguments``. ``results``: ``conv_id, turn,
    call_id, content``. ``messages``, all other turns: ``conv_id, turn, role, content``. Within a
    conversation ``depth, turn`` is a topological order of the calls; ``kind`` is ``call``, ``orphan``
    or ``message``, ``status`` is ``done``, ``open``, ``invalid`` or, of the other kinds, the kind.
    """
    # The first result of an identifier, by an aggregate, so that no group is sorted whole.
    firsts = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("result"))
    own = _joined(_joined(calls, depths(calls)), firsts)
    own = own.withColumn("errors", errors(F.col("name"), F.col("arguments"), schemas))
    own = own.withColumn("status", F.when(F.size("errors") > 0, "invalid").when(F.col("result").isNull(), "open").otherwise("done"))
    body = F.coalesce(canonical(F.col("arguments")), F.lit("null"))
    json = F.concat(
        F.lit('{"arguments":'), body,
        F.lit(',"depth":'), F.coalesce(F.col("depth").cast("string"), F.lit("null")),
        F.lit(',"id":'), _text("call_id"),
        F.lit(',"name":'), _text("name"),
        F.lit(',"result":'), _text("result.content"),
        F.lit(',"status":'), _text("status"), F.lit("}"),
    )
    linked = own.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "depth", "status", F.array_join("errors", "; ").alias("errors"), json.alias("json"))
    known = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id", F.lit(True).alias("asked")).distinct()
    orphans = _joined(_joined(results, firsts.select("conv_id", "call_id", F.col("result.turn").alias("first_turn"))), known)
    orphans = orphans.where("asked IS NULL OR NOT turn <=> first_turn")
    json = F.concat(F.lit('{"id":'), _text("call_id"), F.lit(',"result":'), _text("content"), F.lit(',"status":"orphan"}'))
    rest = orphans.select("conv_id", "turn", F.lit("orphan").alias("kind"), "call_id", F.lit(None).cast("long").alias("depth"), F.lit("orphan").alias("status"), F.lit("").alias("errors"), json.alias("json"))
    out = linked.unionByName(rest)
    if messages is None:
        return out
    json = F.concat(F.lit('{"content":'), _text("content"), F.lit(',"role":'), _text("role"), F.lit("}"))
    plain = {"kind": F.lit("message"), "call_id": F.lit(None).cast("string"), "depth": F.lit(None).cast("long"), "status": F.lit("message"), "errors": F.lit(""), "json": json}
    return out.unionByName(messages.select("conv_id", "turn", *[value.alias(name) for name, value in plain.items()]))


def _joined(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Hash join by identifier; the hashed side has one row per identifier, so rows of a frequent one only stream past."""
    return rows.join(one.hint("shuffle_hash"), ["conv_id", "call_id"], "left")


def _text(name: str) -> Column:
    """A JSON string, or null."""
    return F.coalesce(_quoted(F.col(name)), F.lit("null"))


def _quoted(text: Column) -> Column:
    inside = F.regexp_extract(F.to_json(F.struct(text.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(text.isNotNull(), inside)
