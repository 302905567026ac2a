"""Chat formatting: tool calls are linked with their results, in DataFrame functions alone.

An assistant's text that is a JSON object with `tool_calls` (objects of id, name and arguments, or with these in `function`) calls
tools; a tool's text that is a JSON object with `tool_call_id` is a result. Blanks around an object don't matter. Calls and results
are joined by conversation and identifier. Messages are in topological order by (order_turn, order_index): every message stands at
its turn, but a result that stands before its call moves right behind it. Arguments are checked against the tool's schema; those
given as text are read as JSON first. Each message is one line of canonical JSON: keys sorted, no blanks. It holds the whole object
that the message is, so that no field is lost; nulls of an object stay, fields that a message lacks are left out.

The result has one row for each message, so that a conversation of very many messages is never one task's; the joins are
on identifiers, which deal such a conversation out.

Cases: null texts and texts that are no such object (or have a key twice) are plain messages; a result without an identifier or whose
call is missing is not linked and keeps its place; an identifier used twice in a conversation belongs to its first call, and all
results with it are linked to that; repeated rows are repeated messages, and ties of turn keep one order number; calls without an
identifier are never answered; calls of tools without a schema, or with arguments that are no object, are invalid, and arguments that
cannot be read stay as text; rows of null conversations are in no link, those of null turns are; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tool: field: (kinds of value, required). Kinds are those of schema_of_variant.
SCHEMAS: dict[str, dict[str, tuple[tuple[str, ...], bool]]] = {
    "search": {"query": (("STRING",), True), "limit": (("BIGINT",), False)},
    "fetch": {"url": (("STRING",), True)},
    "calculate": {"expression": (("STRING",), True)},
}


def _valid(name: Column, args: Column, schemas: dict) -> Column:
    out = F.lit(False)
    for tool, fields in schemas.items():
        right = F.coalesce(F.schema_of_variant(args).startswith("OBJECT"), F.lit(False))
        for k, (kinds, required) in fields.items():
            kind = F.schema_of_variant(F.try_variant_get(args, f"$.{k}", "variant"))
            fits = F.regexp_replace(kind, r"[(<].*", "").isin(*kinds)
            right = right & F.coalesce(fits, F.lit(not required))
        out = F.when(name == tool, right).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _call(c: Column) -> Column:
    """arguments (read from text where they are text), id, name of a call."""
    get = lambda path, kind: F.coalesce(F.try_variant_get(c, f"$.{path}", kind), F.try_variant_get(c, f"$.function.{path}", kind))
    raw = get("arguments", "variant")
    is_text = F.schema_of_variant(raw) == "STRING"
    read = F.coalesce(F.try_parse_json(F.when(is_text, F.try_variant_get(raw, "$", "string"))), raw)
    return F.struct(read.alias("arguments"), F.try_variant_get(c, "$.id", "string").alias("id"), get("name", "string").alias("name"))


def linked(messages: DataFrame, schemas: dict = SCHEMAS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, order_turn, order_index, n_calls, n_valid, n_answered, linked (null but for tools' messages), json."""
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    m = m.withColumn("o", F.when(F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^\s*\{"), F.try_parse_json(trimmed)))
    m = m.withColumn("listed", F.when(F.col("role") == "assistant", F.try_variant_get("o", "$.tool_calls", "array<variant>")))
    m = m.withColumn("call_id", F.when(F.col("role") == "tool", F.try_variant_get("o", "$.tool_call_id", "string")))
    is_call, is_result = F.coalesce(F.size("listed") > 0, F.lit(False)), F.col("call_id").isNotNull()
    said = m.where(is_call).withColumn("key", F.xxhash64("text")).withColumn("calls", F.transform("listed", _call))

    calls = said.select("conv_id", "turn", "key", F.posexplode("calls.id").alias("at", "call_id"))
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "at", "key")).alias("own"))
    results = m.where(is_result)
    answered = results.select("conv_id", "call_id").distinct()
    known = first.join(answered, ["conv_id", "call_id"], "left_semi").groupBy("conv_id", F.col("own.turn").alias("turn"), F.col("own.key").alias("key")).agg(F.count("*").alias("n_answered"))
    known = known.withColumnsRenamed({"conv_id": "c2", "turn": "t2", "key": "k2"})

    said = said.join(known, (F.col("conv_id") == F.col("c2")) & F.col("turn").eqNullSafe(F.col("t2")) & (F.col("key") == F.col("k2")), "left").select(
        "conv_id", "turn", "role",
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_index"),
        F.size("calls").alias("n_calls"),
        F.size(F.filter("calls", lambda c: _valid(c["name"], c["arguments"], schemas))).alias("n_valid"),
        F.coalesce("n_answered", F.lit(0)).cast("int").alias("n_answered"),
        F.lit(None).cast("boolean").alias("linked"),
        F.to_json(F.struct("calls", F.col("o").alias("message"), "role")).alias("json"),
    )
    places = first.select("conv_id", "call_id", F.col("own.turn").alias("t"), F.col("own.at").alias("i"))
    got = results.join(places, ["conv_id", "call_id"], "left")
    moved = F.col("t") >= F.col("turn")
    got = got.select(
        "conv_id", "turn", "role",
        F.when(moved, F.col("t")).otherwise(F.col("turn")).alias("order_turn"), F.when(moved, F.col("i") + 1).otherwise(0).alias("order_index"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid"), F.lit(0).alias("n_answered"),
        F.col("i").isNotNull().alias("linked"),
        F.to_json(F.struct(F.col("o").alias("message"), "role")).alias("json"),
    )
    plain = m.where(~is_call & ~is_result).select(
        "conv_id", "turn", "role",
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_index"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid"), F.lit(0).alias("n_answered"),
        F.when(F.col("role") == "tool", F.lit(False)).alias("linked"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    return plain.unionByName(said).unionByName(got)
