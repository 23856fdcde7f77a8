"""Chat formatting with linked tool calls (operator 3).

Calls and results meet in a hash join by identifier, calls are ordered
topologically, arguments are checked against schemas, and each link becomes one
canonical JSON record: keys sorted, no blanks. Only column expressions are used.

A call may name earlier calls whose results it needs; its level is one more than the highest
of theirs. Chains of calls with one need each are followed by pointer doubling: each round
joins a call to the call its pointer has reached, so a chain of length n takes log2(n)
rounds. What is left are calls with several needs, whose levels follow in as many rounds as
such calls stand above each other. A conversation of any length stays spread over all tasks;
nothing is gathered by conversation.

In ``conversations`` an assistant message that is a JSON object with ``tool_calls``
makes these calls, and a tool message with ``tool_call_id`` gives a result. Every user
turn is a call ``reply`` for an answer, with its text and turn as arguments; an assistant
message without tool calls (an empty list of them is none) is the result of the turn before it,
as it stands. A reply needs the call two turns earlier, if there is one. ``after`` of a tool call is one
identifier or a list of them.

Every message is in the result. ``kind`` tells what a row is: a ``call`` (one row for each of its
results, or one without), a ``result`` that no call asked for, a ``repeat`` (a further, differing call
with an identifier that is taken), or a ``message``: system messages and other roles, the ``content``
beside tool calls, calls and results without an identifier, and messages without conversation, turn or role.

Defined results: a null text is JSON null and fails its schema; of repeated calls with one identifier the smallest
(name, arguments, needs) is the call, the others are repeats; equal rows are one, and ``n_results``
counts all results; results without a call have a null name; calls on a cycle, or
above one, have a null level; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.llm.common import column
from tabscore.session import materialize

# By tool: field, type (string, integer, number, boolean, object, array) and whether it must be there.
Schema = dict[str, dict[str, tuple[str, bool]]]
REPLY: Schema = {"reply": {"text": ("string", True), "turn": ("integer", True)}}
KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}
TOOL_CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:string>>"


def _is(value: Column, kind: str) -> Column:
    told = F.schema_of_variant(value)
    checks = [told.startswith(name) for name in KINDS[kind]]
    out = checks[0]
    for c in checks[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def _valid(name: Column, arguments: Column, schemas: Schema) -> Column:
    """Whether the arguments are an object that fits the schema of the tool; an unknown tool has none to fit."""
    out = F.lit(False)
    for tool, fields in schemas.items():
        fits = _is(arguments, "object")
        for field, (kind, needed) in fields.items():
            value = F.try_variant_get(arguments, f"$['{field}']", "variant")
            fits = fits & (_is(value, kind) if needed else (value.isNull() | _is(value, kind)))
        out = F.when(name == tool, fits).otherwise(out)
    return F.coalesce(out, F.lit(False))


def levels(calls: DataFrame) -> DataFrame:
    """``call_id`` and ``level`` (0 for a call that needs none) of calls with distinct ``call_id``; ``after`` is an identifier or an array of them."""
    needs = F.col("after") if isinstance(calls.schema["after"].dataType, T.ArrayType) else F.array("after")
    known = calls.select(F.col("call_id").alias("known"))
    # A need that is no call is none.
    edges = calls.select("call_id", F.explode(needs).alias("need")).distinct().join(known, F.col("need") == F.col("known"), "left_semi")
    edges = materialize(edges, "needs")
    counted = edges.groupBy(F.col("call_id").alias("of")).agg(F.count("*").alias("n"), F.min("need").alias("need"))
    start = calls.select("call_id").join(counted, F.col("call_id") == F.col("of"), "left")
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    # A call with one need moves on; the others are where the moving ends.
    now = start.select(F.col("call_id").alias("id"), F.when(single, F.col("need")).otherwise(F.col("call_id")).alias("at"), single.cast("long").alias("steps"), (~single).alias("done"), F.coalesce("n", F.lit(0)).alias("n"))
    now = materialize(now, "levels")
    rounds = math.ceil(math.log2(max(now.count(), 1))) + 1
    for _ in range(rounds):
        if now.filter("not done").isEmpty():
            break
        reached = now.select(F.col("id").alias("here"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("done").alias("end"))
        moved = now.filter("not done").join(reached, F.col("at") == F.col("here")).select("id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("done"), "n")
        now = materialize(moved.union(now.filter("done")), "levels")
    # What has not arrived by now is on a cycle or leads to one.
    ends = now.filter("id = at and n = 0").select(F.col("id").alias("end"), F.lit(0).cast("long").alias("base"))
    if not now.filter("n > 1").isEmpty():
        ends = _joined_levels(edges, now, ends)
    placed = now.join(ends, F.col("done") & (F.col("at") == F.col("end")), "left")
    return placed.select(F.col("id").alias("call_id"), (F.col("base") + F.col("steps")).alias("level"))


def _joined_levels(edges: DataFrame, now: DataFrame, ends: DataFrame) -> DataFrame:
    """``end`` and ``base`` of all calls at which chains end, those with several needs included; those above a cycle are left out."""
    several = now.filter("n > 1").select(F.col("id").alias("top"), F.col("n").alias("wanted"))
    below = edges.join(several, F.col("call_id") == F.col("top")).join(now.filter("done").select("id", "at", "steps"), F.col("need") == F.col("id"))
    below = materialize(below.select("top", "wanted", "at", (F.col("steps") + 1).alias("steps")), "joined-needs")
    ends = materialize(ends, "ends")
    while True:
        # A call is settled when all its needs are; each round goes one such call up.
        met = below.join(ends, F.col("at") == F.col("end")).groupBy("top", "wanted").agg(F.count("*").alias("met"), F.max(F.col("base") + F.col("steps")).alias("base"))
        fresh = met.filter("met = wanted").join(ends.select("end"), F.col("top") == F.col("end"), "left_anti")
        fresh = materialize(fresh.select(F.col("top").alias("end"), "base"), "ends")
        if fresh.isEmpty():
            return ends
        ends = materialize(ends.union(fresh), "ends")


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """One row per call and result, per call without a result, per result without a call, and per repeated call.

    ``calls``: conv_id, call_id, name, arguments (JSON text), after (array); ``results``: conv_id,
    call_id, turn, content. Returns ``conv_id``, ``call_id``, ``kind``, ``name``, ``level``, ``n_results``,
    ``turn`` (of the result), ``linked``, ``valid`` and the canonical record ``call_json``.
    """
    call = F.struct("name", "arguments", "after", "conv_id")
    one = calls.filter("call_id is not null").groupBy("call_id").agg(F.min(call).alias("c"), (F.min(call) != F.max(call)).alias("several"))
    one = materialize(one.select("call_id", "c.*", "several"), "calls")
    told = results.filter("call_id is not null")
    counts = told.groupBy(F.col("call_id").alias("answers")).agg(F.count("*").alias("n"), F.min("conv_id").alias("answer_conv"))
    placed = one.join(levels(one.select("call_id", "after")).withColumnRenamed("call_id", "placed").hint("shuffle_hash"), F.col("call_id") == F.col("placed"))
    both = placed.join(counts.hint("shuffle_hash"), F.col("call_id") == F.col("answers"), "full").select(
        F.coalesce("conv_id", "answer_conv").alias("conv_id"),
        F.coalesce("call_id", "answers").alias("id"),
        F.when(F.col("call_id").isNotNull(), "call").otherwise("result").alias("kind"),
        "name",
        "arguments",
        "level",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_results"),
    )
    both = materialize(both, "links")
    # One row an identifier on this side: an identifier with very many results is split on the other one.
    answers = told.select(F.col("call_id").alias("answers"), "turn", "content").distinct()
    met = answers.join(both.hint("shuffle_hash"), F.col("answers") == F.col("id")).select(*both.columns, "turn", "content")
    alone = both.filter("n_results = 0").select("*", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("content"))
    rows = met.union(alone)
    if not one.filter("several").isEmpty():
        first = one.filter("several").select(F.col("call_id").alias("id"), call.alias("first"))
        again = calls.filter("call_id is not null").distinct().join(first, F.col("call_id") == F.col("id")).filter(~call.eqNullSafe(F.col("first")))
        again = again.select("conv_id", "id", F.lit("repeat").alias("kind"), "name", "arguments", *[F.lit(None).cast(t).alias(c) for c, t in (("level", "long"), ("n_results", "long"), ("turn", "long"), ("content", "string"))])
        rows = rows.union(again.withColumn("n_results", F.lit(0).cast("long")).distinct())
    rows = rows.withColumn("parsed", F.try_parse_json("arguments"))
    record = F.struct(F.col("parsed").alias("arguments"), "id", "name", F.col("content").alias("result"))
    return rows.select(
        "conv_id",
        F.col("id").alias("call_id"),
        "kind",
        "name",
        "level",
        "n_results",
        "turn",
        ((F.col("kind") == "call") & (F.col("n_results") > 0)).alias("linked"),
        _valid(F.col("name"), F.col("parsed"), schemas).alias("valid"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("call_json"),
    )


def conversation_parts(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and all other messages of a table of messages (conv_id, turn, role, text)."""
    m = messages.select(column("conv_id").cast("long").alias("conv_id"), column("turn").cast("long").alias("turn"), column("role").cast("string").alias("role"), column("text").cast("string").alias("text"))
    lost = m.filter("conv_id is null or turn is null or role is null")
    m = m.filter("conv_id is not null and turn is not null and role is not null")

    def named(turn: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))

    def tool_id(given: Column) -> Column:
        # Null without an identifier: such a message neither calls nor answers.
        return F.concat(F.col("conv_id").cast("string"), F.lit(":tool:"), given)

    told = F.when((F.col("role") == "assistant") & F.startswith(F.ltrim("text"), F.lit("{")), F.from_json("text", TOOL_CALLS)["tool_calls"])
    made = m.withColumn("made", F.explode(told))
    # A need is one identifier or a JSON list of them.
    given = F.coalesce(F.when(F.startswith("made.after", F.lit("[")), F.from_json("made.after", "array<string>")), F.array("made.after"))
    asked = m.filter("role = 'user'").select(
        "conv_id",
        named(F.col("turn")).alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"}).alias("arguments"),
        F.array(named(F.col("turn") - 2)).alias("after"),
    )
    calls = made.filter("made.id is not null").select("conv_id", tool_id(F.col("made.id")).alias("call_id"), "made.name", "made.arguments", F.transform(F.filter(given, lambda g: g.isNotNull()), tool_id).alias("after"))
    plain = m.filter((F.col("role") == "assistant") & (told.isNull() | (F.size(told) == 0))).select("conv_id", named(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    link = F.get_json_object("text", "$.tool_call_id")
    tool = m.filter("role = 'tool'").filter(link.isNotNull()).select("conv_id", tool_id(link).alias("call_id"), "turn", F.get_json_object("text", "$.content").alias("content"))

    content = F.get_json_object("text", "$.content")
    nameless = F.to_json(F.struct("made.arguments", "made.name"), {"ignoreNullFields": "false"})
    said = [
        lost,
        m.filter(~F.col("role").isin("user", "assistant", "tool")),
        m.filter("role = 'tool'").filter(link.isNull()),
        m.filter(F.size(told) > 0).withColumn("text", content).filter("text is not null"),
        made.filter("made.id is null").select("conv_id", "turn", "role", nameless.alias("text")),
    ]
    others = said[0]
    for more in said[1:]:
        others = others.union(more)
    return asked.union(calls), plain.union(tool), others.distinct()


def format_chats(messages: DataFrame, schemas: Schema | None = None) -> DataFrame:
    """The linked calls of all conversations and, as rows of kind ``message``, what is neither call nor result."""
    calls, results, others = conversation_parts(messages)
    linked = link_calls(calls, results, REPLY | (schemas or {}))
    record = F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    said = others.select("conv_id", none, F.lit("message"), none, F.lit(None).cast("long"), F.lit(0).cast("long"), "turn", F.lit(False), F.lit(False), record)
    return linked.union(said)
