"""Chat formatting: linking tool calls with their results.

Calls and results are joined by call id. A call may name the call whose result it needs (`after`),
so calls form a forest; its topological level comes from pointer jumping, which halves every
remaining chain in each round, so a conversation of a thousand dependent calls takes ten rounds.
Arguments are checked against a schema per tool, and each linked call becomes one line of canonical
JSON: keys in order, no blanks, numbers and strings as JSON writes them.

Defined results. Of several calls with one id in a conversation the one with the smallest turn (then
the smallest arguments) counts, the others get status `duplicate_call`; of several results the one with
the smallest turn (then content) is linked and `n_results` counts all. Status is `linked`, `no_result`,
`orphan_result` (a result without its call; its turn and content are kept), `duplicate_call`, or
`no_id` (null conversation or call id). A call after an unknown call, or after itself, starts a chain with
error `unknown_after`; calls on a cycle have a null level and error `cycle`. Null or malformed arguments
fail with `not_an_object`. Extra columns are ignored; empty tables give an empty result.

Conversations (`linked_turns`): user turns are calls, assistant turns results; turns of any other role, or of none, are no
part of a call and get one row each with status `other_turn`, their content and role in the JSON. Null and empty
texts are kept as such; a null turn or conversation gets `no_id`, unless its role is another one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.plans.materialize import materialize


class Arg(NamedTuple):
    """One argument of a tool: its JSON type and bounds on its length or value."""

    name: str
    type: str  # string, integer, number, boolean, array or object
    required: bool = True
    least: float | None = None
    most: float | None = None


Schemas = dict[str, list[Arg]]

VARIANT_TYPES = {  # how the engine names the JSON types
    "string": r"^STRING$", "integer": r"^BIGINT$|^DECIMAL\(\d+,0\)$", "number": r"^BIGINT$|^DOUBLE$|^DECIMAL.*", "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<.*", "object": r"^OBJECT<.*",
}


def argument_errors(arguments: Column, tool: Column, schemas: Schemas) -> Column:
    """Violations as array<string>, empty when valid: kind:argument, in the order of the schema."""
    parsed = F.try_parse_json(arguments)
    fault = lambda bad, text: F.when(bad, F.lit(text))  # noqa: E731  null unless bad
    result = F.array(F.lit("unknown_tool"))
    for name, args in schemas.items():
        faults = []
        for a in args:
            value = F.try_variant_get(parsed, f"$['{a.name}']", "variant")
            kind = F.schema_of_variant(value)
            absent = value.isNull() | (kind == "VOID")
            if a.required:
                faults.append(fault(absent, f"missing:{a.name}"))
            right = kind.rlike(VARIANT_TYPES[a.type])
            faults.append(fault(~absent & ~right, f"type:{a.name}"))
            size = F.length(F.try_variant_get(value, "$", "string")) if a.type == "string" else F.try_variant_get(value, "$", "double")
            for bound, beyond in ((a.least, size < F.lit(a.least)), (a.most, size > F.lit(a.most))):
                if bound is not None:
                    faults.append(fault(~absent & right & beyond, f"range:{a.name}"))
        known = F.array(*[F.lit(a.name) for a in args])
        extra = F.transform(F.array_except(F.json_object_keys(arguments), known), lambda k: F.concat(F.lit("unknown:"), k))
        found = F.concat(F.array_compact(F.array(*faults)), F.array_sort(F.coalesce(extra, F.array().cast("array<string>"))))
        result = F.when(tool == name, found).otherwise(result)
    return F.when(F.coalesce(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(True)), F.array(F.lit("not_an_object"))).otherwise(result)


def canonical(json: Column) -> Column:
    """The JSON text with sorted keys and no blanks; null if malformed. Variants hold keys sorted."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame, rounds: int = 64) -> DataFrame:
    """conv_id, call_id, level, after_known for unique calls (conv_id, call_id, after).

    Each row holds its distance to a further ancestor; a round doubles the distance. A row that still
    has an ancestor once the distance exceeds the number of calls is on a cycle or hangs from one.
    """
    parent = calls.select(F.col("conv_id").alias("__c"), F.col("call_id").alias("__p"))
    known = (F.col("conv_id") == F.col("__c")) & (F.col("after") == F.col("__p")) & (F.col("after") != F.col("call_id"))
    first = calls.join(parent, known, "left").select(
        "conv_id", "call_id", F.col("__p").alias("up"), F.when(F.col("__p").isNotNull(), 1).otherwise(0).cast("long").alias("distance"),
        (F.col("after").isNull() | F.col("__p").isNotNull()).alias("after_known"))
    state, before = materialize(first, "call-levels"), None
    for _ in range(rounds):
        open_rows = state.filter("up IS NOT NULL").count()
        if open_rows == 0 or (before is not None and before[0] == open_rows and before[1]):
            break
        ups = state.select(F.col("conv_id").alias("__c"), F.col("call_id").alias("__id"), F.col("up").alias("__up"), F.col("distance").alias("__d"))
        # A finished row is not joined: only open rows look up the ancestor of their ancestor.
        moved = state.filter("up IS NOT NULL").join(ups, (F.col("conv_id") == F.col("__c")) & (F.col("up") == F.col("__id"))).select(
            "conv_id", "call_id", F.col("__up").alias("up"), (F.col("distance") + F.col("__d")).alias("distance"), "after_known")
        before = (open_rows, 2 ** (_ + 1) > open_rows)  # chains of open rows are shorter than their number
        state = materialize(state.filter("up IS NULL").unionByName(moved), "call-levels")
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("distance")).alias("level"), "after_known")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls: conv_id, turn, call_id, tool, arguments (JSON text), after. results: conv_id, turn, call_id, content.

    One row per call, and per id of results without a call: conv_id, turn, call_id, tool, level, result_turn,
    n_results, status, errors, json. Ordering by (level, turn) is a topological order of a conversation.
    """
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", "after")
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    # Pre-aggregated on both sides, so that a join key is met once on each side.
    body = F.struct("turn", "arguments", "tool", "after")
    by_id = calls.filter(keyed).groupBy("conv_id", "call_id").agg(F.min(body).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    unique = by_id.select("conv_id", "call_id", "c.*", "n_calls")
    answers = results.filter(keyed).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    depth = levels(unique.select("conv_id", "call_id", "after"))
    linked = unique.join(depth, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "full_outer")
    is_call = F.col("n_calls").isNotNull()
    status = F.when(is_call & F.col("r").isNotNull(), "linked").when(is_call, "no_result").otherwise("orphan_result")
    linked = linked.withColumns({"is_call": is_call, "status": status, "turn": F.coalesce("turn", "r.turn")})
    # Further calls with the id of a linked one, and rows without an id, take no part in the join.
    again = calls.filter(keyed).join(by_id.filter("n_calls > 1").select("conv_id", "call_id", "c"), ["conv_id", "call_id"])
    rest = again.filter(F.struct("turn", "arguments", "tool", "after") != F.col("c")).withColumn("status", F.lit("duplicate_call"))
    copies = by_id.filter("n_calls > 1").join(
        again.filter(F.struct("turn", "arguments", "tool", "after").eqNullSafe(F.col("c"))).groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("same")),
        ["conv_id", "call_id"])
    copies = copies.select("conv_id", "call_id", "c.*", F.explode(F.sequence(F.lit(1), F.col("same"))).alias("i")).filter("i > 1")
    loose = calls.filter(~keyed).withColumn("status", F.lit("no_id"))
    extra = rest.drop("c").unionByName(copies.drop("i").withColumn("status", F.lit("duplicate_call"))).unionByName(loose)
    lost = results.filter(~keyed).select("conv_id", "turn", "call_id", F.struct("turn", "content").alias("r"), F.lit("no_id").alias("status"))
    every = linked.unionByName(extra.withColumn("is_call", F.lit(True)), allowMissingColumns=True).unionByName(
        lost.withColumn("is_call", F.lit(False)), allowMissingColumns=True)
    chained = F.col("status").isin("linked", "no_result")
    errors = F.when(F.col("is_call"), F.concat(
        argument_errors(F.col("arguments"), F.col("tool"), schemas),
        F.array_compact(F.array(
            F.when(chained & ~F.col("after_known"), F.lit("unknown_after")),
            F.when(chained & F.col("level").isNull(), F.lit("cycle")))),
    )).otherwise(F.array().cast("array<string>"))
    line = F.to_json(F.struct(  # keys in alphabetical order
        F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.lit("null"))).alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"),
        F.col("r.content").alias("result")), {"ignoreNullFields": "false"})
    return every.select(
        "conv_id", "turn", "call_id", "tool", "level", F.col("r.turn").alias("result_turn"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "status", errors.alias("errors"), line.alias("json"))


REPLY: Schemas = {"reply": [Arg("after", "string", required=False, least=1), Arg("prompt", "string", least=1), Arg("turn", "integer", least=0)]}


def linked_turns(conversations: DataFrame) -> DataFrame:
    """Every turn of every conversation: calls linked with results, and the turns that are neither."""
    calls, results = turns_as_calls(conversations)
    other = conversations.filter("role IS NULL OR role NOT IN ('user', 'assistant')").select(
        "conv_id", "turn", F.lit("other_turn").alias("status"), F.lit(0).cast("long").alias("n_results"),
        F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"))
    return link_tool_calls(calls, results, REPLY).unionByName(other, allowMissingColumns=True)


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls of a tool `reply`: each user turn is a call, the assistant turn after it the
    result; a user turn two turns on builds on that result. Other turns are not among them."""
    named = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    after = F.when(turn >= 2, named(turn - 2))
    calls = conversations.filter("role = 'user'").select(
        "conv_id", "turn", named(turn).alias("call_id"), F.lit("reply").alias("tool"),
        F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("prompt"), after.alias("after"))).alias("arguments"), after.alias("after"))
    results = conversations.filter("role = 'assistant'").select("conv_id", "turn", named(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
