"""Tool calls of conversations: linked to results, put in order, validated, written as canonical JSON.

DataFrame functions only. Messages have one row each:

    conv_id, turn, kind ('call', 'result' or anything else), role, call_id, name, arguments (JSON text),
    content, after (ids of the calls that must come before)

Calls and results meet in a hash join on (conv_id, call_id), each side counted first. The order is by turn
where that agrees with `after`; calls that must come after one of a later turn are raised above it, and so on,
round by round. Nothing gathers a conversation in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: JSON types by what schema_of_variant says.
TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
}
KEYS = ["conv_id", "call_id"]


def argument_errors(name: Column, arguments: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call, in a fixed order; empty if nothing is.

    tools: by name, each field's JSON type and whether it is required. A JSON null is of no type.
    """
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    cases = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(tools.items()):
        checks = []
        for field, (wanted, required) in sorted(fields.items()):
            has = F.array_contains(F.json_object_keys(arguments), field)
            found = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            bad = F.when(~F.coalesce(found.rlike(TYPES[wanted]), F.lit(False)), f"{field}: not {wanted}")
            checks.append(F.when(has, bad).otherwise(F.lit(f"{field}: missing") if required else F.lit(None)))
        known = F.array(*(F.lit(f) for f in sorted(fields))) if fields else F.array().cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(arguments), known)), lambda k: F.concat(k, F.lit(": unexpected")))
        good = F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), extra)
        cases = F.when(name == tool, good).otherwise(cases)
    not_object = F.array(F.lit("arguments: not an object"))
    return F.when(F.coalesce(kind.startswith("OBJECT<"), F.lit(False)), cases).otherwise(not_object)


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of calls(conv_id, call_id, call_turn, after).

    A call's level is its turn, or one more than the highest level of the calls it must come after if that
    is higher. Ids that no call of the conversation has are ignored. Calls on or after a cycle are cyclic
    and stay at their turn.

    Where a call must come after one of the same or a later turn it is raised, and so are those after it that
    this affects, round by round; calls whose turn is late enough take no part, so rounds are as many as the
    longest chain of raised calls, however long conversations are. A chain of more calls than were raised in
    its conversation has been round a cycle, and every cycle has such a chain.
    """
    plain = calls.select(*KEYS, "call_turn")
    edges = calls.select(*KEYS, "call_turn", F.explode("after").alias("pre")).distinct()
    before = plain.select("conv_id", F.col("call_id").alias("pre"), F.col("call_turn").alias("pre_turn"))
    edges = edges.join(before, ["conv_id", "pre"])
    early = edges.where("pre_turn >= call_turn").groupBy(*KEYS).agg((F.max("pre_turn") + 1).alias("level"))
    raised = frontier = scratch.table(early, "raised")
    if not raised.limit(1).count():
        return plain.select(*KEYS, F.col("call_turn").alias("level"), F.lit(False).alias("cyclic"))
    edges = edges.join(raised.select("conv_id").distinct(), "conv_id", "left_semi").select(*KEYS, "call_turn", "pre")
    edges = scratch.table(edges, "edges")
    cyclic, rounds = None, 1
    while frontier.limit(1).count():
        rounds += 1
        heads = frontier.select("conv_id", F.col("call_id").alias("pre"), (F.col("level") + 1).alias("level"))
        higher = edges.join(heads, ["conv_id", "pre"]).groupBy(*KEYS, "call_turn").agg(F.max("level").alias("level"))
        higher = higher.join(raised.withColumnRenamed("level", "now"), KEYS, "left").where("level > coalesce(now, call_turn)")
        frontier = scratch.table(higher.select(*KEYS, "level"), "frontier")
        raised = scratch.table(raised.union(frontier).groupBy(*KEYS).agg(F.max("level").alias("level")), "raised")
        few = raised.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < rounds)
        looped = scratch.table(frontier.join(few, "conv_id", "left_semi").select(*KEYS), "looped")
        if looped.limit(1).count():
            found = reached(edges, looped, scratch)
            cyclic = found if cyclic is None else cyclic.union(found)
            frontier = scratch.table(frontier.join(found, KEYS, "left_anti"), "frontier")
            edges = scratch.table(edges.join(found, KEYS, "left_anti"), "edges")
    out = plain.join(raised, KEYS, "left")
    if cyclic is None:
        return out.select(*KEYS, F.coalesce("level", "call_turn").alias("level"), F.lit(False).alias("cyclic"))
    marked = out.join(cyclic.withColumn("_on", F.lit(True)), KEYS, "left")
    on = F.col("_on").isNotNull()
    return marked.select(*KEYS, F.when(on, F.col("call_turn")).otherwise(F.coalesce("level", "call_turn")).alias("level"), on.alias("cyclic"))


def reached(edges: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id) of the first calls and of all that come after them."""
    folder = scratch.path("reached")
    found = first
    while True:
        found.write.mode("append").parquet(folder)
        seen = found.sparkSession.read.schema(first.schema).parquet(folder)
        heads = found.select("conv_id", F.col("call_id").alias("pre"))
        found = scratch.table(edges.join(heads, ["conv_id", "pre"], "left_semi").select(*KEYS).distinct().join(seen, KEYS, "left_anti"), "found")
        if not found.limit(1).count():
            return seen


def format_chat(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(conv_id, turn, position, role, call_id, status, errors, json), a row for every message.

    status: of a call `linked` (one result), `unanswered`, `repeated` (results or calls share the id) or
    `cyclic`; of a result `linked`, `orphan` or `repeated`; else `plain`. A call or result without conv_id
    or call_id is unanswered or orphan. Sorting a conversation by (position, turn) puts calls in the order of
    `after`, results behind their calls, and all else by turn. json has its keys in order, no blanks, nulls
    written out, and arguments with sorted keys; arguments that are not JSON stand as a string. Null turns
    leave a null position. Extra columns are ignored.
    """
    scratch = Scratch(messages.sparkSession)
    messages = messages.select("conv_id", "turn", "kind", "role", "call_id", "name", "arguments", "content", "after")
    ids = messages.where("kind in ('call', 'result') and conv_id is not null and call_id is not null")
    call = F.col("kind") == "call"
    sides = ids.groupBy(*KEYS).agg(
        F.count_if(call).alias("calls"),
        F.count_if(~call).alias("results"),
        F.min(F.when(call, F.col("turn"))).alias("call_turn"),
    )
    sides = scratch.table(sides, "sides")
    firsts = ids.where(call & (F.size("after") > 0)).select(*KEYS, "after")
    wants = sides.where("calls > 0").join(firsts, KEYS, "left").select(*KEYS, "call_turn", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    placed = levels(wants, scratch)
    sides = sides.join(placed.groupBy(*KEYS).agg(F.max("level").alias("level"), F.max("cyclic").alias("cyclic")), KEYS, "left")
    out = messages.join(sides, KEYS, "left")
    status = (
        F.when(~F.coalesce(F.col("kind").isin("call", "result"), F.lit(False)), "plain")
        .when(F.coalesce(F.col("cyclic"), F.lit(False)) & call, "cyclic")
        .when((F.col("calls") > 1) | (F.col("results") > 1), "repeated")
        .when((F.col("calls") == 1) & (F.col("results") == 1), "linked")
        .otherwise(F.when(call, "unanswered").otherwise("orphan"))
    )
    turn = F.col("turn").cast("long")
    position = F.when(call, F.coalesce("level", turn) * 2).when(F.col("kind") == "result", F.greatest(turn * 2, F.col("level") * 2 + 1)).otherwise(turn * 2)
    arguments = F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant"))
    keep = {"ignoreNullFields": "false"}
    json = (
        F.when(call, F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name", "role", F.lit("call").alias("type")), keep))
        .when(F.col("kind") == "result", F.to_json(F.struct("content", F.col("call_id").alias("id"), "role", F.lit("result").alias("type")), keep))
        .otherwise(F.to_json(F.struct("content", "role", F.lit("message").alias("type")), keep))
    )
    errors = F.when(call, argument_errors(F.col("name"), F.col("arguments"), tools)).otherwise(F.array().cast("array<string>"))
    return out.select("conv_id", "turn", position.alias("position"), "role", "call_id", status.alias("status"), errors.alias("errors"), json.alias("json"))


TOOLS = {"answer": {"prompt": ("string", True), "turn": ("integer", True)}}


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """Messages of conversations(conv_id, turn, role, text): a user's turn calls for an answer, the
    assistant's next turn is its result, and a call comes after that of two turns before; but the call of
    turn 0 comes after that of turn 2, an opening request being answered after the first question on it."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    turn = F.col("turn").cast("long")

    def name(at: Column) -> Column:
        return F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), at)

    return conversations.select(
        "conv_id",
        turn.alias("turn"),
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        "role",
        F.when(user, name(turn)).when(assistant, name(turn - 1)).alias("call_id"),
        F.when(user, "answer").alias("name"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn")), {"ignoreNullFields": "false"})).alias("arguments"),
        F.when(~F.coalesce(user, F.lit(False)), F.col("text")).alias("content"),
        F.when(user & (turn == 0), F.array(name(turn + 2))).when(user & (turn != 2), F.array(name(turn - 2))).alias("after"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chat(conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)
    return out.withColumn("errors", F.array_join("errors", "; "))


ORACLE_SQL = """
WITH m AS (SELECT *, CASE role WHEN 'user' THEN 'c' || conv_id || '-' || turn WHEN 'assistant' THEN 'c' || conv_id || '-' || (turn - 1) END AS call_id FROM conversations),
s AS (SELECT conv_id, call_id, count(*) FILTER (role = 'user') AS calls, count(*) FILTER (role = 'assistant') AS results,
    CASE WHEN min(turn) FILTER (role = 'user') = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user' AND turn = 2) THEN 3 ELSE min(turn) FILTER (role = 'user') END AS level
  FROM m WHERE role IN ('user', 'assistant') GROUP BY 1, 2)
SELECT m.conv_id, m.turn,
  CASE role WHEN 'assistant' THEN greatest(2 * m.turn, 2 * level + 1) WHEN 'user' THEN 2 * coalesce(level, m.turn) ELSE 2 * m.turn END AS position,
  role, m.call_id,
  CASE WHEN role NOT IN ('user', 'assistant') THEN 'plain' WHEN calls > 1 OR results > 1 THEN 'repeated' WHEN calls = 1 AND results = 1 THEN 'linked'
    WHEN role = 'user' THEN 'unanswered' ELSE 'orphan' END AS status,
  CASE WHEN role = 'user' AND text IS NULL THEN 'prompt: not string' ELSE '' END AS errors,
  CASE role WHEN 'user' THEN '{"arguments":{"prompt":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || turn || '},"id":"' || m.call_id || '","name":"answer","role":"user","type":"call"}'
    WHEN 'assistant' THEN '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"id":"' || m.call_id || '","role":"assistant","type":"result"}'
    ELSE '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"type":"message"}' END AS json
FROM m LEFT JOIN s USING (conv_id, call_id)
"""
