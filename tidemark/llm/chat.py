"""Tool-call linking for chat data, with DataFrame functions only.

Calls and results meet by (conversation, identifier).  A call may name one earlier call that it
depends on; its level is the length of that chain, found by pointer doubling, so that a chain of n
calls takes log2(n) joins.  ``position`` numbers a conversation's calls by (level, turn), which is a topological order,
those of a cycle last.  Links are shuffled hash joins whose hashed side has one row an identifier and no texts; the texts of
results, which may be long, are merged in by sorted identifiers, which can spill.  Arguments
are JSON, checked against the schema of the tool named.  Every call, every result without a
call and every plain message becomes one line of canonical JSON: sorted keys, no blanks.

Status, the first that holds: duplicate (an earlier call has the identifier), invalid (the
arguments break the schema, or aren't JSON), dangling (it depends on a call that doesn't exist),
cycle, no_result, ok.  Of several results of a call the earliest, then the least text, counts;
a result is an orphan where no call has its identifier.  Null texts are missing arguments or
null results; an empty table gives an empty result; repeated rows are duplicates.  Null conversations
and identifiers are values like others, equal to each other.  Calls that tie in level and turn go by identifier, name and the MD5 of their arguments, as do the
calls of one identifier and turn; equal rows may swap places.  Very long texts are read whole.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.operators.datasets import with_index

#: tool: {argument: (type, required, least, most)}; least and most bound lengths or numbers.
SCHEMAS = {
    "search": {"query": ("string", True, 1, 1000), "turn": ("integer", True, 0, 1 << 31)},
    "compose": {"query": ("string", True, 200, 100000), "turn": ("integer", True, 2, 1 << 31)},
}


def errors(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Sorted names of what is wrong, empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    found = F.when(~name.isin(*schemas) | name.isNull(), F.array(F.lit("tool")))
    for tool, fields in schemas.items():
        wrong = []
        for field, (kind, required, least, most) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "string")
            type_ = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")), F.lit("VOID"))
            size = F.length(value) if kind == "string" else value.try_cast("long")
            bad = (type_ != {"string": "STRING", "integer": "BIGINT"}[kind]) | (size < least) | (size > most)
            absent = type_ == "VOID"
            wrong.append(F.when(absent, F.lit(f"{field}:missing") if required else None).when(bad, F.lit(field)))
        extra = F.when(F.size(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, sorted(fields))))) > 0, F.lit("extra"))
        here = F.when(parsed.isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*wrong, extra)))
        found = found.when(name == tool, here)
    return found


def hashed(rows: DataFrame) -> DataFrame:
    """The side of a join that is hashed: one row a key."""
    return rows.hint("shuffle_hash")


def positioned(calls: DataFrame) -> DataFrame:
    """``calls`` with ``position``, their place in their conversation by level and turn, from a range sort: a conversation of
    very many calls is spread over tasks."""
    last = F.coalesce("level", F.lit((1 << 63) - 1))
    order = ["__conv", "__level", "turn", "call_id", "name", "digest", "row"]
    rows = with_index(calls.withColumns({"__conv": F.struct("conv_id"), "__level": last}), order, "__index")
    first = rows.groupBy("__conv").agg(F.min("__index").alias("__first"))
    return rows.join(hashed(first), "__conv").withColumn("position", F.col("__index") - F.col("__first")).drop("__conv", "__level", "__index", "__first")


def levels(calls: DataFrame) -> DataFrame:
    """(key, level, cyclic) from (key, parent): how many calls a call rests on, by pointer doubling.

    Each round is written as Parquet; only calls whose chain goes on are joined again.
    """
    state = common.staged(calls.select("key", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        active = state.where("up is not null")
        if active.isEmpty():
            break
        above = state.select(F.col("key").alias("up"), F.col("up").alias("further"), F.col("level").alias("more"))
        active = active.join(hashed(above), "up", "left").select("key", F.col("further").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        state = common.staged(state.where("up is null").unionByName(active), "levels")
    return state.select("key", F.when(F.col("up").isNull(), F.col("level")).alias("level"), F.col("up").isNotNull().alias("cyclic"))


def linked(calls: DataFrame, results: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, call_id, level, position, status, line).

    calls: conv_id, turn, call_id, name, arguments, depends_on; results: conv_id, turn, call_id, text;
    messages: conv_id, turn, role, text.  Links, levels and positions are found on rows without texts, by row number;
    the texts join them last.
    """
    key = F.struct("conv_id", "call_id").alias("key")
    digest = F.unhex(F.md5(F.col("arguments").cast("binary"))).alias("digest")
    calls = common.staged(calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on", key, digest, F.monotonically_increasing_id().alias("row")), "calls")
    slim = calls.drop("arguments")
    first = slim.groupBy("key").agg(F.min(F.struct("turn", "name", "digest", "row")).getField("row").alias("head"))
    parent = F.when(F.col("depends_on").isNotNull(), F.struct("conv_id", F.col("depends_on").alias("call_id")))
    heads = slim.join(hashed(first), "key").where("row = head").select("key", "row", parent.alias("parent"))
    spread = F.when(F.col("parent").isNull(), F.col("row")).otherwise(-1).alias("salt")  # calls that rest on none meet no one task
    known = first.select(F.col("key").alias("parent"), F.least("head", F.lit(-1).cast("long")).alias("salt"), F.col("head").alias("up"))  # -1, but no constant, which would leave the join by parent alone
    heads = heads.select("*", spread).join(hashed(known), ["parent", "salt"], "left")
    heads = common.staged(heads.select("key", "row", "up", (F.col("parent").isNotNull() & F.col("up").isNull()).alias("dangling")), "heads")
    depth = levels(heads.select(F.col("row").alias("key"), F.col("up").alias("parent"))).withColumnRenamed("key", "row")
    graph = heads.join(hashed(depth), "row").select("key", F.col("row").alias("head"), "dangling", "level", "cyclic")
    places = positioned(slim.drop("depends_on").join(hashed(graph), "key")).select("row", "level", "dangling", "cyclic", (F.col("row") != F.col("head")).alias("duplicate"), "position")
    answered = results.groupBy(key).agg(F.count(F.lit(1)).alias("answers"))  # identifiers alone: the hashed side doesn't spill, and holds no texts
    places = slim.select("key", "row").join(hashed(answered), "key", "left").join(hashed(places), "row").drop("key")
    replies = results.groupBy(key).agg(F.min(F.struct("turn", "text")).alias("reply")).hint("merge")
    both = calls.join(hashed(places), "row").join(replies, "key", "left").withColumn("errors", errors(F.col("name"), F.col("arguments")))
    status = (
        F.when(F.col("duplicate"), "duplicate").when(F.size("errors") > 0, "invalid").when(F.col("dangling"), "dangling")
        .when(F.col("cyclic"), "cycle").when(F.col("answers").isNull(), "no_result").otherwise("ok")
    )
    both = both.select("conv_id", "turn", "call_id", "name", "arguments", "level", "position", "errors", status.alias("status"), F.col("reply.text").alias("result"))
    keep_nulls = {"ignoreNullFields": "false"}
    call_line = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "errors", F.col("call_id").alias("id"), "level", "name", "result", "status"), keep_nulls)
    shape = lambda kind, level, place, state, line: ["conv_id", "turn", F.lit(kind).alias("kind"), "call_id", level.cast("long").alias("level"), place.alias("position"), state.alias("status"), line.alias("line")]
    out = both.select(*shape("call", F.col("level"), F.col("position"), F.col("status"), call_line))
    lost = results.withColumn("key", key).join(hashed(first), "key", "left_anti")
    lost_line = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("text").alias("result"), F.lit("orphan").alias("status")), keep_nulls)
    plain_line = F.to_json(F.struct("role", "text"), keep_nulls)
    plain = messages.withColumn("call_id", F.lit(None).cast("string"))
    none = F.lit(None).cast("long")
    return out.unionByName(lost.select(*shape("result", none, none, F.lit("orphan"), lost_line))).unionByName(plain.select(*shape("message", none, none, F.lit("plain"), plain_line)))


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read conversations as tool use: a user's turn calls (a search, every other one a composition) and rests
    on the call two turns before; the assistant's turn after it is the result; other turns are messages."""
    ident = lambda at: F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), at.cast("string"))
    turn = F.col("turn")
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", ident(turn).alias("call_id"), F.when(turn % 4 < 2, "search").otherwise("compose").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), "turn")).alias("arguments"), F.when(turn >= 2, ident(turn - 2)).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", "turn", ident(turn - 1).alias("call_id"), "text")
    messages = turns.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    return calls, results, messages


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return linked(*calls_of(turns))


ORACLE = """
WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, CASE WHEN turn % 4 < 2 THEN 'search' ELSE 'compose' END AS name, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS id, text FROM conversations WHERE role = 'assistant'),
l AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
    UNION ALL SELECT c.conv_id, c.turn, level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2),
e AS (SELECT c.*, level, a.text AS reply, a.id IS NOT NULL AS got, turn >= 2 AND level = 0 AS dangling,
    list_filter([CASE WHEN c.text IS NULL THEN 'query:missing' WHEN name = 'search' AND (length(c.text) < 1 OR length(c.text) > 1000) OR name = 'compose' AND (length(c.text) < 200 OR length(c.text) > 100000) THEN 'query' END], lambda x: x IS NOT NULL) AS errors
    FROM c JOIN l USING (conv_id, turn) LEFT JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1),
s AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'invalid' WHEN dangling THEN 'dangling' WHEN NOT got THEN 'no_result' ELSE 'ok' END AS status FROM e)
SELECT conv_id, turn, 'call' AS kind, id AS call_id, CAST(level AS BIGINT) AS level, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) - 1 AS position, status,
    '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"query":' || to_json(text) || ',' END || '"turn":' || turn || '},"errors":' || to_json(errors) || ',"id":"' || id || '","level":' || level
    || ',"name":"' || name || '","result":' || coalesce(to_json(reply), 'null') || ',"status":"' || status || '"}' AS line FROM s
UNION ALL SELECT conv_id, turn, 'result', id, NULL, NULL, 'orphan', '{"id":"' || id || '","result":' || coalesce(to_json(text), 'null') || ',"status":"orphan"}'
    FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = a.conv_id AND c.turn = a.turn - 1)
UNION ALL SELECT conv_id, turn, 'message', NULL, NULL, NULL, 'plain', '{"role":' || coalesce(to_json(role), 'null') || ',"text":' || coalesce(to_json(text), 'null') || '}'
    FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
