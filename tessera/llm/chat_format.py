"""Chat formatting: tool calls are linked to their results, ordered, checked and serialised, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Tool:
    """fields: {argument: JSON type, one of string, integer, number, boolean, object, array}; all but optional ones are required."""

    name: str
    fields: dict[str, str]
    optional: frozenset = field(default_factory=frozenset)
    longest: int = 1 << 20  # characters of a string argument


#: The tools of query op9: a user's turn asks for a reply, any other turn that is no answer sets something up.
TOOLS = (Tool("reply", {"text": "string", "turn": "integer"}), Tool("set_up", {"role": "string", "text": "string", "turn": "integer"}, frozenset({"role"}), 200))
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def quoted(c: Column) -> Column:
    """A string as a JSON string."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def errors(tools: tuple[Tool, ...]) -> Column:
    """What is wrong with the arguments (a JSON text) of a call, in a fixed order, joined by commas; empty if nothing."""
    found = [F.when(F.col("value").isNull(), F.lit("not JSON"))]
    known = F.col("name").isin([t.name for t in tools])
    found.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown tool")))
    for t in tools:
        mine = (F.col("name") == t.name) & F.col("value").isNotNull()
        for f, kind in sorted(t.fields.items()):
            got = F.schema_of_variant(F.try_variant_get("value", f"$.{f}", "variant"))
            there = F.coalesce(got, F.lit("VOID")) != "VOID"
            if f not in t.optional:
                found.append(F.when(mine & ~there, F.lit(f"missing {f}")))
            found.append(F.when(mine & there & ~got.rlike(_TYPES[kind]), F.lit(f"{f} is no {kind}")))
            if kind == "string":
                found.append(F.when(mine & (F.length(F.try_variant_get("value", f"$.{f}", "string")) > t.longest), F.lit(f"{f} is too long")))
        keys = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
        extra = F.array_except(keys, F.array(*[F.lit(f) for f in sorted(t.fields)]))
        found.append(F.when(mine & (F.size(extra) > 0), F.lit("unknown argument")))
    return F.array_join(F.filter(F.array(*found), lambda x: x.isNotNull()), ",")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls that each call waits for, by its depends_on and theirs; null on and behind a cycle.

    Pointer doubling: each round joins every call to the one it points to and so doubles the distance, which takes
    as many rounds as the longest chain has binary digits. A call that names one that isn't there waits for nothing.
    """
    ids = calls.select("conv_id", "call_id")
    named = calls.select("conv_id", "call_id", F.col("depends_on").alias("to"))
    there = ids.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("there"))
    state = named.join(there, ["conv_id", "to"], "left").select("conv_id", "call_id", F.when(F.col("there"), F.col("to")).alias("to"))
    state = written(state.withColumn("level", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long")), "levels", few=calls)
    most = max(1, calls.count()).bit_length() + 1
    for _ in range(most):
        if state.filter("to is not null").isEmpty():
            break
        far = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        state = written(state.join(far, ["conv_id", "to"], "left").select("conv_id", "call_id", F.col("next").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels", few=calls)
    return state.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, tools: tuple[Tool, ...] = TOOLS) -> DataFrame:
    """One row for each call, and for each result without one, with canonical JSON; no content is left out.

    calls: conv_id, call_id, turn, name, arguments (JSON text), depends_on (a call_id or null); results: conv_id,
    call_id, turn, content. Of calls or results with equal identifiers the one of the least turn, then text, is
    linked and how many there were is told; each other content is a row of its own with the error repeated identifier
    and how many had it. A null in conv_id or call_id links with nothing: such a call or result is a row of its own
    with the error no identifier. (level, turn) is a topological order of a conversation's calls.
    The order of keys is that of their names; numbers and strings are written in one way.
    """
    key = ["conv_id", "call_id"]
    ok = "conv_id is not null and call_id is not null"
    call, content = F.struct("turn", "name", "arguments", "depends_on"), F.struct("turn", "content")
    first = calls.filter(ok).groupBy(*key).agg(F.min(call).alias("c"), F.count("*").alias("calls"), (F.min(call) != F.max(call)).alias("differ"))
    first = written(first.select(*key, "c.*", "calls", "differ"), "calls", few=calls)
    answer = results.filter(ok).groupBy(*key).agg(F.min(content).alias("r"), F.count("*").alias("results"), (F.min(content) != F.max(content)).alias("differ"))
    answer = written(answer.select(*key, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"), "results", "differ"), "results", few=results)
    more = calls.filter(f"not ({ok})").select(*key, "turn", "name", "arguments", F.lit(1).cast("long").alias("calls"), F.lit("no identifier").alias("why"))
    lost = results.filter(f"not ({ok})").select(*key, F.col("turn").alias("result_turn"), F.col("content").alias("result"), F.lit(1).cast("long").alias("results"), F.lit("no identifier").alias("why"))
    others = calls.groupBy(*key, "turn", "name", "arguments", "depends_on").agg(F.count("*").alias("calls"))
    others = others.join(first.filter("differ").select(*key, call.alias("c")), key).filter(call != F.col("c"))
    answers = results.groupBy(*key, F.col("turn").alias("result_turn"), F.col("content").alias("result")).agg(F.count("*").alias("results"))
    answers = answers.join(answer.filter("differ").select(*key, F.struct("result_turn", "result").alias("r")), key).filter(F.struct("result_turn", "result") != F.col("r"))
    if not first.filter("differ").isEmpty():
        more = more.unionByName(others.select(*key, "turn", "name", "arguments", "calls", F.lit("repeated identifier").alias("why")))
    if not answer.filter("differ").isEmpty():
        lost = lost.unionByName(answers.select(*key, "result_turn", "result", "results", F.lit("repeated identifier").alias("why")))
    rows = first.drop("differ").join(levels(first), key).join(answer.drop("differ"), key, "full")
    rows = rows.unionByName(more, True).unionByName(lost, True).withColumn("value", F.try_parse_json("arguments"))
    found = F.when(F.col("calls").isNull() & F.col("why").isNull(), F.lit("no call")).when(F.col("calls").isNotNull(), errors(tools)).otherwise("")
    problem = F.concat_ws(",", "why", F.when(found != "", found))
    rows = rows.withColumn("errors", problem).withColumn("valid", F.col("errors") == "")
    null = F.lit("null")
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("value"), null), F.lit(',"call_id":'), F.coalesce(quoted(F.col("call_id")), null), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), null),
        F.lit(',"name":'), F.coalesce(quoted(F.col("name")), null), F.lit(',"result":'), F.when(F.col("result").isNull(), null).otherwise(quoted(F.col("result"))), F.lit("}"),
    )
    return rows.select(*key, "turn", "name", "level", "result_turn", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("results", F.lit(0)).alias("results"), "valid", "errors", text.alias("json"))


def conversations(turns: DataFrame, roles: tuple[str, ...] = ("system", "user", "assistant", "tool")) -> DataFrame:
    """(conv_id, turns, errors, json) of each conversation: its messages in the order of their turns as one canonical JSON text.

    turns: conv_id, turn, role, text. Equal turns go by role and text. errors tells, in a fixed order: no conversation (a null conv_id, whose rows
    are one conversation), no turn, repeated turn, unknown role (a null one too), no text, and role twice in a row. Nulls are written as null; nothing is left out.
    A conversation's messages meet in its one row.
    """
    line = F.concat(F.lit('{"content":'), F.when(F.col("m.text").isNull(), "null").otherwise(quoted(F.col("m.text"))), F.lit(',"role":'), F.when(F.col("m.role").isNull(), "null").otherwise(quoted(F.col("m.role"))), F.lit(',"turn":'), F.coalesce(F.col("m.turn").cast("string"), F.lit("null")), F.lit("}"))
    rows = turns.select("conv_id", F.struct("turn", "role", "text").alias("m")).withColumn("line", line)
    known = F.coalesce(F.col("m.role").isin(*roles), F.lit(False))
    sums = rows.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("m.turn").isNull()).alias("lost"), F.count("m.turn").alias("numbered"), F.countDistinct("m.turn").alias("different"), F.count_if(~known).alias("odd"), F.count_if(F.col("m.text").isNull()).alias("empty"),
        F.array_sort(F.collect_list(F.struct(F.col("m.turn").isNull().alias("last"), F.col("m.turn").alias("turn"), F.col("m.role").alias("role"), F.col("line")))).alias("all"),
    )
    twice = F.exists(F.sequence(F.lit(1), F.size("all")), lambda i: (i > 1) & F.element_at("all", i)["role"].eqNullSafe(F.element_at("all", F.greatest(i - 1, F.lit(1)))["role"]))
    problems = [(F.col("conv_id").isNull(), "no conversation"), (F.col("lost") > 0, "no turn"), (F.col("numbered") > F.col("different"), "repeated turn"), (F.col("odd") > 0, "unknown role"), (F.col("empty") > 0, "no text"), (twice, "role twice in a row")]
    found = F.concat_ws(",", *[F.when(c, name) for c, name in problems])
    text = F.concat(F.lit('{"conv_id":'), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(',"messages":['), F.array_join(F.transform("all", lambda x: x["line"]), ","), F.lit("]}"))
    return sums.select("conv_id", "turns", found.alias("errors"), text.alias("json"))


def unlinked(rows: DataFrame) -> DataFrame:
    """Rows of calls or results that have no identifier."""
    return rows.filter("conv_id is null or call_id is null")


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations without tools: an assistant's turn answers the turn before it.

    A call waits for the one that was answered by the turn before it. Nulls in role make a call; a null text is an
    argument that is null; rows with a null turn have no identifier.
    """
    ident = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    t = F.col("turn")
    made = F.when(t.isNotNull() & F.col("conv_id").isNotNull(), ident(t))
    role = F.coalesce("role", F.lit(""))
    user = role == "user"
    arguments = F.when(user, F.to_json(F.struct("text", "turn"))).otherwise(F.to_json(F.struct("role", "text", "turn")))
    calls = turns.filter(role != "assistant").select(
        "conv_id", made.alias("call_id"), "turn", F.when(user, "reply").otherwise("set_up").alias("name"), arguments.alias("arguments"), F.when(made.isNotNull(), ident(t - 2)).alias("depends_on")
    )
    results = turns.filter(role == "assistant").select("conv_id", F.when(made.isNotNull(), ident(t - 1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
WITH RECURSIVE q AS (
  SELECT conv_id, conv_id || '-' || turn AS call_id, turn, CASE WHEN role = 'user' THEN 'reply' ELSE 'set_up' END AS name, role, text, conv_id || '-' || (turn - 2) AS depends_on
  FROM conversations WHERE role IS NULL OR role <> 'assistant'
), c AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, call_id) AS calls FROM q
  QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, role, text) = 1
), a AS (
  SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, turn AS result_turn, text AS result, count(*) OVER (PARTITION BY conv_id, turn) AS results
  FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1
), l AS (
  SELECT c.conv_id, c.call_id, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.call_id = c.depends_on)
  UNION ALL
  SELECT c.conv_id, c.call_id, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.depends_on = l.call_id
), j AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, turn, name, level, result_turn, coalesce(calls, 0) AS calls, coalesce(results, 0) AS results,
    CASE WHEN calls IS NULL THEN 'no call' WHEN text IS NULL THEN 'missing text' WHEN name = 'set_up' AND length(text) > 200 THEN 'text is too long' WHEN length(text) > 1048576 THEN 'text is too long' ELSE '' END AS errors,
    CASE WHEN calls IS NULL THEN 'null' WHEN name = 'reply' THEN '{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text)::VARCHAR || ',' END || '"turn":' || turn || '}'
      ELSE '{' || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role)::VARCHAR || ',' END || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text)::VARCHAR || ',' END || '"turn":' || turn || '}' END AS arguments,
    result
  FROM c LEFT JOIN l USING (conv_id, call_id) FULL JOIN a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
)
SELECT conv_id, call_id, turn, name, level::BIGINT AS level, result_turn, calls, results, errors = '' AS valid, errors,
  '{"arguments":' || arguments || ',"call_id":' || to_json(call_id)::VARCHAR || ',"level":' || coalesce(level::VARCHAR, 'null') || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS json
FROM j
"""
