"""Message transcripts: one record a line, messages with content blocks (rows 13-47, 110-112, 124-125, 361-370, 375).

The stateful reading of such a log becomes tables: lines are classified, human
lines open turns by a cumulative count, content blocks are exploded, results
meet their calls by id, the lines of one message are folded to one usage row.
Sub-agents' events are placed into the main log by a running maximum of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.times import parse_iso
from tracemill.operators.cost import fold_usage_lines
from tracemill.sources.hook_ledger import tool_kind

#: Line types that are counted and never parsed.
COUNT_ONLY = ("file-history-snapshot", "progress", "queue-operation", "last-prompt")
_USAGE = "STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, cache_read_input_tokens: BIGINT, cache_creation_input_tokens: BIGINT, cache_creation: MAP<STRING, BIGINT>, output_tokens_details: MAP<STRING, BIGINT>>"
LINE = (
    "type STRING, subtype STRING, uuid STRING, parentUuid STRING, isSidechain BOOLEAN, isMeta BOOLEAN, timestamp STRING, sessionId STRING, cwd STRING, version STRING, gitBranch STRING, promptId STRING, requestId STRING, agentId STRING, summary STRING, prNumber INT, prUrl STRING, prRepository STRING, attachment STRUCT<type: STRING, filename: STRING>, durationMs BIGINT, compactMetadata STRUCT<trigger: STRING, preTokens: BIGINT, postTokens: BIGINT>, originalModel STRING, fallbackModel STRING, apiRefusalCategory STRING, isCompactSummary BOOLEAN, toolUseResult STRING, "
    f"message STRUCT<id: STRING, model: STRING, role: STRING, stop_reason: STRING, content: STRING, usage: {_USAGE}>"
)
_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
SYNTHETIC = "<synthetic>"


def records(lines: DataFrame) -> DataFrame:
    """Typed records with their content blocks; plain string content is one text block (15)."""
    got = lines.where(~F.col("bad") & ~F.col("count_only")).withColumn("j", F.from_json("value", LINE)).select("file", "seq", "j.*")
    content = F.col("message.content")
    blocks = F.when(F.startswith(F.ltrim(content), F.lit("[")), F.from_json(content, _BLOCKS)).when(content.isNotNull(), F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("name", "string"), ("input", "string"), ("tool_use_id", "string"), ("content", "string"), ("is_error", "boolean"))])))
    sid = F.coalesce("sessionId", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))
    return got.withColumn("blocks", F.coalesce(blocks, F.array().cast(_BLOCKS))).withColumn("session_key", F.concat(F.lit("claude-code:"), sid)).withColumn("at_ms", parse_iso(F.col("timestamp"))).withColumn("texts", F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"))


def classify_user(texts: Column, blocks: Column, meta: Column, compact: Column) -> Column:
    """What a user line is, first match wins (25)."""
    text = F.coalesce(texts, F.lit(""))
    return (
        F.when(F.exists(blocks, lambda b: b["type"] == "tool_result"), "results")
        .when(F.coalesce(compact, F.lit(False)), "compact")
        .when(F.startswith(text, F.lit("[Request interrupted")), "interrupt")
        .when(F.rlike(text, F.lit(r"^\s*<task-notification>")), "notification")
        .when(F.rlike(text, F.lit(r"^\s*<(?:local-command|bash-(?:input|stdout|stderr))")), "local-command")
        .when(F.rlike(text, F.lit(r"^\s*<command-(?:name|message)>")), "skill")
        .when(F.coalesce(meta, F.lit(False)), "meta")
        .when(F.trim(text) == "", "meta")
        .otherwise("human")
    )


def with_turns(recs: DataFrame) -> DataFrame:
    """Number the turns: human lines open one, and skills that an assistant line answers; the rest continues it (26)."""
    main = recs.where(~F.coalesce("isSidechain", F.lit(False)))
    trigger = F.when(F.col("type") == "user", classify_user(F.col("texts"), F.col("blocks"), F.col("isMeta"), F.col("isCompactSummary")))
    w = Window.partitionBy("session_key").orderBy("file", "seq")
    typed = main.withColumn("trigger", trigger).withColumn("ord", F.row_number().over(w).cast("long") - 1)
    ahead = F.first(F.when(F.col("type").isin("user", "assistant") & ~F.coalesce(F.col("trigger").isin("meta", "results"), F.lit(False)), F.col("type")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    opens = (F.col("trigger") == "human") | ((F.col("trigger") == "skill") & (F.col("next_kind") == "assistant"))
    return typed.withColumn("next_kind", ahead).withColumn("opens", F.coalesce(opens, F.lit(False))).withColumn("turn_index", (F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("int"))


def turns(numbered: DataFrame) -> DataFrame:
    """One row a turn; the final message is the last that ended its turn and has text (26, 27)."""
    final = (F.col("type") == "assistant") & (F.col("message.stop_reason") == "end_turn") & (F.col("message.model") != SYNTHETIC) & (F.trim("texts") != "")
    return numbered.where("turn_index >= 0").groupBy("session_key", "turn_index").agg(
        F.min("ord").alias("seq_start"), F.max("ord").alias("seq_end"), F.min("at_ms").alias("started_ms"), F.max("at_ms").alias("ended_ms"),
        F.min_by("texts", F.when(F.col("opens"), F.col("ord"))).alias("prompt"), F.min_by("trigger", F.when(F.col("opens"), F.col("ord"))).alias("trigger"),
        F.max_by("texts", F.when(final, F.col("ord"))).alias("final_text"), F.coalesce(F.max(F.when(final, F.col("ord"))), F.max("ord")).alias("final_seq"),
        F.max_by("message.model", F.when((F.col("type") == "assistant") & (F.col("message.model") != SYNTHETIC), F.col("ord"))).alias("model"), F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("ord"))).alias("cwd"),
        F.sort_array(F.collect_set(F.when(F.col("type") == "user", F.col("trigger")))).alias("triggers"),
    )


def legacy_tool(name: Column) -> Column:
    """Today's name of a renamed tool (41)."""
    return F.when(name == "Task", "Agent").when(name == "MultiEdit", "Edit").otherwise(name)


def tool_calls(numbered: DataFrame) -> DataFrame:
    """Tool-use blocks with the first result of each (18-20, 29, 30, 368)."""
    uses = numbered.where("type = 'assistant'").select("session_key", "turn_index", "ord", "cwd", "at_ms", "agentId", F.posexplode("blocks").alias("block", "b")).where("b.type = 'tool_use'")
    results = numbered.where("type = 'user'").select("session_key", "ord", "toolUseResult", F.explode("blocks").alias("b")).where("b.type = 'tool_result'")
    first = results.groupBy("session_key", F.col("b.tool_use_id").alias("tool_call_id")).agg(F.min_by(F.struct(F.col("b.content").alias("content"), F.col("b.is_error").alias("is_error"), F.col("toolUseResult").alias("extra")), "ord").alias("r"), (F.count("*") - 1).alias("repeats"))
    joined = uses.withColumn("tool_call_id", F.col("b.id")).join(first, ["session_key", "tool_call_id"], "left")
    arguments, content, extra = F.col("b.input"), F.col("r.content"), F.col("r.extra")
    plain = F.when(F.startswith(F.ltrim(content), F.lit("[")), F.array_join(F.transform(F.from_json(content, "array<struct<type:string,text:string>>"), lambda x: x["text"]), "\n")).otherwise(content)
    said = F.regexp_extract(F.coalesce(plain, F.lit("")), r"^(?:Error: )?Exit code (\d+)", 1)
    denied = F.rlike(F.coalesce(plain, F.lit("")), F.lit(r"^The user doesn't want to (?:proceed|take this action)|^Permission .* denied|requires approval"))
    failed = F.coalesce("r.is_error", F.lit(False))
    interrupted = F.coalesce(F.get_json_object(extra, "$.interrupted") == "true", F.lit(False))
    background = F.get_json_object(extra, "$.backgroundTaskId").isNotNull() | F.coalesce(F.get_json_object(arguments, "$.run_in_background") == "true", F.lit(False))
    shell = tool_kind(F.col("b.name"), F.lit(None).cast("string")) == "shell"
    code = F.when(denied | interrupted | background | ~shell | F.col("r").isNull(), F.lit(None).cast("int")).when(said != "", said.cast("int")).when(~failed, F.lit(0))
    text = F.coalesce(F.concat_ws("\n", F.get_json_object(extra, "$.stdout"), F.when(F.get_json_object(extra, "$.stderr") != "", F.get_json_object(extra, "$.stderr"))), plain)
    stdout = F.when(F.get_json_object(extra, "$.stdout").isNotNull(), text).otherwise(plain)
    path = F.coalesce(F.get_json_object(arguments, "$.file_path"), F.get_json_object(arguments, "$.notebook_path"), F.get_json_object(arguments, "$.path"))
    one = F.struct(F.get_json_object(arguments, "$.old_string").alias("old"), F.coalesce(F.get_json_object(arguments, "$.new_string"), F.get_json_object(arguments, "$.content")).alias("new"))
    many = F.transform(F.from_json(F.get_json_object(arguments, "$.edits"), "array<struct<old_string:string,new_string:string>>"), lambda e: F.struct(e["old_string"].alias("old"), e["new_string"].alias("new")))
    return joined.select(
        "session_key", "turn_index", F.col("ord").alias("seq"), "block", "tool_call_id", legacy_tool(F.col("b.name")).alias("tool"), F.get_json_object(extra, "$.backgroundTaskId").alias("background_task_id"), tool_kind(F.col("b.name"), F.lit(None).cast("string")).alias("kind"), F.get_json_object(arguments, "$.command").alias("command"), "cwd", "at_ms", "agentId",
        F.array_compact(F.array(path)).alias("paths"), F.get_json_object(arguments, "$.url").alias("url"), stdout.alias("output"), code.alias("exit"), F.when(said != "", "content").when(code == 0, "interpreted").otherwise("unknown").alias("exit_source"),
        failed.alias("is_error"), denied.alias("denied"), F.rlike(F.coalesce(plain, F.lit("")), F.lit("timed out after")).alias("timed_out"), F.contains(F.coalesce(plain, F.lit("")), F.lit("[output truncated")).alias("truncated"), background.alias("background"), F.coalesce(many, F.array(one)).alias("edits"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
    )


def notifications(numbered: DataFrame) -> DataFrame:
    """Late exits of background calls: task id, status, exit (39)."""
    tag = lambda n: F.regexp_extract("texts", rf"<{n}>\s*([^<]*?)\s*</{n}>", 1)
    code = F.regexp_extract("texts", r"exit code:? (\d+)", 1)
    return numbered.where("trigger = 'notification'").select("session_key", "ord", tag("task-id").alias("task_id"), tag("status").alias("status"), F.when(code != "", code.cast("int")).alias("exit"))


def apply_notifications(calls: DataFrame, notes: DataFrame) -> DataFrame:
    """Calls with the exits that came late (40): the last notification of a task that names an exit gives it to the first call of that task."""
    late = notes.where("exit IS NOT NULL AND task_id <> ''").groupBy("session_key", F.col("task_id").alias("background_task_id")).agg(F.max_by("exit", "ord").alias("_exit"))
    first = calls.where("background_task_id IS NOT NULL").groupBy("session_key", "background_task_id").agg(F.min_by("tool_call_id", F.struct("seq", "block")).alias("tool_call_id"))
    known = first.join(late, ["session_key", "background_task_id"]).select("session_key", "tool_call_id", "_exit")
    joined = calls.join(known, ["session_key", "tool_call_id"], "left")
    return joined.withColumn("exit_source", F.when(F.col("_exit").isNotNull(), "notification").otherwise(F.col("exit_source"))).withColumn("exit", F.coalesce("_exit", "exit")).drop("_exit")


def active_time(numbered: DataFrame) -> DataFrame:
    """Milliseconds that the tool says a turn was worked on (21). A duration counts for the turn that its line stands in."""
    return numbered.where("type = 'system' AND subtype = 'turn_duration' AND turn_index >= 0").groupBy("session_key", "turn_index").agg(F.sum(F.coalesce("durationMs", F.lit(0).cast("long"))).alias("active_ms"))


def compactions(numbered: DataFrame) -> DataFrame:
    """Where a session's context was cut down, with tokens before and after (21)."""
    meta = lambda f, other: F.coalesce(f"compactMetadata.{f}", other)
    zero = F.lit(0).cast("long")
    return numbered.where("type = 'system' AND subtype = 'compact_boundary'").select("session_key", "turn_index", F.col("ord").alias("seq"), meta("trigger", F.lit("unknown")).alias("trigger"), meta("preTokens", zero).alias("pre_tokens"), meta("postTokens", zero).alias("post_tokens"))


def refusals(numbered: DataFrame) -> DataFrame:
    """Requests that another model took over (21)."""
    whole = numbered.where("type = 'system' AND subtype = 'model_refusal_fallback' AND originalModel IS NOT NULL AND fallbackModel IS NOT NULL")
    return whole.select("session_key", F.col("ord").alias("seq"), F.col("originalModel").alias("original_model"), F.col("fallbackModel").alias("fallback_model"), F.col("apiRefusalCategory").alias("category"), F.col("requestId").alias("request_id"))


def edited_files(numbered: DataFrame) -> DataFrame:
    """Files that a person edited meanwhile (22)."""
    return numbered.where("type = 'attachment' AND attachment.type = 'edited_text_file' AND attachment.filename IS NOT NULL").select("session_key", "turn_index", F.col("ord").alias("seq"), F.col("attachment.filename").alias("path"))


def pr_refs(numbered: DataFrame) -> DataFrame:
    """Pull requests that a session names (23)."""
    return numbered.where("type = 'pr-link' AND prNumber IS NOT NULL AND prUrl IS NOT NULL").select("session_key", F.col("ord").alias("seq"), F.col("prNumber").alias("pr_number"), F.col("prUrl").alias("pr_url"), F.coalesce("prRepository", F.lit("")).alias("pr_repository"), "at_ms")


def usage_rows(numbered: DataFrame) -> DataFrame:
    """One row a message: its last completed line, tokens in buckets (35-37, 375)."""
    lines = numbered.where("type = 'assistant' AND message.usage IS NOT NULL").select("session_key", "turn_index", F.col("ord").alias("seq"), F.col("message.id").alias("message_id"), "requestId", F.col("agentId").alias("agent_id"), F.col("message.model").alias("model"), F.col("message.stop_reason").alias("stop_reason"), "at_ms", F.col("message.usage").alias("u"), F.coalesce("message.usage.output_tokens", F.lit(0)).alias("out"))
    one = fold_usage_lines(lines.withColumn("_key", F.coalesce("message_id", "requestId", F.col("seq").cast("string"))), ["session_key", "_key"]).drop("_key")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    created = F.coalesce(F.col("u.cache_creation"), F.create_map().cast("map<string,bigint>"))
    w5, w1 = n(F.try_element_at(created, F.lit("ephemeral_5m_input_tokens"))), n(F.try_element_at(created, F.lit("ephemeral_1h_input_tokens")))
    other = F.aggregate(F.map_values(F.map_filter(created, lambda k, v: F.rlike(k, F.lit(r"^ephemeral_.*_input_tokens$")) & ~k.isin("ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens"))), F.lit(0).cast("long"), lambda a, x: a + n(x))
    whole = n(F.col("u.cache_creation_input_tokens"))
    return one.select(
        "session_key", "turn_index", "seq", "message_id", "agent_id", "model", F.timestamp_millis("at_ms").alias("ts"), (F.col("model") != SYNTHETIC).alias("billed"), n(F.col("u.input_tokens")).alias("in_tok"), w5.alias("w5"), w1.alias("w1"), other.alias("wx"),
        F.greatest(whole - w5 - w1 - other, F.lit(0)).alias("wu"), n(F.col("u.cache_read_input_tokens")).alias("rd"), F.col("out"), n(F.try_element_at(F.col("u.output_tokens_details"), F.lit("thinking_tokens"))).alias("thinking"),
    )


def prompt_of(recs: DataFrame, depth: int = 64) -> DataFrame:
    """uuid -> the prompt id of its nearest ancestor that has one (16): pointer jumping, so `depth` ancestors take log2 rounds."""
    cur = recs.select("session_key", "uuid", F.col("parentUuid").alias("up"), F.when(F.col("type") == "user", F.col("promptId")).alias("prompt")).where("uuid IS NOT NULL")
    rounds = max(1, (depth - 1).bit_length())
    for _ in range(rounds):
        above = cur.select("session_key", F.col("uuid").alias("up"), F.col("up").alias("up2"), F.col("prompt").alias("prompt2"))
        cur = cur.join(above, ["session_key", "up"], "left").select("session_key", "uuid", F.when(F.col("prompt").isNull(), F.col("up2")).alias("up"), F.coalesce("prompt", "prompt2").alias("prompt"))
    return cur.select("session_key", "uuid", "prompt")


def merge_timeline(main: DataFrame, subs: DataFrame) -> DataFrame:
    """Main and sub-agents' events in one order (42, 43): a sub event follows the last main event whose running
    maximum of time is not later; main events come first, then time, agent, file, order; seq is numbered anew."""
    w = Window.partitionBy("session_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anchors = main.withColumn("env", F.max("at_ms").over(w)).withColumn("side", F.lit(0))
    placed = subs.withColumn("env", F.col("at_ms")).withColumn("side", F.lit(1))
    both = anchors.unionByName(placed, allowMissingColumns=True)
    order = Window.partitionBy("session_key").orderBy(F.col("env").asc_nulls_first(), "side", F.when(F.col("side") == 0, F.col("ord")), "at_ms", "agentId", "file", "ord")
    return both.withColumn("seq", F.row_number().over(order).cast("long") - 1).drop("env")


def core_problems(numbered: DataFrame, calls: DataFrame) -> DataFrame:
    """Signs that a log's shape is not understood (63)."""
    r = numbered.groupBy("session_key").agg(F.count_if((F.col("type") == "assistant") & (F.size("blocks") == 0)).alias("empty_messages"), F.count_if(F.col("timestamp").isNotNull() & F.col("at_ms").isNull()).alias("bad_times"))
    c = calls.groupBy("session_key").agg(F.count("*").alias("calls"), F.count_if(F.col("output").isNull()).alias("unanswered"))
    joined = r.join(c, "session_key", "left").fillna(0)
    return joined.select("session_key", F.array_compact(F.array(F.when(F.col("empty_messages") > 0, F.lit("messages without content")), F.when(F.col("bad_times") > 0, F.lit("times that do not parse")), F.when((F.col("calls") > 3) & (F.col("unanswered") == F.col("calls")), F.lit("no call has a result")))).alias("problems"))
