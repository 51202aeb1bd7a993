"""Rollout transcripts: `{timestamp, type, payload}` lines (rows 48-58, 134-138, 155, 371-374).

Everything is a projection or a window over one parsed table: turns are
cumulative counts of user messages, model and folder are filled forward, token
counts become deltas, calls meet their outputs by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.times import parse_iso
from tracemill.operators.relational import delta_of_totals
from tracemill.sources.hook_ledger import tool_kind

_USAGE = "STRUCT<input_tokens: BIGINT, cached_input_tokens: BIGINT, output_tokens: BIGINT, reasoning_output_tokens: BIGINT, total_tokens: BIGINT>"
LINE = (
    "timestamp STRING, type STRING, payload STRUCT<type: STRING, id: STRING, timestamp: STRING, cwd: STRING, originator: STRING, cli_version: STRING, source: STRING, model: STRING, approval_policy: STRING, sandbox_policy: STRUCT<type: STRING, network_access: BOOLEAN, writable_roots: ARRAY<STRING>>, "
    f"message: STRING, info: STRUCT<total_token_usage: {_USAGE}, last_token_usage: {_USAGE}>, name: STRING, arguments: STRING, input: STRING, call_id: STRING, output: STRING, role: STRING, content: STRING, status: STRING>"
)
KINDS = ("session_meta", "turn_context", "event_msg", "response_item")


def records(lines: DataFrame) -> DataFrame:
    """Typed records of raw lines, with the session's id from its meta line, else from the file's name (49, 50)."""
    got = lines.where(~F.col("bad")).withColumn("j", F.from_json("value", LINE)).select("file", "seq", F.col("j.timestamp").alias("t"), F.col("j.type").alias("record"), "j.payload.*").where(F.col("record").isin(*KINDS))
    w = Window.partitionBy("file")
    named = F.max(F.when(F.col("record") == "session_meta", F.col("id"))).over(w)
    own = F.regexp_extract("file", r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\.jsonl$", 1)
    return got.withColumn("session_id", F.coalesce(named, F.when(own != "", own), F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))).withColumn("session_key", F.concat(F.lit("codex:"), "session_id")).withColumn("at_ms", parse_iso(F.col("t")))


def with_turns(recs: DataFrame) -> DataFrame:
    """Turn index, and model and folder filled forward (51, 155)."""
    w = Window.partitionBy("session_key").orderBy("file", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asks = (F.col("record") == "event_msg") & (F.col("type") == "user_message")
    context = F.col("record") == "turn_context"
    cwd = F.when(context | (F.col("record") == "session_meta"), F.col("cwd"))
    return (
        recs.withColumn("turn_index", (F.sum(F.when(asks, 1).otherwise(0)).over(w) - 1).cast("int"))
        .withColumn("current_model", F.last(F.when(context, F.col("model")), ignorenulls=True).over(w))
        .withColumn("current_cwd", F.last(cwd, ignorenulls=True).over(w))
        .withColumn("ord", F.row_number().over(Window.partitionBy("session_key").orderBy("file", "seq")).cast("long") - 1)
    )


def turns(numbered: DataFrame) -> DataFrame:
    """One row a turn; the final text is the last agent message, else the last assistant message (48)."""
    event = F.col("record") == "event_msg"
    agent = event & (F.col("type") == "agent_message")
    spoken = (F.col("record") == "response_item") & (F.col("type") == "message") & (F.col("role") == "assistant")
    # What held when the turn's final text was said: a context line after it is about the next turn.
    at_final = lambda c: F.coalesce(F.max_by(c, F.when(agent, F.col("ord"))), F.max_by(c, F.when(spoken, F.col("ord"))), F.max_by(c, "ord"))
    said = F.regexp_extract("content", r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    return numbered.where("turn_index >= 0").groupBy("session_key", "turn_index").agg(
        F.min("ord").alias("seq_start"), F.max("ord").alias("seq_end"), F.min("at_ms").alias("started_ms"), F.max("at_ms").alias("ended_ms"),
        F.max_by("message", F.when(event & (F.col("type") == "user_message"), F.col("ord"))).alias("prompt"),
        F.coalesce(F.max_by("message", F.when(agent, F.col("ord"))), F.max_by(said, F.when(spoken, F.col("ord")))).alias("final_text"),
        F.coalesce(F.max(F.when(agent, F.col("ord"))), F.max(F.when(spoken, F.col("ord"))), F.max("ord")).alias("final_seq"),
        at_final("current_model").alias("model"), at_final("current_cwd").alias("cwd"),
    )


def output_text(raw: Column) -> tuple[Column, Column]:
    """(text, exit code) of a call's output: JSON with metadata, a header of `Exit code:` lines, or plain text (54)."""
    as_json = F.from_json(raw, "output STRING, metadata STRUCT<exit_code: INT, duration_seconds: DOUBLE>")
    headed = F.rlike(raw, F.lit(r"^(?:Chunk ID|Wall time|Exit code|Process exited)"))
    code = F.regexp_extract(raw, r"(?m)^(?:Exit code:|Process exited with code) (-?\d+)", 1)
    body = F.regexp_replace(raw, r"(?s)^.*?\n(?:Output|Total output lines[^\n]*\nOutput):\n", "")
    failed = F.regexp_extract(raw, r"^(?:failed in sandbox|exec failed|command timed out)", 0)
    text = F.coalesce(as_json["output"], F.when(headed, body), raw)
    exit_code = F.coalesce(as_json["metadata"]["exit_code"], F.when(headed & (code != ""), code.cast("int")), F.when(failed != "", F.lit(None).cast("int")))
    return text, exit_code


def command_text(arguments: Column) -> Column:
    """The command of a call's arguments: a string, or an array joined, without a `bash -lc` around it (53, 372)."""
    words = F.from_json(F.get_json_object(arguments, "$.command"), "array<string>")
    wrapped = F.get(words, F.lit(0)).isin("bash", "sh", "zsh", "/bin/bash", "/bin/sh") & F.get(words, F.lit(1)).isin("-lc", "-c")
    joined = F.when(wrapped, F.get(words, F.lit(2))).otherwise(F.array_join(words, " "))
    return F.coalesce(F.get_json_object(arguments, "$.cmd"), joined, F.get_json_object(arguments, "$.command"))


def patch_files(patch: Column) -> Column:
    """op and path of each file of a patch envelope (57, 373)."""
    heads = F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* ((?:Add|Update|Delete) File: .+|Move to: .+)$"), F.lit(1))
    return F.transform(heads, lambda h: F.struct(F.lower(F.substring_index(h, " ", 1)).alias("op"), F.trim(F.substring_index(h, ": ", -1)).alias("path")))


def patch_letters(output: Column) -> Column:
    """A, M, D lines of a patch's outcome: they beat the envelope's headers (58, 374)."""
    found = F.regexp_extract_all(output, F.lit(r"(?m)^([AMD] .+)$"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.substring(x, 1, 1).alias("letter"), F.trim(F.substring(x, 3, 100_000)).alias("path")))


def tool_calls(numbered: DataFrame) -> DataFrame:
    """Calls with their outputs; a repeated output counts once, the first (18, 53, 54)."""
    item = F.col("record") == "response_item"
    calls = numbered.where(item & F.col("type").isin("function_call", "custom_tool_call", "local_shell_call"))
    outputs = numbered.where(item & F.col("type").isin("function_call_output", "custom_tool_call_output")).groupBy("session_key", "call_id").agg(F.min_by("output", "ord").alias("raw_output"))
    joined = calls.drop("output").join(outputs, ["session_key", "call_id"], "left")
    text, code = output_text(F.col("raw_output"))
    arguments = F.coalesce("arguments", "input")
    patch = F.coalesce(F.get_json_object(arguments, "$.input"), F.get_json_object(arguments, "$.patch"), F.when(F.contains(arguments, F.lit("*** Begin Patch")), arguments))
    files = F.when(F.contains(F.coalesce(patch, F.lit("")), F.lit("*** Begin Patch")), F.transform(patch_files(patch), lambda f: f["path"]))
    kind = F.when(files.isNotNull() & (F.col("name") == "apply_patch"), F.lit("edit")).otherwise(tool_kind(F.col("name"), F.lit(None).cast("string")))
    return joined.select(
        "session_key", "turn_index", F.col("ord").alias("seq"), F.col("call_id").alias("tool_call_id"), F.col("name").alias("tool"), kind.alias("kind"), command_text(arguments).alias("command"), F.col("current_cwd").alias("cwd"), "at_ms",
        F.coalesce(files, F.array().cast("array<string>")).alias("paths"), F.get_json_object(arguments, "$.url").alias("url"), text.alias("output"), code.alias("exit"),
        F.when(code.isNull(), "unknown").otherwise("harness").alias("exit_source"), F.coalesce(code != 0, F.lit(False)).alias("is_error"), F.rlike(F.coalesce("raw_output", F.lit("")), F.lit(r"(?i)^(?:rejected by user|denied)")).alias("denied"), F.rlike(F.coalesce("raw_output", F.lit("")), F.lit("(?i)command timed out")).alias("timed_out"),
        F.contains(F.coalesce("raw_output", F.lit("")), F.lit("truncated")).alias("truncated"), F.lit(None).cast("array<struct<old:string,new:string>>").alias("edits"),
    )


def token_deltas(numbered: DataFrame) -> DataFrame:
    """Deltas of the running token totals with their model, and the last input for the tier (52, 55)."""
    counts = numbered.where((F.col("record") == "event_msg") & (F.col("type") == "token_count") & F.col("info.total_token_usage").isNotNull())
    flat = counts.select("session_key", "turn_index", F.col("ord").alias("seq"), "at_ms", F.col("current_model").alias("model"), *[F.coalesce(F.col(f"info.total_token_usage.{c}_tokens"), F.lit(0).cast("long")).alias(n) for c, n in (("input", "d_in"), ("cached_input", "d_cached"), ("output", "d_out"))], F.col("info.last_token_usage.input_tokens").alias("last_input"))
    got = delta_of_totals(flat, ["session_key"], ["seq"], ["d_in", "d_cached", "d_out"])
    return got.select("session_key", "turn_index", "seq", F.timestamp_millis("at_ms").alias("ts"), "model", F.col("delta_d_in").alias("d_in"), F.col("delta_d_cached").alias("d_cached"), F.col("delta_d_out").alias("d_out"), F.coalesce("last_input", "d_in").alias("last_input"))


def usage_by_model(deltas: DataFrame) -> DataFrame:
    """Uncached, cached and output tokens per model (56)."""
    return deltas.groupBy("session_key", "model").agg((F.sum("d_in") - F.sum("d_cached")).alias("uncached"), F.sum("d_cached").alias("cached"), F.sum("d_out").alias("out"))
