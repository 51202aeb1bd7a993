"""The hook ledger: an append-only stream of events, to turns and tool calls (rows 59-62, 81, 299-301, 305, 311-319, 322-324).

One wide nullable schema discriminated by `e`. File order is the order of
events; `t` orders nothing. The same functions serve the batch and the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.masking import mask_secrets
from tracemill.functions.text import head_tail, safe_sid
from tracemill.functions.times import parse_iso
from tracemill.sources.jsonl import HARNESSES

EVENTS = ("session-start", "prompt", "agent-response", "tool-post", "tool-fail", "subagent-stop", "stop", "session-end", "gap")
#: Columns of a line, in order, with their types.
COLUMNS = {
    **dict.fromkeys(("t", "h", "e", "sid", "tid", "cwd", "hv", "model", "exitSource", "text", "transcript", "source", "id", "tool", "kind"), "STRING"),
    "v": "INT",
    "in": "STRUCT<command: STRING, path: STRING, paths: ARRAY<STRING>, edits: ARRAY<STRUCT<old: STRING, new: STRING>>, editsTruncated: BOOLEAN, url: STRING, raw: STRING>",
    "out": "STRUCT<text: STRING, bytes: BIGINT, exit: INT, error: BOOLEAN, durationMs: BIGINT, truncated: BOOLEAN>",
    "ambiguousRoot": "BOOLEAN",
    "error": "STRING",
    "failureType": "STRING",
    "durationMs": "BIGINT",
    "agent": "STRUCT<type: STRING, status: STRING, summary: STRING, modifiedFiles: ARRAY<STRING>, transcript: STRING, text: STRING>",
    "status": "STRING",
    "loop": "BOOLEAN",
    "reason": "STRING",
    "bytes": "BIGINT",
}
SCHEMA = ", ".join(f"`{c}` {t}" for c, t in COLUMNS.items())
KNOWN_KEYS = list(COLUMNS)
#: Characters kept of texts, commands and outputs.
CAPS = {"text": 65_536, "command": 16_384, "out": 32_768, "error": 4_096}

#: (tool name, lower case) -> kind; what a line says of itself is only a hint.
TOOL_KINDS = {
    "bash": "shell", "shell": "shell", "shell_command": "shell", "run_shell_command": "shell", "terminal": "shell", "exec": "shell", "execute": "shell", "run_in_terminal": "shell", "local_shell": "shell",
    "write": "write", "write_file": "write", "create_file": "write", "create": "write", "edit": "edit", "multiedit": "edit", "edit_file": "edit", "replace": "edit", "str_replace": "edit", "apply_patch": "edit", "patch": "edit", "notebookedit": "edit", "insert_edit_into_file": "edit",
    "read": "read", "read_file": "read", "view": "read", "cat": "read", "glob": "search", "grep": "search", "search": "search", "ls": "search", "list_dir": "search", "codebase_search": "search",
    "webfetch": "web", "web_fetch": "web", "fetch": "web", "websearch": "web", "web_search": "web", "google_web_search": "web", "task": "agent", "agent": "agent", "subagent": "agent", "todowrite": "plan", "update_plan": "plan",
}


def tool_kind(tool: Column, hint: Column) -> Column:
    """The kind of a tool: by its name, then as an MCP tool, then as the line hints, else other (28, 62, 371)."""
    known = F.create_map(*[F.lit(x) for kv in TOOL_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(tool)), F.when(F.startswith(tool, F.lit("mcp__")), F.lit("mcp")), hint, F.lit("other"))


def parse_events(lines: DataFrame) -> DataFrame:
    """Typed events of raw lines (file, seq, value, bad), with what is wrong with the others (60).

    status: line, bad, unknown-event or bad-version.
    """
    got = lines.withColumn("j", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}))
    status = F.when(F.col("bad") | F.col("j.e").isNull(), "bad").when(~F.col("j.e").isin(*EVENTS), "unknown-event").when(F.coalesce(F.col("j.v"), F.lit(0)) != 1, "bad-version").otherwise("line")
    flat = got.withColumn("status_of_line", status).select("file", "seq", "status_of_line", *[F.col(f"j.`{c}`").alias(c) for c in KNOWN_KEYS])
    known = F.col("h").isin(*HARNESSES)
    return flat.withColumn("h", F.when(known, F.col("h")).otherwise("other")).withColumn("sid", F.coalesce("sid", unknown_sid(F.col("cwd"), F.col("t")))).withColumn("session_key", F.concat_ws(":", "h", "sid")).withColumn("at_ms", parse_iso(F.col("t")))


def unknown_sid(cwd: Column, t: Column) -> Column:
    """A name for events without a session: their folder and day (324)."""
    return F.concat(F.lit("unknown-"), F.substring(F.sha2(F.concat_ws("|", F.coalesce(cwd, F.lit("")), F.substring(t, 1, 10)), 256), 1, 12))


def prepare_events(events: DataFrame) -> DataFrame:
    """Caps, then masking: what may be stored (300, 301, 323)."""
    cap = lambda c, n: mask_secrets(head_tail(c, n))
    tool_in = F.when(F.col("in").isNotNull(), F.col("in").withField("command", cap(F.col("in.command"), CAPS["command"])))
    tool_out = F.when(F.col("out").isNotNull(), F.col("out").withField("text", cap(F.col("out.text"), CAPS["out"])))
    return events.withColumn("text", cap(F.col("text"), CAPS["text"])).withColumn("error", cap(F.col("error"), CAPS["error"])).withColumn("in", tool_in).withColumn("out", tool_out)


def salvage(value: Column) -> Column:
    """What can be told of a line that does not parse: tool, session, command, path (297-299)."""
    head = F.substring(value, 1, 65_536)

    def part(keys: str) -> Column:
        got = F.regexp_extract(head, rf'"(?:{keys})"\s*:\s*"((?:[^"\\]|\\.){{1,4000}})"', 1)
        return F.when(got != "", got)

    return F.struct(part("tool|tool_name").alias("tool"), part("sid|session_id").alias("sid"), part("command").alias("command"), part("path|file_path").alias("path"))


def with_turns(events: DataFrame) -> DataFrame:
    """Number the turns: a `stop` closes one, what follows opens the next (59)."""
    w = Window.partitionBy("session_key").orderBy("file", "seq")
    before = F.sum(F.when(F.col("e") == "stop", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return events.where("status_of_line = 'line'").withColumn("turn_index", F.coalesce(before, F.lit(0)).cast("int")).withColumn("ord", F.row_number().over(w).cast("long") - 1)


def turns(numbered: DataFrame) -> DataFrame:
    """One row a turn: bounds, prompt, final text and where it came from, whether the turn ended (59, 61)."""
    said = lambda e: F.when((F.col("e") == e) & (F.trim("text") != ""), F.col("ord"))
    per = numbered.groupBy("session_key", "turn_index").agg(
        F.min("ord").alias("seq_start"),
        F.max("ord").alias("seq_end"),
        F.min("at_ms").alias("started_ms"),
        F.max("at_ms").alias("ended_ms"),
        F.max_by("text", said("prompt")).alias("prompt"),
        F.max_by("text", said("stop")).alias("stop_text"),
        F.max_by("text", said("agent-response")).alias("response_text"),
        F.max(F.when(F.col("e") == "stop", F.col("ord"))).alias("stop_ord"),
        F.max(F.when((F.col("e") == "agent-response"), F.col("ord"))).alias("response_ord"),
        F.max_by("status", F.when(F.col("e") == "stop", F.col("ord"))).alias("status"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("ord"))).alias("model"),
        F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("ord"))).alias("cwd"),
        F.bool_or(F.col("e") == "gap").alias("has_gap"),
        F.count_if(F.col("e").isin("tool-post", "tool-fail")).alias("n_calls"),
        F.bool_or(F.col("e").isin("prompt", "agent-response", "tool-post", "tool-fail", "subagent-stop", "stop")).alias("real"),
    )
    final = F.coalesce("stop_text", "response_text")
    return per.where("real").select(
        "session_key", "turn_index", "seq_start", "seq_end", "started_ms", "ended_ms", "prompt", final.alias("final_text"), F.coalesce("stop_ord", "response_ord", "seq_end").alias("final_seq"), F.coalesce("status", F.when(F.col("stop_ord").isNull(), F.lit("open")), F.lit("completed")).alias("status"),
        "model", "cwd", "has_gap", "n_calls",
    )


def tool_calls(numbered: DataFrame) -> DataFrame:
    """One row a tool call with its exit code and where that came from (20, 30, 322)."""
    calls = numbered.where(F.col("e").isin("tool-post", "tool-fail"))
    failed = F.col("e") == "tool-fail"
    code = F.col("out.exit")
    given = F.coalesce(F.col("id"), F.substring(F.sha2(F.concat_ws("|", "t", "tool", F.to_json("in")), 256), 1, 16))
    return calls.select(
        "session_key", "turn_index", F.col("ord").alias("seq"), given.alias("tool_call_id"), "tool", tool_kind(F.col("tool"), F.col("kind")).alias("kind"), F.col("in.command").alias("command"), "cwd", "at_ms",
        F.array_compact(F.concat(F.array("in.path"), F.coalesce("in.paths", F.array().cast("array<string>")))).alias("paths"), F.col("in.url").alias("url"), F.col("out.text").alias("output"),
        code.alias("exit"), F.when(code.isNull(), F.lit("unknown")).otherwise(F.coalesce("exitSource", F.lit("harness"))).alias("exit_source"),
        (failed | F.coalesce("out.error", F.lit(False)) | F.coalesce(code != 0, F.lit(False))).alias("is_error"), F.coalesce(F.col("failureType") == "permission_denied", F.lit(False)).alias("denied"), F.coalesce(F.col("failureType") == "timeout", F.lit(False)).alias("timed_out"), F.coalesce("out.truncated", F.lit(False)).alias("truncated"),
        F.col("in.edits").alias("edits"), F.coalesce(F.col("out.durationMs"), F.col("durationMs")).alias("duration_ms"),
    )


def sessions(numbered: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """One row a session: bounds, versions, how much of it the ledger covers and why not all (59, 131, 402)."""
    per = numbered.groupBy("session_key").agg(
        F.first("h").alias("harness"), F.first("sid").alias("session_id"), F.min("at_ms").alias("started_ms"), F.max("at_ms").alias("ended_ms"), F.min_by("hv", F.when(F.col("hv").isNotNull(), F.col("ord"))).alias("first_version"), F.max_by("hv", F.when(F.col("hv").isNotNull(), F.col("ord"))).alias("last_version"),
        F.bool_or(F.col("e") == "session-start").alias("saw_start"), F.bool_or(F.col("e") == "gap").alias("has_gap"), F.bool_or(F.coalesce("ambiguousRoot", F.lit(False))).alias("ambiguous"), F.collect_set("cwd").alias("cwds"),
    )
    if bad is not None:
        per = per.join(bad.groupBy("session_key").agg(F.lit(True).alias("has_bad")), "session_key", "left")
    else:
        per = per.withColumn("has_bad", F.lit(None).cast("boolean"))
    reasons = F.array_compact(F.array(F.when(~F.col("saw_start"), F.lit("started before the ledger")), F.when(F.col("has_gap"), F.lit("gap")), F.when(F.col("ambiguous"), F.lit("ambiguous root")), F.when(F.coalesce("has_bad", F.lit(False)), F.lit("unreadable lines"))))
    version = F.when(F.col("first_version") == F.col("last_version"), F.col("first_version")).otherwise(F.concat("first_version", F.lit("→"), "last_version"))
    return per.withColumn("coverage_reasons", reasons).withColumn("coverage", F.when(F.size("coverage_reasons") == 0, "all-tools").otherwise("partial")).withColumn("harness_version", version).withColumn("file_sid", safe_sid(F.col("session_id"))).select("session_key", "harness", "session_id", "file_sid", "started_ms", "ended_ms", "harness_version", "coverage", "coverage_reasons", "cwds")


def append_events(events: DataFrame, path: str) -> None:
    """Append prepared events as JSON lines, one folder a tool (81)."""
    prepare_events(events).select(*KNOWN_KEYS).withColumn("harness", F.col("h")).write.mode("append").partitionBy("harness").json(path)
