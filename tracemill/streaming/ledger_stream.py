"""The hook ledger as a stream (rows 14, 81, 296, 302-305, 309).

Events are read as they are appended, typed and masked by the same functions as
in batch, and a stateful operator per session keeps the open turn: a `stop`
closes it and emits one row; an open turn whose session stays silent is emitted
when its timer fires, marked as open. State is one small struct a session, never
a list of events, and holds no prompt text, only its hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.sources import hook_ledger

TURN = "session_key string, turn_index int, status string, n_events long, n_calls long, n_failed long, started_ms long, ended_ms long, prompt_sha1 string, final_chars int"
STATE = "turn_index int, n_events long, n_calls long, n_failed long, started_ms long, ended_ms long, prompt_sha1 string, response_chars int"
#: Silence after which an open turn is reported.
IDLE_MS = 30 * 60 * 1000
_FRESH = (0, 0, 0, 0, 0, "", 0)


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Typed events of the JSON lines below a folder, in the ledger's own shape."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("lineSep", "\n").option("recursiveFileLookup", True).schema("value string").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value")).where(F.trim("value") != "")
    # In a stream a line's place is its file and time; rows of a batch keep their order by t, then by what they are.
    events = hook_ledger.parse_events(lines.withColumn("seq", F.col("block")).withColumn("bad", F.try_parse_json("value").isNull()))
    return hook_ledger.prepare_events(events).where("status_of_line = 'line'")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turn, rows = 0, []
    n, calls, failed, start, end, prompt, chars = _FRESH
    if state.exists:
        turn, n, calls, failed, start, end, prompt, chars = state.get

    def row(status: str, final: int) -> tuple:
        return (key[0], turn, status, n, calls, failed, start, end, prompt, final)

    if state.hasTimedOut:
        if n:
            rows.append(row("open", chars))
        turn += 1
        state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TURN.split(", ")])
        return
    order = {"session-start": 0, "prompt": 1, "tool-post": 2, "tool-fail": 2, "subagent-stop": 3, "agent-response": 4, "stop": 5, "session-end": 6, "gap": 2}
    every = pd.concat(list(batches), ignore_index=True)
    every["_o"] = every["e"].map(order).fillna(9)
    every = every.sort_values(["at_ms", "_o"], kind="stable")
    for e, at, text, status in zip(every["e"], every["at_ms"], every["text"], every["status"], strict=True):
        at = 0 if at != at or at is None else int(at)
        n += 1
        start, end = (at if not start else min(start, at)), max(end, at)
        size = len(text) if isinstance(text, str) else 0
        if e in ("tool-post", "tool-fail"):
            calls, failed = calls + 1, failed + (e == "tool-fail")
        elif e == "prompt":
            prompt = hashlib.sha1((text or "").encode()).hexdigest()
        elif e == "agent-response":
            chars = size or chars
        elif e == "stop":
            rows.append(row(status if isinstance(status, str) else "completed", size or chars))
            turn += 1
            n, calls, failed, start, end, prompt, chars = _FRESH
    state.update((turn, n, calls, failed, start, end, prompt, chars))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in TURN.split(", ")])


def turn_stream(events: DataFrame) -> DataFrame:
    """A row for each turn as it ends."""
    return events.select("session_key", "e", "at_ms", "text", "status").groupBy("session_key").applyInPandasWithState(_step, TURN, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events per tool and time window; what comes later than the watermark is left out."""
    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "h", "e").agg(F.count("*").alias("n")).select("window.start", "window.end", "h", "e", "n")


def write_turns(turns: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Turns appended as Parquet, exactly once by the checkpoint."""
    out = turns.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="10 seconds")).start()
