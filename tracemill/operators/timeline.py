"""What happened in a turn, call by call: flags, summaries, costs, capping (rows 46, 47, 75, 76, 89, 90, 127, 154, 165, 399, 400).

A call is known by session_key and seq, and facts carry the seq of their call.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import sanitize_cell
from tracemill.operators.relational import as_of_nearest

CALL = ["session_key", "seq"]
#: Flags in the order shown (fixed values).
FLAGS = ("test", "check", "git", "write", "danger", "error", "background")


def events_before(calls: DataFrame, bound: Column) -> DataFrame:
    """Calls up to a bound (46). They are not sorted: whoever shows them orders by seq."""
    return calls.where(F.col("seq") <= bound)


def mark_post_final(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Whether a call came after the final message of its turn; false where the turn has none or is unknown (47, 90)."""
    finals = turns.select("session_key", "turn_index", F.col("final_seq").alias("_final"))
    return calls.join(finals, ["session_key", "turn_index"], "left").withColumn("post_final", F.coalesce(F.col("seq") > F.col("_final"), F.lit(False))).drop("_final")


def post_final_groups(marked: DataFrame, writes: DataFrame, test_runs: DataFrame) -> DataFrame:
    """Per turn and agent, what followed the final message: calls, files changed, test runs (127).

    writes: CALL, path, status, metadata_only; test_runs: CALL. A write counts when it is ok, named and more than metadata (91).
    """
    late = marked.where("post_final").select("session_key", "turn_index", "seq", "agent_id")
    key = ["session_key", "turn_index", "agent_id"]
    changed = writes.where("status = 'ok' AND NOT metadata_only AND path <> ''").select(*CALL, "path", F.lit(0).alias("runs"))
    ran = test_runs.select(*CALL, F.lit(None).cast("string").alias("path"), F.lit(1).alias("runs"))
    # The facts of a call are many, so calls enter as rows of their own and are counted once.
    found = late.join(changed.unionByName(ran), CALL).select(*key, "path", "runs", F.lit(0).alias("calls"))
    own = late.select(*key, F.lit(None).cast("string").alias("path"), F.lit(0).alias("runs"), F.lit(1).alias("calls"))
    return own.unionByName(found).groupBy(*key).agg(F.sum("calls").alias("tool_calls"), F.countDistinct("path").alias("files"), F.sum("runs").alias("test_runs"))


def with_flags(calls: DataFrame, facts: Mapping[str, DataFrame]) -> DataFrame:
    """Calls with the flags that hold, in the order of FLAGS (399): facts of `test`, `check`, `git`, `write` (ok ones)
    and `danger` meet their calls in one join, whatever their number; the rest is known from the call."""
    tagged = None
    for flag, rows in facts.items():
        one = rows.select(*CALL, F.lit(flag).alias("flag"))
        tagged = one if tagged is None else tagged.unionByName(one)
    if tagged is None:
        out = calls.withColumn("_facts", F.array().cast("array<string>"))
    else:
        out = calls.join(tagged.groupBy(*CALL).agg(F.collect_set("flag").alias("_facts")), CALL, "left")
    own = {"write": F.col("kind").isin("edit", "write"), "error": F.col("is_error") | (F.col("exit") != 0), "background": F.col("background")}
    holds = [F.coalesce(F.array_contains("_facts", f), F.lit(False)) | F.coalesce(own.get(f, F.lit(False)), F.lit(False)) for f in FLAGS]
    return out.withColumn("flags", F.array_compact(F.array(*[F.when(h, F.lit(f)) for h, f in zip(holds, FLAGS, strict=True)]))).drop("_facts")


def summary(kind: Column, command: Column, path: Column, url: Column, description: Column, tool: Column) -> Column:
    """One line for a call: command, file or URL as its kind has it, else its description, else the tool (400)."""
    said = lambda c: F.when(c != "", c)
    own = F.when(kind == "shell", said(command)).when(kind.isin("edit", "write", "read"), said(path)).when(kind == "fetch", said(url))
    return sanitize_cell(F.coalesce(own, said(description), tool))


def build(calls: DataFrame, usage: DataFrame, facts: Mapping[str, DataFrame]) -> DataFrame:
    """The timeline of every turn: calls with position, summary, flags and the cost of the nearest usage row (154).

    calls: session_key, turn_index, seq, kind, command, path, url, description, tool, exit, is_error, background;
    usage: session_key, seq, usd.
    """
    priced = as_of_nearest(with_flags(calls, facts), usage.select(*CALL, "usd"), ["session_key"], ["seq"], ["seq"], ["usd"])
    w = Window.partitionBy("session_key", "turn_index").orderBy("seq")
    line = summary(*[F.col(c) for c in ("kind", "command", "path", "url", "description", "tool")])
    return priced.withColumn("summary", line).withColumn("position", F.row_number().over(w)).withColumnRenamed("near_usd", "usd")


def cap(timeline: DataFrame, by: Sequence[str], protected: Column, most: int) -> DataFrame:
    """A timeline cut to `most` rows: protected rows always stay and the latest of the others fill up (75, 76).

    Each run of hidden rows is one row with their number in `hidden` and nulls beside its key and first seq; shown rows have 0.
    """
    shown_first = Window.partitionBy(*by).orderBy(F.col("_protected").desc(), F.col("seq").desc())
    ranked = timeline.withColumn("_protected", F.coalesce(protected, F.lit(False))).withColumn("_keep", F.col("_protected") | (F.row_number().over(shown_first) <= most))
    so_far = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    banded = ranked.withColumn("_band", F.count_if("_keep").over(so_far))
    kept = banded.where("_keep").withColumn("hidden", F.lit(0).cast("long")).drop("_protected", "_keep", "_band")
    gaps = banded.where("NOT _keep").groupBy(*by, "_band").agg(F.min("seq").alias("seq"), F.count("*").alias("hidden")).drop("_band")
    return kept.unionByName(gaps, allowMissingColumns=True)


def full_keys(sessions: DataFrame, order: Sequence[Column | str], full: int = 50) -> DataFrame:
    """The sessions that are shown in full: the first of an order (165). A limit, so Spark keeps only that many a task."""
    return sessions.orderBy(*order).limit(full).select("session_key")
