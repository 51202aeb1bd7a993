"""Which sessions and turns a report is about (rows 85-87, 94-96, 325, 407)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.facts import canon

#: Characters that a shortened id must have at least (fixed value).
MIN_PREFIX = 4


def by_project(sessions: DataFrame, project: str, home: str = "/root") -> DataFrame:
    """Sessions one of whose folders contains the project's name or its resolved path, so lies under it as well (85)."""
    needle = project.strip()
    if not needle:
        return sessions
    resolved = canon(F.lit(needle), F.lit(None).cast("string"), home)
    return sessions.where(F.exists("cwds", lambda d: F.contains(d, F.lit(needle)) | F.coalesce(F.contains(d, resolved), F.lit(False))))


def by_harness(sessions: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sessions of the named tools; no names, no filter (86)."""
    return sessions.where(F.col("harness").isin(*names)) if names else sessions


def ended_in(turns: DataFrame, start: Column, end: Column, at: str = "ended_ms") -> DataFrame:
    """Turns that ended in [start, end); turns without an end are dropped (87)."""
    return turns.where((F.col(at) >= start) & (F.col(at) < end))


def latest_done(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """The newest session with a done turn; ties go to the smaller key, sessions without an end come last (94)."""
    done = turns.where("is_done").select("session_key")
    return sessions.join(done, "session_key", "left_semi").orderBy(F.col("ended_ms").desc_nulls_last(), "session_key").limit(1)


def select_turns(turns: DataFrame, wanted: int | None = None) -> DataFrame:
    """A turn of each session: the wanted one, else the last that is done, else the last (96)."""
    if wanted is not None:
        return turns.where(F.col("turn_index") == wanted)
    done = F.coalesce("is_done", F.lit(False))
    return turns.groupBy("session_key").agg(F.max_by("turn_index", F.struct(done, "turn_index")).alias("turn_index"))


def resolve_ids(sessions: DataFrame, selectors: DataFrame) -> DataFrame:
    """What each typed selector means: `found` with its session, `ambiguous`, `too-short` or `not-found` (95).

    A whole session id comes first, then the beginning of an id, short id or file name, in either case. Each name is
    cut to the lengths that were typed, and its beginnings, one row each with the sessions that they lead to, meet the
    selectors by equality: however many names share their first characters, no name meets more selectors than it has
    beginnings.
    """
    name = lambda c, whole: F.struct(F.lower(c).alias("name"), F.lit(whole).alias("whole"))
    names = sessions.select("session_key", F.inline(F.array(name("session_id", True), name("short_id", False), name("file", False))))
    typed = selectors.select("selector").distinct().withColumn("s", F.lower("selector"))
    long = F.char_length("s") >= MIN_PREFIX
    lengths = typed.select(F.char_length("s").alias("k")).distinct()  # as many rows as the longest selector has characters, at most
    exact = F.col("whole") & (F.col("k") == F.char_length("name"))
    begun = names.join(F.broadcast(lengths), (F.col("k") <= F.char_length("name")) & (exact | (F.col("k") >= MIN_PREFIX)))
    own = F.when(exact, F.col("session_key"))
    per = begun.groupBy(F.substring("name", F.lit(1), F.col("k")).alias("s")).agg(F.min(own).alias("e0"), F.max(own).alias("e1"), F.min("session_key").alias("a0"), F.max("session_key").alias("a1"))
    status = F.when(F.col("e0").isNotNull(), F.when(F.col("e0") == F.col("e1"), "found").otherwise("ambiguous")).when(~long, "too-short").when(F.col("a0").isNull(), "not-found").when(F.col("a0") == F.col("a1"), "found").otherwise("ambiguous")
    out = typed.join(per, "s", "left").withColumn("status", status)
    return out.select("selector", "status", F.when(F.col("status") == "found", F.coalesce("e0", "a0")).alias("session_key"))


def has_warnings(also_did: DataFrame) -> DataFrame:
    """Turns with a warning among what they did beside their claims (325)."""
    return also_did.groupBy("session_key", "turn_index").agg(F.bool_or("warn").alias("has_warnings"))
