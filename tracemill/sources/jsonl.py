"""Line-delimited JSON: enumeration and the bronze scan (rows 1-11, 67, 97, 291, 360, 363, 408)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines longer than this are bad, not parsed.
MAX_LINE = 64 * 1024 * 1024
#: Tools whose logs are known.
HARNESSES = ("claude-code", "codex", "cursor", "gemini", "copilot", "hermes", "dsh", "opencode", "openclaw")


def list_files(spark: SparkSession, root: str, pattern: str = "*.jsonl", since: datetime | None = None) -> DataFrame:
    """path, size, mtime of the files below a root, newest first; contents are not read (2, 3, 6, 360)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def refs(files: DataFrame) -> DataFrame:
    """One row per main file with the manifest of its sub-agents' files: those in a folder `subagents` below the session's (3, 363)."""
    sub = F.regexp_extract("path", r"^(.*)/([^/]+)/subagents/(.+)$", 2)
    base = F.regexp_extract("path", r"^(.*)/([^/]+)/subagents/(.+)$", 1)
    rel = F.regexp_extract("path", r"^(.*)/([^/]+)/subagents/(.+)$", 3)
    own = files.withColumn("folder", F.when(sub != "", base).otherwise(F.regexp_extract("path", r"^(.*)/[^/]+$", 1))).withColumn("session_id", F.when(sub != "", sub).otherwise(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))).withColumn("rel", F.when(sub != "", rel))
    # A session has a handful of sub-agents; the manifest is one row's worth.
    manifest = own.where("rel IS NOT NULL").groupBy("folder", "session_id").agg(F.array_sort(F.collect_list(F.struct("rel", "size", "mtime"))).alias("manifest"))
    return own.where("rel IS NULL").drop("rel").join(manifest, ["folder", "session_id"], "left").orderBy(F.desc("mtime"), "path")


def rollout_date(path: Column) -> Column:
    """The date in a rollout file's name, null if there is none (4, 5)."""
    return F.try_to_timestamp(F.regexp_extract(path, r"rollout-(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")


def prune_rollouts(files: DataFrame, since: date) -> DataFrame:
    """Files whose name's date is two days or more before the window are skipped; names without a date never (5)."""
    day = rollout_date(F.col("path"))
    return files.where(day.isNull() | (day > F.lit(since - timedelta(days=2))))


def titles(lines: DataFrame) -> DataFrame:
    """id, title of a title index: the last entry of an id wins (7)."""
    got = lines.select(F.lower(F.get_json_object("value", "$.id")).alias("id"), F.get_json_object("value", "$.thread_name").alias("title"), "seq").where("id IS NOT NULL")
    return got.groupBy("id").agg(F.max_by("title", "seq").alias("title"))


def raw_lines(spark: SparkSession, paths: str | Sequence[str], count_only: Sequence[str] = ()) -> DataFrame:
    """The bronze table: file, seq (from 0), value, sniffed_type, bad, count_only (9-11).

    Lines end at a line feed only; one carriage return before it goes; blank lines are skipped but counted in seq.
    The order within a file is the block's offset, then the position in the block, so big files may be split.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths)
    at = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("value"))
    w = Window.partitionBy("file").orderBy("block", "n")
    lines = at.withColumn("seq", F.row_number().over(w).cast("long") - 1).where(F.trim("value") != "")
    sniffed = F.regexp_extract(F.substring("value", 1, 256), r'"type"\s*:\s*"([A-Za-z_-]+)"', 1)
    typed = lines.withColumn("sniffed_type", F.when(sniffed != "", sniffed))
    counted = F.coalesce(F.col("sniffed_type").isin(*count_only), F.lit(False)) if count_only else F.lit(False)
    # Parsing is guarded, so that count-only and oversized lines are never parsed.
    bad = F.when(counted, F.lit(False)).when(F.octet_length("value") > MAX_LINE, F.lit(True)).otherwise(F.try_parse_json("value").isNull())
    return typed.withColumn("count_only", counted).withColumn("bad", bad).select("file", "seq", "value", "sniffed_type", "count_only", "bad")


def scan_summary(lines: DataFrame) -> DataFrame:
    """Records, bad and count-only lines per file (9, 410)."""
    return lines.groupBy("file").agg(F.count("*").alias("records"), F.count_if("bad").alias("bad"), F.count_if("count_only").alias("count_only"))


def unknown_keys(lines: DataFrame, known: Sequence[str]) -> DataFrame:
    """How often each top-level key that is not known occurs (60, 170)."""
    keys = F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))
    return lines.where(~F.col("bad")).select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def cache_key(path: Column, size: Column, mtime: Column, version: str, manifest: Column) -> Column:
    """Names the parsed form of a file; rules and prices are left out on purpose, they are applied later (65)."""
    return F.sha2(F.concat_ws("\x00", path, size.cast("string"), mtime.cast("string"), F.lit(version), F.to_json(manifest)), 256)


def expired(files: DataFrame, now: datetime, days: int) -> DataFrame:
    """Files older than the retention (408)."""
    return files.where(F.col("mtime") < F.lit(now - timedelta(days=days)))


def session_id_of(name: str) -> str:
    """The id in a rollout's file name (326)."""
    m = re.search(r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$", name)
    return m[1] if m else re.sub(r"\.jsonl$", "", name)
