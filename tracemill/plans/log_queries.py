"""Queries of the log engine's own operators over the bundled tables.

The tables hold no agent logs, so each query spells log rows out of theirs (an
order is a session, a line item a call) and runs the engine's operator on all of
them; the SQL twin computes the same result directly.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text, times
from tracemill.operators import claims, cost, reconcile, runners, shell
from tracemill.sources import hook_ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query("""
SELECT user_id, 'pytest' AS runner, cast(count(*) FILTER (event_type = 'view') AS INT) AS passed, cast(count(*) FILTER (event_type = 'error') AS INT) AS failed,
  cast(count(*) FILTER (event_type = 'click') AS INT) AS skipped, cast(count(*) FILTER (event_type IN ('view', 'error', 'click')) AS INT) AS total FROM events GROUP BY user_id""")
def runner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-runner output parsed back to counts (198-200, 327)."""
    n = lambda kind: F.count_if(F.col("event_type") == kind).cast("string")
    said = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("collected\n==== "), n("error"), F.lit(" failed, "), n("view"), F.lit(" passed, "), n("click"), F.lit(" skipped in 1.25s ====\n")).alias("out"))
    return said.select("user_id", runners.parsed_run(F.lit(None).cast("string"), F.col("out")).alias("r")).select("user_id", "r.runner", "r.passed", "r.failed", "r.skipped", "r.total")


_COMMANDS = ["cd a && uv run pytest -q tests/t.py | tail -3", "npx eslint . --fix", "npm run build", "git -C x push origin main", "pip install left-pad", "sudo rm -rf build"]


@query("""
SELECT p_partkey, ['test', 'lint', 'build', 'git', 'install', 'write'][p_size % 6 + 1] AS family, ['pytest', 'eslint', 'npm', 'git', 'pip', 'rm'][p_size % 6 + 1] AS program,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 3 END AS exit FROM part""")
def shell_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines to programs, families and exit codes (171-178)."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*[F.lit(c) for c in _COMMANDS]), (F.col("p_size") % 6).cast("int")).alias("c"), (F.col("p_size") % 3).cast("int").alias("x"))
    s = p.select("p_partkey", F.explode(shell.segments(F.col("c"), F.lit("/w"), F.col("x"), F.lit(None).cast("string"), F.lit(False))).alias("s"))
    return s.where("s.program NOT IN ('cd', 'tail')").select("p_partkey", "s.family", "s.program", "s.exit")


@query("""
WITH m AS (SELECT o_orderkey AS k, o_orderkey % 4 AS c FROM orders)
SELECT k AS o_orderkey, ['test', 'test', 'git', 'completion'][c + 1] AS kind, CASE WHEN c = 1 THEN 'negated' ELSE 'positive' END AS polarity, CASE WHEN c = 0 THEN cast(k % 900 + 1 AS INT) END AS count,
  CASE WHEN c = 2 THEN 'abcdef0' END AS sha FROM m""")
def claims_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in final messages with polarity and fields (214-227)."""
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, F.concat(F.lit("All "), (k % 900 + 1).cast("string"), F.lit(" tests pass."))).when(k % 4 == 1, F.lit("The tests are not passing.")).when(k % 4 == 2, F.lit("I committed it as `abcdef0`.")).otherwise(F.lit("Done."))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    found = o.select("o_orderkey", F.inline(claims.claims(F.col("said"), F.lit(0), F.array().cast("array<string>"), F.lit(None).cast("string"))))
    return found.select("o_orderkey", "kind", "polarity", "count", "sha")


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, bool_or(l_linestatus = 'O') AS wrote, bool_or(l_returnflag <> 'A') AS ran, bool_or(l_returnflag = 'R') AS red FROM lineitem GROUP BY ALL),
f AS (SELECT k, max(CASE WHEN wrote THEN n * 10 END) AS w, max(CASE WHEN ran THEN n * 10 + 5 END) AS r, arg_max(red, n) FILTER (ran) AS red FROM l GROUP BY k)
SELECT 'o:' || k AS session_key, CASE WHEN r IS NULL AND w IS NOT NULL THEN 'CONTRADICTED' WHEN r IS NULL THEN 'UNVERIFIED' WHEN w IS NOT NULL AND r < w THEN 'UNVERIFIED' WHEN red THEN 'CONTRADICTED' ELSE 'VERIFIED' END AS verdict,
  CASE WHEN r IS NULL THEN 'no-test-run' WHEN w IS NOT NULL AND r < w THEN 'stale-run' WHEN red THEN 'last-run-red' ELSE 'ok' END AS reason FROM f""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of passing tests against writes and runs (229-232): an order's open lines are writes, its kept and returned lines runs."""
    li = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o:"), "l_orderkey").alias("session_key"), F.lit(0).alias("turn_index"), F.lit(0).alias("ordinal"), "l_linenumber", "l_linestatus", "l_returnflag")
    writes = li.where("l_linestatus = 'O'").select("session_key", "turn_index", "ordinal", (F.col("l_linenumber") * 10).cast("long").alias("seq"), F.lit("/w/a.py").alias("path"), F.lit("update").alias("op"), F.lit("ok").alias("status"), F.lit(False).alias("metadata_only"), F.lit(False).alias("is_test"), F.lit(False).alias("is_doc"))
    ran = li.where("l_returnflag <> 'A'").groupBy("session_key", "turn_index", "ordinal", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "R").alias("red"))
    runs = ran.select("session_key", "turn_index", "ordinal", (F.col("l_linenumber") * 10 + 5).cast("long").alias("seq"), F.when(F.col("red"), "red").otherwise("green").alias("green"), F.lit(True).alias("conclusive"), F.lit("pytest").alias("raw"))
    none = spark.createDataFrame([], "session_key string, seq long")
    facts = reconcile.fact_table(writes, runs, none, none, none)
    turns = li.select("session_key", "turn_index").distinct().withColumn("final_seq", F.lit(1000)).withColumn("cwd", F.lit("/w"))
    asked = turns.select("session_key", "turn_index", F.inline(claims.claims(F.lit("All tests pass."), F.col("turn_index"), F.array().cast("array<string>"), F.lit(None).cast("string"))))
    return reconcile.judgements(asked, facts, turns).select("session_key", "verdict", "reason")


_PRICES = cost.PriceTable(
    "driver-1",
    {
        "alpha": cost.Model("p", rates=[cost.Window_(2.0, 8.0, valid_until=date(1994, 12, 31)), cost.Window_(1.0, 4.0, valid_from=date(1995, 1, 1))], tiers=[cost.Tier(3000, 3.0, 9.0)]),
        "beta-": cost.Model("p", match="prefix", rates=[cost.Window_(10.0, 20.0, valid_from=date(1996, 1, 1))]),
    },
    {"p": (0.1, 1.25, 2.0)},
)


@query("""
WITH a AS (SELECT l_orderkey, l_returnflag AS f, cast(l_shipdate AS DATE) AS day, cast(l_quantity AS BIGINT) * 100 AS i, l_linenumber * 10 AS o FROM lineitem),
p AS (SELECT *, CASE WHEN f = 'R' AND i > 3000 THEN 3.0 WHEN f = 'R' AND day <= DATE '1994-12-31' THEN 2.0 WHEN f = 'R' THEN 1.0 WHEN f = 'A' THEN 10.0 ELSE 0 END AS ri, CASE WHEN f = 'R' AND i > 3000 THEN 9.0 WHEN f = 'R' AND day <= DATE '1994-12-31' THEN 8.0 WHEN f = 'R' THEN 4.0 WHEN f = 'A' THEN 20.0 ELSE 0 END AS ro FROM a)
SELECT cast(l_orderkey AS VARCHAR) AS session_key, floor(sum((i * ri + o * ro) / 1e6::DOUBLE) * 1e6 + 0.5) / 1e6 AS usd, bool_or(f = 'A' AND day < DATE '1996-01-01') AS estimated, CASE WHEN bool_or(f = 'N') THEN 'omega' ELSE '' END AS unpriced FROM p GROUP BY l_orderkey""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage priced by dated windows, tiers, prefixes; unknown models listed (106-108, 132-136, 272)."""
    li = _t(spark, sf_dir, "lineitem")
    model = F.when(F.col("l_returnflag") == "R", "alpha").when(F.col("l_returnflag") == "A", "beta-x").otherwise("omega")
    zero = F.lit(0).cast("long")
    attempts = li.select(F.col("l_orderkey").cast("string").alias("session_key"), model.alias("model"), F.col("l_shipdate").alias("ts"), F.lit(True).alias("billed"), F.lit(False).alias("inherited"), (F.col("l_quantity").cast("long") * 100).alias("in_tok"), zero.alias("w5"), zero.alias("w1"), zero.alias("wx"), zero.alias("wu"), zero.alias("rd"), (F.col("l_linenumber") * 10).cast("long").alias("out"))
    priced = cost.price_attempts(attempts, _PRICES, ["alpha", "beta-x", "omega"])
    return cost.session_cost(priced).select("session_key", "usd", "estimated", F.array_join("unpriced_models", ",").alias("unpriced"))


@query("""
WITH t AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ti FROM conversations WHERE role <> 'system')
SELECT 'cursor:' || conv_id AS session_key, cast(ti AS INT) AS turn_index, count(*) AS n_events, CASE WHEN bool_or(role = 'assistant') THEN 'completed' ELSE 'open' END AS status,
  sha1(arg_max(text, turn) FILTER (role = 'user')) AS prompt_sha1, arg_max(length(text), turn) FILTER (role = 'assistant') AS final_chars FROM t GROUP BY conv_id, ti""")
def ledger_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines parsed, prepared and cut into turns (59-62, 300, 301)."""
    c = _t(spark, sf_dir, "conversations").where("role <> 'system'")
    event = F.when(F.col("role") == "user", "prompt").otherwise("stop")
    line = F.to_json(F.struct(F.lit(1).alias("v"), F.lit("2026-01-02T03:04:05Z").alias("t"), F.lit("cursor").alias("h"), event.alias("e"), F.col("conv_id").cast("string").alias("sid"), F.col("text")))
    lines = c.select(F.lit("f").alias("file"), F.col("turn").alias("seq"), line.alias("value")).withColumn("bad", F.try_parse_json("value").isNull())
    numbered = hook_ledger.with_turns(hook_ledger.prepare_events(hook_ledger.parse_events(lines)))
    n = numbered.groupBy("session_key", "turn_index").agg(F.count("*").alias("n_events"))
    return hook_ledger.turns(numbered).join(n, ["session_key", "turn_index"]).select("session_key", "turn_index", "n_events", "status", F.sha1("prompt").alias("prompt_sha1"), F.char_length("final_text").cast("long").alias("final_chars"))


@query("""
WITH g AS (SELECT user_id, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1 AS d, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id),
m AS (SELECT *, cast(floor(d / 60000) AS BIGINT) AS n FROM g)
SELECT user_id, CASE WHEN n < 1 THEN '<1m' WHEN n < 60 THEN n || 'm' WHEN n < 1440 THEN (n // 60) || 'h ' || lpad(cast(n % 60 AS VARCHAR), 2, '0') || 'm' ELSE (n // 1440) || 'd ' || ((n // 60) % 24) || 'h' END AS lasted,
  strftime(a, '%Y-%m') AS month, date_diff('day', cast(a AS DATE), cast(b AS DATE)) AS days FROM m""")
def session_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO times parsed, durations and calendar days shown (261-267)."""
    e = _t(spark, sf_dir, "events").select("user_id", times.parse_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("ms"))
    s = e.groupBy("user_id").agg(F.min("ms").alias("a"), F.max("ms").alias("b"))
    return s.select("user_id", times.format_duration(F.col("b") - F.col("a")).alias("lasted"), times.month_of(times.iso_of(F.col("a"))).alias("month"), times.calendar_days_between(F.col("a"), F.col("b")).cast("long").alias("days"))


@query("""
SELECT page_id, substr(sha256('h:' || url), 1, 8) AS short_id, substr(sha256(url), 1, 16) AS safe_id FROM pages""")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short and file-safe ids (274-277)."""
    return _t(spark, sf_dir, "pages").select("page_id", text.short_id(F.lit("h"), F.col("url")).alias("short_id"), text.safe_sid(F.col("url")).alias("safe_id"))
