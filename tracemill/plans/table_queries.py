"""One query per relational operator over the bundled tables, each with its SQL twin.

Counts are cast to long, doubles rounded, and every limit has a unique tiebreak,
so that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import masking, text
from tracemill.operators import relational as R

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
SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_error,
  count(*) FILTER (event_type <> 'error' AND value > 50) AS n_high, count(*) FILTER (event_type <> 'error' AND NOT value > 50) AS n_low,
  CASE WHEN count(*) >= 10 THEN round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 4) END AS pct_error
FROM events GROUP BY user_id""")
def rate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate rows with bucket precedence and a percentage hidden below ten rows (117, 158)."""
    e = _t(spark, sf_dir, "events")
    error, high = F.col("event_type") == "error", F.col("value") > 50
    n = F.count("*")
    return e.groupBy("user_id").agg(n.alias("n_events"), F.count_if(error).alias("n_error"), F.count_if(~error & high).alias("n_high"), F.count_if(~error & ~high).alias("n_low"), F.when(n >= 10, F.round(F.lit(100.0) * F.count_if(error) / n, 4)).alias("pct_error"))


@query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS median_cost, round(avg(l_extendedprice), 4) AS mean_cost, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated median and mean (117, 119)."""
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.median("l_extendedprice"), 4).alias("median_cost"), F.round(F.avg("l_extendedprice"), 4).alias("mean_cost"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT user_id, event_id, cast(floor(value) AS BIGINT) AS total FROM events),
d AS (SELECT *, lag(total) OVER w AS before, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT user_id, event_id, total FROM d WHERE rn = 1 OR total IS DISTINCT FROM before),
x AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM k)
SELECT user_id, event_id, total, coalesce(total < prev, false) AS is_reset, CASE WHEN coalesce(total < prev, false) THEN total ELSE total - coalesce(prev, 0) END AS delta_total FROM x""")
def delta_of_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of a running counter with repeats and resets (55)."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("total"))
    return R.delta_of_totals(e, ["user_id"], ["event_id"], ["total"])


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS inherited FROM documents")
def owner_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a text owns it, the others inherit (137)."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return R.mark_owner(d, ["h"], ["doc_id"]).select("doc_id", "inherited")


@query("""
SELECT o_orderkey, o_orderkey <> first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS inherited FROM orders""")
def owner_across_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest of a group owns what the group shares (138)."""
    o = _t(spark, sf_dir, "orders")
    return R.mark_owner(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "inherited")


@query("""
SELECT c.event_id, c.user_id, (SELECT arg_max(v.event_id, (epoch_us(v.ts), v.event_id)) FROM events v WHERE v.event_type = 'view' AND v.user_id = c.user_id AND (v.ts < c.ts OR (v.ts = c.ts AND v.event_id <= c.event_id))) AS prev_view_id
FROM events c WHERE c.event_type = 'click'""")
def as_of_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's last view before it (104)."""
    e = _t(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("event_id").alias("view_id"))
    return R.as_of_backward(clicks, views, ["user_id"], ["ts", "event_id"], ["ts", "event_id"], ["view_id"]).select("event_id", "user_id", "prev_view_id")


@query("""
SELECT c.event_id, c.user_id, coalesce(
  (SELECT arg_max(v.event_id, (epoch_us(v.ts), v.event_id)) FROM events v WHERE v.event_type = 'purchase' AND v.user_id = c.user_id AND (v.ts < c.ts OR (v.ts = c.ts AND v.event_id <= c.event_id))),
  (SELECT arg_min(v.event_id, (epoch_us(v.ts), v.event_id)) FROM events v WHERE v.event_type = 'purchase' AND v.user_id = c.user_id AND (v.ts > c.ts OR (v.ts = c.ts AND v.event_id > c.event_id)))) AS near_purchase_id
FROM events c WHERE c.event_type = 'error'""")
def as_of_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the user's last purchase before it, else the first after it (105)."""
    e = _t(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("event_id").alias("purchase_id"))
    return R.as_of_nearest(errors, buys, ["user_id"], ["ts", "event_id"], ["ts", "event_id"], ["purchase_id"]).select("event_id", "user_id", "near_purchase_id")


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS envelope FROM events")
def running_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running maximum (43, 44)."""
    return R.running_max(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", "envelope").select("event_id", "user_id", "envelope")


@query("SELECT event_id, user_id, cast(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS turn_index FROM events")
def trigger_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a trigger opens (26)."""
    return R.sessionize(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "user_id", "turn_index")


@query("""
WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS ti FROM conversations)
SELECT conv_id, cast(ti AS BIGINT) AS turn_index, count(*) AS n_rows, min(turn) AS seq_start, max(turn) AS seq_end, arg_max(turn, turn) FILTER (role = 'assistant') AS final_seq, arg_max(length(text), turn) FILTER (role = 'assistant') AS final_chars
FROM t WHERE ti >= 0 GROUP BY conv_id, ti""")
def assemble_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rows open turns; the last assistant row of a turn is its final message (26, 27, 48)."""
    c = R.sessionize(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    said = F.col("role") == "assistant"
    return c.where("turn_index >= 0").groupBy("conv_id", "turn_index").agg(F.count("*").alias("n_rows"), F.min("turn").alias("seq_start"), F.max("turn").alias("seq_end"), F.max(F.when(said, F.col("turn"))).alias("final_seq"), F.max_by(F.char_length("text").cast("long"), F.when(said, F.col("turn"))).alias("final_chars"))


_WINDOWS = [("R", None, "1994-12-31", 1.0), ("R", "1995-01-01", None, 2.0), ("A", "1995-06-01", "1996-12-31", 3.0), ("A", "1997-01-01", None, 4.0), ("N", None, None, 0.5)]


@query("""
WITH w(flag, valid_from, valid_until, rate) AS (VALUES ('R', NULL::DATE, DATE '1994-12-31', 1.0::DOUBLE), ('R', DATE '1995-01-01', NULL, 2.0), ('A', DATE '1995-06-01', DATE '1996-12-31', 3.0), ('A', DATE '1997-01-01', NULL, 4.0), ('N', NULL, NULL, 0.5)),
f AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY valid_from NULLS FIRST) = 1 AS is_first FROM w),
l AS (SELECT l_returnflag, l_quantity, cast(l_shipdate AS DATE) AS day FROM lineitem)
SELECT l_returnflag, rate, coalesce(is_first AND day < valid_from, false) AS is_estimate, count(*) AS n, round(sum(l_quantity * rate), 4) AS cost
FROM l LEFT JOIN f ON l.l_returnflag = f.flag AND (((valid_from IS NULL OR day >= valid_from) AND (valid_until IS NULL OR day <= valid_until)) OR (is_first AND day < valid_from))
GROUP BY ALL""")
def dated_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by dated windows, before the first window the earliest as an estimate (108)."""
    windows = spark.createDataFrame(_WINDOWS, "flag string, f string, u string, rate double").select("flag", F.to_date("f").alias("valid_from"), F.to_date("u").alias("valid_until"), "rate")
    li = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.to_date("l_shipdate").alias("day"))
    priced = R.dated_window(li, windows, "day", {"l_returnflag": "flag"})
    return priced.groupBy("l_returnflag", "rate", "is_estimate").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("rate")), 4).alias("cost"))


@query("""
SELECT l_linenumber, rate, count(*) AS n, round(sum(l_quantity * rate), 4) AS cost
FROM (SELECT *, cast(CASE WHEN l_quantity > 40 THEN 0.5 WHEN l_quantity > 20 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS rate FROM lineitem) GROUP BY ALL""")
def tier_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of the highest tier exceeded (272)."""
    li = _t(spark, sf_dir, "lineitem").withColumn("rate", R.tiered(F.col("l_quantity"), [(20, 0.75), (40, 0.5)], 1.0))
    return li.groupBy("l_linenumber", "rate").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("rate")), 4).alias("cost"))


@query("""
WITH k(key, kind) AS (VALUES ('STANDARD POLISHED TIN', 'exact'), ('STANDARD', 'prefix'), ('PROMO', 'prefix'), ('ECONOMY', 'prefix'), ('ECONOMY BRUSHED', 'prefix'), ('SMALL', 'prefix'))
SELECT p_partkey, coalesce((SELECT key FROM k WHERE key = p_type), (SELECT arg_max(key, length(key)) FROM k WHERE starts_with(p_type, key)), 'other') AS matched FROM part""")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact key, else the longest prefix, else a default (106)."""
    keys = ["STANDARD POLISHED TIN", "STANDARD", "PROMO", "ECONOMY", "ECONOMY BRUSHED", "SMALL"]
    return _t(spark, sf_dir, "part").select("p_partkey", R.prefix_match(F.col("p_type"), keys, "other").alias("matched"))


@query("""
SELECT l_orderkey, count(*) AS n_attempts, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS cost, bool_or(l_discount = 0) AS has_full_price FROM lineitem GROUP BY l_orderkey""")
def attempt_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts nested in a row, exploded and priced (36, 132)."""
    li = _t(spark, sf_dir, "lineitem")
    nested = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_extendedprice", "l_discount", "l_tax")).alias("attempts"))
    zero = F.lit(0.0)
    cost = F.aggregate("attempts", zero, lambda acc, a: acc + a["l_extendedprice"] * (1 - a["l_discount"]) * (1 + a["l_tax"]))
    return nested.select("l_orderkey", F.size("attempts").cast("long").alias("n_attempts"), F.round(cost, 6).alias("cost"), F.exists("attempts", lambda a: a["l_discount"] == 0).alias("has_full_price"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, rank, cast(o_orderkey AS VARCHAR) AS label FROM r WHERE rank <= 6
UNION ALL SELECT o_custkey, 7 AS rank, '+' || count(*) || ' more' AS label FROM r WHERE rank > 6 GROUP BY o_custkey""")
def top_with_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six of a key and a line that counts the rest (161, 162)."""
    return R.top_with_rest(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 6, "o_orderkey")


@query("""
SELECT user_id, arg_min(event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END) AS worst, count(DISTINCT event_type) AS n_kinds FROM events GROUP BY user_id""")
def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of ranked verdicts (124, 159, 260)."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", rank).alias("worst"), F.countDistinct("event_type").alias("n_kinds"))


@query("""
WITH c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS change FROM events),
i AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT user_id, cast(island AS BIGINT) AS island, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM i GROUP BY ALL""")
def run_length_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal labels merged (141)."""
    i = R.islands(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return i.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""
WITH p AS (SELECT user_id, event_id, ts, value, lag(value) OVER w AS prev_value, lag(ts) OVER w AS prev_ts FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(prev_value - value, 6) AS dropped FROM p WHERE value < prev_value AND EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = p.user_id AND e.ts > p.prev_ts AND e.ts < p.ts)""")
def drop_with_event_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drop between two runs with another event in between (112, 150): the latest such event so far, not a range join."""
    e = _t(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "side", "event_id")
    both = e.where("event_type IN ('purchase', 'error')").withColumn("side", F.when(F.col("event_type") == "error", 1).otherwise(0))
    # Errors at the same instant as a run sort after it, so the last error before a run is strictly earlier.
    last_error = F.last(F.when(F.col("side") == 1, F.col("ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = both.withColumn("last_error", last_error).where("side = 0")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = runs.withColumn("prev_value", F.lag("value").over(own)).withColumn("prev_ts", F.lag("ts").over(own))
    return runs.where((F.col("value") < F.col("prev_value")) & (F.col("last_error") > F.col("prev_ts"))).select("user_id", "event_id", F.round(F.col("prev_value") - F.col("value"), 6).alias("dropped"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference by key (168)."""
    li = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate)")
def semi_join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality and range in a semi join (110, 113)."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")), "left_semi").select("o_orderkey")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS ended FROM orders)
SELECT o_orderkey, cast(ended AS VARCHAR) AS ended FROM o WHERE ended IS NULL OR (ended >= TIMESTAMP '1995-01-01' AND ended < TIMESTAMP '1997-01-01')""")
def since_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time bounds that keep rows without a time (83, 84)."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("ended"))
    kept = R.since_until(o, "ended", F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz"))
    return kept.select("o_orderkey", F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"))


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m-%d') AS prev_start, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_start, count(*) AS n FROM orders GROUP BY ALL""")
def month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months and their neighbours (121, 265)."""
    month = F.trunc("o_orderdate", "month")
    o = _t(spark, sf_dir, "orders").select(F.date_format(month, "yyyy-MM").alias("month"), F.date_format(F.add_months(month, -1), "yyyy-MM-dd").alias("prev_start"), F.date_format(F.add_months(month, 1), "yyyy-MM-dd").alias("next_start"))
    return o.groupBy("month", "prev_start", "next_start").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT event_type, user_id, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY event_type, user_id)
SELECT event_type, cast(sum(n) AS BIGINT) AS n, round(sum(mean_value * n) / sum(n), 6) AS mean_value FROM a GROUP BY event_type""")
def weighted_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates folded again with weights (119, 122)."""
    first = _t(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return R.weighted_fold(first, ["event_type"], ["n"], {"mean_value": "n"}).select("event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("SELECT event_type, 'k' AS key, cast(sum(cast(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counts merged by key (128)."""
    e = _t(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    return R.merge_counters(e, ["event_type"], F.col("m"))


@query("""
WITH s AS (SELECT c_custkey, substr(sha256(c_name), 1, 3) AS short_id, c_name FROM customer)
SELECT c_custkey, short_id, (count(DISTINCT c_name) OVER (PARTITION BY short_id)) > 1 AS collides FROM s""")
def short_id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids that stand for several things (148, 274)."""
    s = _t(spark, sf_dir, "customer").select("c_custkey", F.substring(F.sha2("c_name", 256), 1, 3).alias("short_id"), "c_name")
    return R.collisions(s, "short_id", "c_name").select("c_custkey", "short_id", "collides")


@query("""
WITH u AS (SELECT DISTINCT sha1(lower(trim(text))) AS h FROM conversations WHERE role = 'user')
SELECT conv_id, turn, sha1(lower(trim(text))) IN (SELECT h FROM u) AS echoed FROM conversations WHERE role = 'assistant'""")
def echo_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that repeat what was asked, by hash (115, 218)."""
    c = _t(spark, sf_dir, "conversations").withColumn("h", F.sha1(F.lower(F.trim("text"))))
    asked = c.where("role = 'user'").select("h", F.lit(True).alias("hit")).distinct()
    return c.where("role = 'assistant'").join(asked, "h", "left").select("conv_id", "turn", F.coalesce("hit", F.lit(False)).alias("echoed"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), 'AKIA[0-9A-Z]{16}', '[KEY]', 'g')) AS masked_md5,
  regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|AKIA[0-9A-Z]{16}') AS had_any FROM documents""")
def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking by whole matches (278)."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(masking.mask_contacts(F.col("text"))).alias("masked_md5"), F.rlike("text", F.lit(masking.CONTACTS)).alias("had_any"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '\b[Tt]he\b')) AS n_the, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers, len(string_split(text, chr(10))) AS n_lines FROM documents""")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of trigger patterns (219, 221)."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(r"\b[Tt]he\b")).cast("long").alias("n_the"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("n_numbers"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query(r"""
SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, count(*) AS n, count(DISTINCT url) AS n_urls FROM pages
WHERE NOT regexp_matches(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '^(localhost|127\.|10\.|192\.168\.|169\.254\.)|\.local$') GROUP BY 1""")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of URLs, private ones left out (204, 205, 393)."""
    p = _t(spark, sf_dir, "pages").select("url", text.host_of(F.col("url")).alias("host"))
    return p.where(~text.is_private_host(F.col("host"))).groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


@query("SELECT o_custkey, date_diff('day', min(cast(o_orderdate AS DATE)), max(cast(o_orderdate AS DATE))) AS days, count(*) AS n FROM orders GROUP BY o_custkey")
def calendar_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar days between the first and the last row (266)."""
    day = F.to_date("o_orderdate")
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.datediff(F.max(day), F.min(day)).cast("long").alias("days"), F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) FILTER (hour(ts) * 60 + minute(ts) >= 1350 OR hour(ts) * 60 + minute(ts) < 390) AS n_night, count(*) FILTER (hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) < 1020) AS n_day FROM events GROUP BY event_type""")
def clock_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day, over midnight too (269)."""
    night, day = R.in_clock_window(F.col("ts"), "22:30", "06:30"), R.in_clock_window(F.col("ts"), "09:00", "17:00")
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(night).alias("n_night"), F.count_if(day).alias("n_day"))


@query("""
WITH o(n_nationkey, n_name, n_regionkey) AS (VALUES (3, 'OVERRIDDEN', 9), (100, 'ADDED', 9))
SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM o) UNION ALL SELECT * FROM o""")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension with overriding rows (169, 403)."""
    base = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return R.overlay(base, spark.createDataFrame([(3, "OVERRIDDEN", 9), (100, "ADDED", 9)], "n_nationkey int, n_name string, n_regionkey int"), "n_nationkey")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY user_id""")
def verdict_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per verdict, zeros filled (125)."""
    return R.pivot_counts(_t(spark, sf_dir, "events"), ["user_id"], "event_type", ["signup", "view", "click", "purchase", "error"])


@query("""
SELECT doc_id, 'short' AS rule FROM documents WHERE NOT n_chars >= 200 UNION ALL SELECT doc_id, 'language' FROM documents WHERE NOT coalesce(lang IN ('en', 'de'), false)
UNION ALL SELECT doc_id, 'length' FROM documents WHERE NOT coalesce(n_chars = length(text), false)""")
def validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break rules, a row per rule (289)."""
    d = _t(spark, sf_dir, "documents")
    return R.violations(d, "doc_id", {"short": F.col("n_chars") >= 200, "language": F.col("lang").isin("en", "de"), "length": F.col("n_chars") == F.char_length("text")})


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def latest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table: newest first, twenty rows (156, 157)."""
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def priced_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered, priced summary: the shape of the scanned summary (129, 132)."""
    li = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""
SELECT r_name, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name""")
def joined_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed lookups through several tables (101, 102, 103)."""
    t = lambda n: _t(spark, sf_dir, n)
    where = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "c_custkey")
    # One row an order first, so that the count of orders needs no distinct.
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = t("orders").select("o_orderkey", "o_custkey").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.join(where, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("v"), 4).alias("revenue"))
