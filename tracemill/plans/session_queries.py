"""Queries of the timeline, selection and patch operators over the bundled tables, each with its SQL twin.

An event is a call of its user's session, an order a turn of its customer's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import masking, text
from tracemill.operators import patches, rates, selection, timeline
from tracemill.sources import messages

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


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("session_key"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("int").alias("turn_index"), "event_type", "value")


@query("""
WITH c AS (SELECT user_id, event_id, event_id % 3 AS ti, event_type, value, 'a' || (event_id % 2) AS agent_id, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id, event_id % 3) AS f FROM events)
SELECT user_id AS session_key, cast(ti AS INT) AS turn_index, agent_id, count(*) AS tool_calls, count(DISTINCT floor(value)) FILTER (event_type = 'click' AND value > 20) AS files, count(*) FILTER (event_type = 'purchase') AS test_runs
FROM c WHERE event_id > f GROUP BY ALL""")
def post_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each agent did after a turn's final message (47, 90, 91, 127)."""
    c = _calls(spark, sf_dir).withColumn("agent_id", F.concat(F.lit("a"), (F.col("seq") % 2).cast("string")))
    turns = c.groupBy("session_key", "turn_index").agg(F.max(F.when(F.col("event_type") == "view", F.col("seq"))).alias("final_seq"))
    writes = c.where("event_type = 'click'").select("session_key", "seq", F.floor("value").cast("string").alias("path"), F.when(F.col("value") > 20, "ok").otherwise("failed").alias("status"), F.lit(False).alias("metadata_only"))
    return timeline.post_final_groups(timeline.mark_post_final(c, turns), writes, c.where("event_type = 'purchase'"))


@query("""
SELECT user_id AS session_key, event_id AS seq, cast(event_id % 3 AS INT) AS turn_index, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS position,
  concat_ws(',', CASE WHEN event_type = 'purchase' AND value > 50 THEN 'test' END, CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'git' END,
    CASE WHEN event_type = 'click' OR (event_type = 'purchase' AND value < 10) THEN 'write' END, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'danger' END,
    CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND event_id % 2 = 1) THEN 'error' END, CASE WHEN event_id % 11 = 0 THEN 'background' END) AS flags,
  CASE event_type WHEN 'purchase' THEN 'run ' || event_id WHEN 'error' THEN 'Bash' WHEN 'click' THEN 'f' || event_id WHEN 'view' THEN 'u' || event_id ELSE 'about ' || event_id END AS summary,
  round(coalesce((SELECT arg_max(u.value, u.event_id) FROM events u WHERE u.event_type = 'signup' AND u.user_id = e.user_id AND u.event_id <= e.event_id),
    (SELECT arg_min(u.value, u.event_id) FROM events u WHERE u.event_type = 'signup' AND u.user_id = e.user_id AND u.event_id > e.event_id)), 6) AS usd
FROM events e""")
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with position, summary, flags and nearest cost (105, 154, 399, 400)."""
    c = _calls(spark, sf_dir)
    kind, seq = F.col("event_type"), F.col("seq")
    named = lambda k, prefix: F.when(kind == k, F.concat(F.lit(prefix), seq.cast("string")))
    calls = c.select(
        "session_key", "seq", "turn_index", F.when(kind.isin("purchase", "error"), "shell").when(kind == "click", "edit").when(kind == "view", "fetch").otherwise("other").alias("kind"), named("purchase", "run ").alias("command"), named("click", "f").alias("path"), named("view", "u").alias("url"), named("signup", "about ").alias("description"),
        F.lit("Bash").alias("tool"), F.when(kind == "purchase", seq % 2).alias("exit"), (kind == "error").alias("is_error"), (seq % 11 == 0).alias("background"),
    )
    facts = {"test": c.where("event_type = 'purchase' AND value > 50"), "git": c.where("event_type = 'view' AND seq % 5 = 0"), "write": c.where("event_type = 'purchase' AND value < 10"), "danger": c.where("event_type = 'error' AND seq % 3 = 0")}
    usage = c.where("event_type = 'signup'").select("session_key", "seq", F.col("value").alias("usd"))
    built = timeline.build(calls, usage, facts)
    return built.select("session_key", "seq", "turn_index", "position", F.array_join("flags", ",").alias("flags"), "summary", F.round("usd", 6).alias("usd"))


@query("""
WITH r AS (SELECT user_id, event_id, event_type = 'error' OR row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, event_id DESC) <= 5 AS keep FROM events),
b AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS band FROM r)
SELECT user_id AS session_key, event_id AS seq, 0 AS hidden FROM b WHERE keep UNION ALL SELECT user_id, min(event_id), count(*) FROM b WHERE NOT keep GROUP BY user_id, band""")
def capped_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five calls a session, errors always, hidden runs counted (75, 76)."""
    return timeline.cap(_calls(spark, sf_dir), ["session_key"], F.col("event_type") == "error", 5).select("session_key", "seq", "hidden")


@query("""
WITH s AS (SELECT c_custkey AS k, md5(c_name) AS id FROM customer), q AS (SELECT DISTINCT upper(substr(id, 1, cast(k % 7 AS INT) + 1)) AS selector FROM s UNION SELECT 'log-' || k FROM s WHERE k % 5 = 0 UNION SELECT id FROM s WHERE k % 3 = 0),
h AS (SELECT selector, count(DISTINCT k) FILTER (id = lower(selector)) AS ne, min(k) FILTER (id = lower(selector)) AS e, count(DISTINCT k) AS na, min(k) AS a FROM q LEFT JOIN s ON starts_with(id, lower(selector)) OR starts_with('log-' || k, lower(selector)) GROUP BY selector)
SELECT selector, CASE WHEN ne = 1 THEN 'found' WHEN ne > 1 THEN 'ambiguous' WHEN length(selector) < 4 THEN 'too-short' WHEN na = 0 THEN 'not-found' WHEN na = 1 THEN 'found' ELSE 'ambiguous' END AS status,
  CASE WHEN ne = 1 THEN e WHEN ne = 0 AND length(selector) >= 4 AND na = 1 THEN a END AS session_key FROM h""")
def resolved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed ids to sessions (95)."""
    k = F.col("session_key")
    s = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_key"), F.md5("c_name").alias("session_id")).withColumn("short_id", F.substring("session_id", 1, 8)).withColumn("file", F.concat(F.lit("log-"), k.cast("string")))
    typed = s.select(F.upper(F.substring(F.col("session_id"), F.lit(1), (k % 7).cast("int") + 1)).alias("selector")).union(s.where(k % 5 == 0).select("file")).union(s.where(k % 3 == 0).select("session_id"))
    return selection.resolve_ids(s, typed)


@query("""
SELECT o_custkey AS session_key, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), max(o_orderkey)) AS turn_index FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_custkey""")
def selected_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that ended in a span of time, one a session: the last done, else the last (87, 96)."""
    turns = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_key"), F.col("o_orderkey").alias("turn_index"), F.col("o_orderdate").alias("ended"), (F.col("o_orderstatus") == "F").alias("is_done"))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return selection.select_turns(selection.ended_in(turns, day("1995-01-01"), day("1997-01-01"), "ended"))


@query("""
SELECT o_custkey AS session_key, epoch_ms(max(o_orderdate)) AS ended_ms FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F') ORDER BY 2 DESC, 1 LIMIT 1""")
def latest_done_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest session with a done turn (94)."""
    o = _t(spark, sf_dir, "orders")
    sessions = o.groupBy(F.col("o_custkey").alias("session_key")).agg(F.unix_millis(F.max("o_orderdate").cast("timestamp")).alias("ended_ms"))
    return selection.latest_done(sessions, o.select(F.col("o_custkey").alias("session_key"), (F.col("o_orderstatus") == "F").alias("is_done")))


@query("SELECT s_suppkey AS session_key FROM supplier WHERE s_suppkey % 3 < 2 AND contains('/root/p' || s_nationkey || '/x', '/root/p1')")
def project_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a project and of some tools (85, 86)."""
    folder = F.concat(F.lit("/root/p"), F.col("s_nationkey").cast("string"), F.lit("/x"))
    tool = F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("s_suppkey") % 3).cast("int"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_key"), F.array(F.lit("/srv"), folder).alias("cwds"), tool.alias("harness"))
    return selection.by_harness(selection.by_project(s, " ~/p1 "), ["a", "b"]).select("session_key")


@query("""
WITH w AS (SELECT doc_id, string_split(replace(text, ' ', chr(10)), chr(10)) AS o, string_split(replace(replace(text, ' the ', ' a new '), ' ', chr(10)), chr(10)) AS n FROM documents),
p AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(o), len(n)) + 1), lambda i: o[i] IS NOT DISTINCT FROM n[i]), false), 0) - 1, len(o)) AS k FROM w WHERE o <> n),
r AS (SELECT *, list_reverse(o[k + 1:]) AS ro, list_reverse(n[k + 1:]) AS rn FROM p),
s AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(ro), len(rn)) + 1), lambda i: ro[i] IS NOT DISTINCT FROM rn[i]), false), 0) - 1, len(ro)) AS t FROM r)
SELECT doc_id, least(len(n) - k - t, 2000) AS n_added, greatest(least(len(o) - k - t, 2000 - (len(n) - k - t)), 0) AS n_removed, md5(array_to_string(n[k + 1:least(len(n) - t, k + 2000)], '|')) AS added_md5 FROM s""")
def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines between two versions of a text (32)."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("o"), F.replace(F.replace("text", F.lit(" the "), F.lit(" a new ")), F.lit(" "), F.lit("\n")).alias("n"))
    p = d.select("doc_id", patches.line_diff(F.col("o"), F.col("n")).alias("p")).where("p IS NOT NULL")
    return p.select("doc_id", F.size("p.added").cast("long").alias("n_added"), F.size("p.removed").cast("long").alias("n_removed"), F.md5(F.array_join("p.added", "|")).alias("added_md5"))


@query("""
SELECT o_orderkey, list_sort(list(cast(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'R')) IS NULL AS none_added, count(*) FILTER (l_returnflag = 'R') AS n_added, count(*) FILTER (l_returnflag = 'A') AS n_removed,
  cast(coalesce(sum(l_partkey) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS added_sum FROM (SELECT l_orderkey AS o_orderkey, * FROM lineitem) GROUP BY o_orderkey""")
def structured_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of hunks (31)."""
    sign = F.when(F.col("l_returnflag") == "R", "+").when(F.col("l_returnflag") == "A", "-").otherwise(" ")
    hunks = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.collect_list(F.struct(F.array(F.lit(" same"), F.concat(sign, F.col("l_partkey").cast("string"))).alias("lines")))).alias("j"))
    p = hunks.select("o_orderkey", patches.structured_patch(F.col("j")).alias("p"))
    total = F.aggregate("p.added", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return p.select("o_orderkey", (F.size("p.added") == 0).alias("none_added"), F.size("p.added").cast("long").alias("n_added"), F.size("p.removed").cast("long").alias("n_removed"), total.alias("added_sum"))


@query("""
WITH m AS (SELECT conv_id, turn, conv_id % 3 AS c, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, md5(substr(t, 1, 8192)) AS text_md5, length(t) > 8192 AS truncated FROM (SELECT conv_id, turn, CASE c WHEN 0 THEN text WHEN 1 THEN text || chr(10) || text ELSE 'plain' END AS t FROM m)""")
def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results as text, from strings, blocks and neither (33)."""
    c = _t(spark, sf_dir, "conversations").where("text IS NOT NULL")
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    array = F.to_json(F.array(block, F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), block))
    string = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    result = F.when(F.col("conv_id") % 3 == 0, string).when(F.col("conv_id") % 3 == 1, array).otherwise(F.lit('{"a": 1}'))
    r = c.select("conv_id", "turn", patches.result_text(result, F.lit("plain")).alias("r"))
    return r.select("conv_id", "turn", F.md5("r.text").alias("text_md5"), F.col("r.truncated").alias("truncated"))


@query("""
WITH k AS (SELECT p_partkey, '/home/u/' || p_size || '/f' || p_partkey || '.py' AS far FROM part)
SELECT p_partkey, 'see p:' || substr(sha256('salt' || chr(0) || far), 1, 8) || '/f' || p_partkey || '.py and src/' || p_partkey || '/, ' || '. but not a/b or http://h/p' AS hidden FROM k""")
def hashed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths within texts, relative or hashed (280)."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    said = F.concat(F.lit("see /home/u/"), size, F.lit("/f"), n, F.lit(".py and /w/src/"), n, F.lit("/, /w but not a/b or http://h/p"))
    return _t(spark, sf_dir, "part").select("p_partkey", patches.hash_paths(said, "salt", F.lit("/w/")).alias("hidden"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS e, count(*) FILTER (event_id % 2 = 1) AS f FROM events GROUP BY ALL)
SELECT event_type AS rule, cast(sum(least(e, f)) AS BIGINT) AS tp, cast(sum(f - least(e, f)) AS BIGINT) AS fp, cast(sum(e - least(e, f)) AS BIGINT) AS fn FROM c GROUP BY 1""")
def rule_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and found claims per rule (147)."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("rule"))
    return rates.confusion(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"])


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rank FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_custkey AS session_key, o_orderkey AS claim_id, rank FROM r WHERE rank <= 3""")
def also_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three claims of a turn that are not scored (160)."""
    verdict = F.when(F.col("o_orderpriority") == "1-URGENT", "NOT_SCORED").otherwise("VERIFIED")
    j = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_key"), F.col("o_orderstatus").alias("turn_index"), F.col("o_orderkey").alias("claim_id"), F.col("o_totalprice").alias("position"), verdict.alias("verdict"))
    return rates.also_said(j).select("session_key", "claim_id", "rank")


@query("""SELECT p_partkey, '{"a":{"b":[3,null,"x y"],"c":' || p_size || '},"brand":"' || p_brand || '","z":true}' AS j FROM part""")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with sorted keys (77)."""
    j = F.concat(F.lit('{ "z": true, "brand": "'), "p_brand", F.lit('", "a": {"c": '), F.col("p_size").cast("string"), F.lit(', "b": [3, null, "x y"]} }'))
    return _t(spark, sf_dir, "part").select("p_partkey", text.canonical_json(j).alias("j"))


def _lines(df: DataFrame, key: str, seq: str, record: str) -> DataFrame:
    """Transcript lines as the JSONL scan gives them; the key is the session's id."""
    return df.select(F.concat(F.lit("p/"), F.col(key).cast("string"), F.lit(".jsonl")).alias("file"), F.col(seq).alias("seq"), F.col(record).alias("value"), F.lit(False).alias("bad"), F.lit(False).alias("count_only"))


def _said(kind: str, content: object, **more: object) -> object:
    message = {k: more.pop(k) for k in ("id", "model", "stop_reason", "usage") if k in more}
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(content.alias("content"), *[v.alias(k) for k, v in message.items()]).alias("message"), *[v.alias(k) for k, v in more.items()]))


@query("""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o, sum(CASE WHEN role = 'user' AND trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS ti FROM conversations WHERE role <> 'system' AND text IS NOT NULL)
SELECT 'claude-code:' || conv_id AS session_key, cast(ti AS INT) AS turn_index, min(o) AS seq_start, max(o) AS seq_end, md5(arg_min(text, o) FILTER (role = 'user' AND trim(text) <> '')) AS prompt_md5,
  md5(arg_max(text, o) FILTER (role = 'assistant' AND trim(text) <> '')) AS final_md5, coalesce(max(o) FILTER (role = 'assistant' AND trim(text) <> ''), max(o)) AS final_seq FROM t WHERE ti >= 0 GROUP BY conv_id, ti""")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message lines read and cut into turns (13, 15, 19, 24-27)."""
    c = _t(spark, sf_dir, "conversations").where("role <> 'system' AND text IS NOT NULL")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    line = F.when(F.col("role") == "user", _said("user", block)).otherwise(_said("assistant", block, model=F.lit("m"), stop_reason=F.lit("end_turn")))
    turns = messages.turns(messages.with_turns(messages.records(_lines(c.withColumn("r", line), "conv_id", "turn", "r"))))
    return turns.select("session_key", "turn_index", "seq_start", "seq_end", F.md5("prompt").alias("prompt_md5"), F.md5("final_text").alias("final_md5"), "final_seq")


@query("""
WITH t AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS ti FROM events)
SELECT 'claude-code:' || user_id AS session_key, 'c' || event_id AS tool_call_id, cast(ti AS INT) AS turn_index, CASE WHEN event_type = 'view' THEN 'Agent' ELSE 'Bash' END AS tool,
  cast(CASE WHEN event_id % 7 = 0 THEN event_id % 5 WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN 1 + event_id % 3 ELSE 0 END AS INT) AS exit,
  CASE WHEN event_id % 7 = 0 THEN 'notification' WHEN event_type = 'view' THEN 'unknown' WHEN event_type = 'error' THEN 'content' ELSE 'interpreted' END AS exit_source FROM t WHERE event_type <> 'signup'""")
def transcript_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls met by their results, and by the notifications that bring exits late (18, 20, 29, 30, 39-41)."""
    n, kind = F.col("event_id"), F.col("event_type")
    text_of, late = n.cast("string"), n % 7 == 0
    call = F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), text_of).alias("id"), F.when(kind == "view", "Task").otherwise("Bash").alias("name"), F.struct(F.lit("ls").alias("command")).alias("input")))
    answer = F.when(kind == "error", F.concat(F.lit("Exit code "), (1 + n % 3).cast("string"))).otherwise("fine")
    result = F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("c"), text_of).alias("tool_use_id"), answer.alias("content"), (kind == "error").alias("is_error")))
    note = F.concat(F.lit("<task-notification><task-id>b"), text_of, F.lit("</task-id><status>completed</status> exit code "), (n % 5).cast("string"), F.lit("</task-notification>"))
    own = F.array(_said("assistant", call), _said("user", result, toolUseResult=F.struct(F.when(late, F.concat(F.lit("b"), text_of)).alias("backgroundTaskId"))), F.when(late, _said("user", note)))
    lines = _t(spark, sf_dir, "events").select("user_id", "event_id", F.posexplode(F.array_compact(F.when(kind == "signup", F.array(_said("user", F.lit("go on")))).otherwise(own))).alias("i", "r"))
    numbered = messages.with_turns(messages.records(_lines(lines.withColumn("at", n * 10 + F.col("i")), "user_id", "at", "r")))
    return messages.apply_notifications(messages.tool_calls(numbered), messages.notifications(numbered)).select("session_key", "tool_call_id", "turn_index", "tool", "exit", "exit_source")


@query("""
WITH t AS (SELECT 'claude-code:' || user_id AS session_key, event_type AS e, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)
SELECT session_key, CASE e WHEN 'click' THEN 'edited' WHEN 'purchase' THEN 'pr' WHEN 'view' THEN 'cut' ELSE 'refused' END AS mark, seq, CASE e WHEN 'click' THEN 'f' || n WHEN 'purchase' THEN 'o/r#' || n WHEN 'view' THEN 'auto ' || n || ' 0' ELSE 'big small' END AS detail FROM t WHERE e <> 'signup'""")
def transcript_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines beside the messages: edited files, pull requests, cut contexts, refusals (21-23)."""
    n = F.col("event_id")
    record = lambda **m: F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in m.items()]))
    line = (
        F.when(F.col("event_type") == "click", record(type="attachment", attachment=F.struct(F.lit("edited_text_file").alias("type"), F.concat(F.lit("f"), n.cast("string")).alias("filename"))))
        .when(F.col("event_type") == "purchase", record(type="pr-link", prNumber=n, prUrl="https://h/o/r", prRepository="o/r"))
        .when(F.col("event_type") == "view", record(type="system", subtype="compact_boundary", compactMetadata=F.struct(F.lit("auto").alias("trigger"), n.alias("preTokens"))))
        .when(F.col("event_type") == "error", record(type="system", subtype="model_refusal_fallback", originalModel="big", fallbackModel="small"))
        .otherwise(record(type="system", subtype="turn_duration", durationMs=n))
    )
    numbered = messages.with_turns(messages.records(_lines(_t(spark, sf_dir, "events").withColumn("r", line), "user_id", "event_id", "r")))
    mark = lambda df, name, *parts: df.select("session_key", F.lit(name).alias("mark"), "seq", F.concat(*parts).alias("detail"))
    edited = mark(messages.edited_files(numbered), "edited", "path")
    prs = mark(messages.pr_refs(numbered), "pr", "pr_repository", F.lit("#"), F.col("pr_number").cast("string"))
    cuts = mark(messages.compactions(numbered), "cut", "trigger", F.lit(" "), F.col("pre_tokens").cast("string"), F.lit(" "), F.col("post_tokens").cast("string"))
    refused = mark(messages.refusals(numbered), "refused", "original_model", F.lit(" "), "fallback_model")
    return edited.unionByName(prs).unionByName(cuts).unionByName(refused)


@query("""SELECT c_custkey, 'export API_TOKEN=[masked] then [masked] for ' || c_name AS masked FROM customer""")
def masked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials masked, assigned ones after their name (278)."""
    h = F.md5("c_name")
    said = F.concat(F.lit("export API_TOKEN="), h, F.lit(" then AKIA"), F.upper(F.substring(h, 1, 16)), F.lit(" for "), "c_name")
    return _t(spark, sf_dir, "customer").select("c_custkey", masking.mask_secrets(said).alias("masked"))
