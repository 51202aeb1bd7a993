"""Receipts, cards, rate rows and what is published of them (rows 93, 117-131, 139, 156-165, 223, 289, 401).

A turn is done when its receipt has a scored claim or a completion marker. It is
contradicted if any claim is, else unverified if any is or if it has only a
marker, else clean. Sessions that the ledger covers in part are only counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.relational import pivot_counts, violations, weighted_fold

#: Done turns below which a percentage is not shown.
SHOWN_FROM = 10
KINDS = ("test", "test-ran", "test-added", "check", "file", "file-count", "command", "install", "git", "no-change", "verification", "completion")
KEY = ["model", "harness", "harness_version"]


def receipts(judgements: DataFrame) -> DataFrame:
    """One row a turn: counts per verdict, its verdict, whether it is done and by what (125, 260)."""
    counted = judgements.withColumn("v", F.when(F.col("scored"), F.col("verdict")).otherwise(F.lit("NOT_SCORED")))
    per = pivot_counts(counted, ["session_key", "turn_index"], "v", ["CONTRADICTED", "UNVERIFIED", "VERIFIED", "NOT_SCORED"])
    more = judgements.groupBy("session_key", "turn_index").agg(F.count("*").alias("n_claims"), F.count_if("scored").alias("n_scored"), F.bool_or(F.col("kind") == "completion").alias("has_marker"), F.sort_array(F.collect_set(F.when(F.col("verdict") == "CONTRADICTED", F.col("reason")))).alias("contradiction_reasons"))
    out = per.join(more, ["session_key", "turn_index"])
    trigger = F.when(F.col("n_scored") > 0, "claims").when(F.col("has_marker"), "marker-only")
    bucket = F.when(F.col("n_CONTRADICTED") > 0, "contradicted").when((F.col("n_UNVERIFIED") > 0) | (F.col("n_scored") == 0), "unverified").otherwise("clean")
    verdict = F.when(F.col("n_scored") == 0, "NO_CLAIMS").when(F.col("n_CONTRADICTED") > 0, "CONTRADICTED").when(F.col("n_UNVERIFIED") > 0, "UNVERIFIED").otherwise("VERIFIED")
    return out.withColumn("done_by", trigger).withColumn("bucket", F.when(trigger.isNotNull(), bucket)).withColumn("verdict", verdict)


def session_cards(sessions: DataFrame, turns: DataFrame, receipts_: DataFrame, costs: DataFrame) -> DataFrame:
    """One row a session: turns, done turns, claims per verdict, worst verdict, cost (123, 124)."""
    n = turns.groupBy("session_key").agg(F.count("*").alias("turns"))
    r = receipts_.groupBy("session_key").agg(
        F.count_if(F.col("done_by").isNotNull()).alias("done_turns"), *[F.sum(f"n_{v}").alias(f"n_{v}") for v in ("CONTRADICTED", "UNVERIFIED", "VERIFIED", "NOT_SCORED")],
    )
    joined = sessions.join(n, "session_key", "left").join(r, "session_key", "left").join(costs.select("session_key", "usd"), "session_key", "left").fillna(0, ["turns", "done_turns", "n_CONTRADICTED", "n_UNVERIFIED", "n_VERIFIED", "n_NOT_SCORED"])
    verdict = F.when(F.col("n_CONTRADICTED") > 0, "CONTRADICTED").when(F.col("n_UNVERIFIED") > 0, "UNVERIFIED").when(F.col("n_VERIFIED") > 0, "VERIFIED").otherwise("NO_CLAIMS")
    return joined.withColumn("verdict", verdict)


def dominant_model(usage: DataFrame) -> DataFrame:
    """The model with most output tokens of a turn (117)."""
    return usage.groupBy("session_key", "turn_index", "model").agg(F.sum("out").alias("out")).groupBy("session_key", "turn_index").agg(F.max_by("model", F.struct("out", "model")).alias("model"))


def rate_rows(turns: DataFrame, receipts_: DataFrame, sessions: DataFrame, costs: DataFrame | None = None, integrity: DataFrame | None = None, test_runs: DataFrame | None = None) -> DataFrame:
    """Rates per model, tool and version (117, 118).

    turns: session_key, turn_index, model, trigger; sessions: session_key, harness, harness_version, coverage.
    costs: session_key, usd, cached, prompt. Medians are exact and interpolated.
    """
    one = turns.join(sessions.select("session_key", "harness", "harness_version", "coverage"), "session_key").withColumn("model", F.coalesce("model", F.lit("unknown"))).withColumn("harness_version", F.coalesce("harness_version", F.lit("unknown")))
    partial = F.col("coverage") == "partial"
    whole = one.where(~partial).join(receipts_.drop("verdict"), ["session_key", "turn_index"], "left")
    done = F.col("done_by").isNotNull()
    if costs is not None:
        whole = whole.join(costs.select("session_key", "usd", "cached", "prompt"), "session_key", "left")
    else:
        whole = whole.withColumn("usd", F.lit(None).cast("double")).withColumn("cached", F.lit(None).cast("long")).withColumn("prompt", F.lit(None).cast("long"))
    if test_runs is not None:
        whole = whole.join(test_runs.select("session_key", "turn_index").distinct().withColumn("tested", F.lit(True)), ["session_key", "turn_index"], "left")
    else:
        whole = whole.withColumn("tested", F.lit(None).cast("boolean"))
    cost = F.when(done, F.col("usd"))
    per = whole.groupBy(*KEY).agg(
        F.count("*").alias("turns"),
        F.count_if(done).alias("done_turns"),
        F.count_if(F.col("done_by") == "claims").alias("done_by_claims"),
        F.count_if(F.col("done_by") == "marker-only").alias("done_by_marker"),
        F.count_if(done & (F.coalesce(F.col("trigger"), F.lit("human")) == "human")).alias("by_human"),
        F.count_if(done & (F.col("trigger") == "notification")).alias("by_notification"),
        F.count_if(F.col("bucket") == "contradicted").alias("contradicted_turns"),
        F.count_if(F.col("bucket") == "unverified").alias("unverified_turns"),
        F.count_if(F.col("bucket") == "clean").alias("clean_turns"),
        *[F.sum(F.coalesce(f"n_{v}", F.lit(0))).alias(f"claims_{v.lower()}") for v in ("VERIFIED", "UNVERIFIED", "CONTRADICTED", "NOT_SCORED")],
        F.median(cost).alias("median_cost"),
        F.avg(cost).alias("mean_cost"),
        F.when(F.count_if(done) > 0, F.count_if(done & F.coalesce("tested", F.lit(False))) / F.count_if(done)).alias("test_run_rate"),
    )
    # What counts once a session: first one row a session and key.
    per_session = whole.groupBy(*KEY, "session_key").agg(F.first("cached").alias("cached"), F.first("prompt").alias("prompt"))
    if integrity is not None:
        per_session = per_session.join(integrity.groupBy("session_key").agg(F.count("*").alias("signals")), "session_key", "left")
    else:
        per_session = per_session.withColumn("signals", F.lit(0).cast("long"))
    once = per_session.groupBy(*KEY).agg(F.count("*").alias("sessions"), F.sum(F.coalesce("signals", F.lit(0))).alias("integrity_signals"), F.when(F.sum("prompt") > 0, F.lit(100.0) * F.sum("cached") / F.sum("prompt")).alias("cache_hit_pct"))
    left_out = one.where(partial).groupBy(*KEY).agg(F.countDistinct("session_key").alias("ledger_incomplete_sessions"))
    joined = per.join(once, KEY, "left").join(left_out, KEY, "full")
    counts = [c for c, t in joined.dtypes if t == "bigint"]
    return joined.fillna(0, counts)


def shown(rates: DataFrame) -> DataFrame:
    """The rate table: most done turns first, rows without any left out, small shares hidden (158)."""
    share = F.lit(100.0) * F.col("contradicted_turns") / F.col("done_turns")
    text = F.when(F.col("done_turns") >= SHOWN_FROM, F.concat(F.format_number(share, 1), F.lit("%"))).otherwise(F.concat(F.lit("—  ("), F.col("contradicted_turns").cast("string"), F.lit(" of "), F.col("done_turns").cast("string"), F.lit(")")))
    return rates.where("done_turns > 0").withColumn("contradicted_share", text).orderBy(F.desc("done_turns"), *KEY)


def contradiction_reasons(receipts_: DataFrame) -> DataFrame:
    """Turns per reason (117)."""
    return receipts_.select(F.explode("contradiction_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("turns"))


def publish_rows(rates: DataFrame, known_models: Sequence[str]) -> DataFrame:
    """Rows that may be shown to others: models of the built-in table or `other`, plain versions or `unknown`; rows that meet are merged (119).

    Counts add, the test-run rate is weighted by sessions and the median cost by done turns.
    """
    model = F.when(F.col("model").isin(*known_models), F.col("model")).otherwise(F.lit("other"))
    version = F.when(F.rlike("harness_version", F.lit(r"^\d+(?:\.\d+){0,3}$")), F.col("harness_version")).otherwise(F.lit("unknown"))
    named = rates.withColumn("model", model).withColumn("harness_version", version)
    sums = ["sessions", "turns", "done_turns", "contradicted_turns", "unverified_turns", "clean_turns"]
    out = weighted_fold(named, KEY, sums, {"test_run_rate": "sessions", "median_cost": "done_turns"})
    return out.withColumn("test_run_rate", F.round("test_run_rate", 4)).withColumn("median_cost", F.round("median_cost", 4)).orderBy(*KEY)


def merge_boards(rows: DataFrame) -> DataFrame:
    """Rows of several submitters added up, versions cut to their series, submitters counted once (122)."""
    series = F.regexp_replace("harness_version", r"^(\d+\.\d+)\..*$", "$1.x")
    return rows.withColumn("harness_version", series).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("sessions", "turns", "done_turns", "contradicted_turns", "unverified_turns", "clean_turns")], F.countDistinct("submitter").alias("submitters"))


def publish_violations(rows: DataFrame) -> DataFrame:
    """Rules that published rows break (170, 289)."""
    named = rows.withColumn("row_key", F.concat_ws("/", *KEY))
    rules: Mapping = {
        "counts-not-negative": F.least(*[F.col(c) for c in ("sessions", "turns", "done_turns", "contradicted_turns", "unverified_turns", "clean_turns")]) >= 0,
        "done-within-turns": F.col("done_turns") <= F.col("turns"),
        "buckets-add-up": F.col("contradicted_turns") + F.col("unverified_turns") + F.col("clean_turns") == F.col("done_turns"),
        "rate-in-range": F.col("test_run_rate").isNull() | F.col("test_run_rate").between(0, 1),
        "cost-not-negative": F.col("median_cost").isNull() | (F.col("median_cost") >= 0),
        "model-plain": F.rlike("model", F.lit(r"^[a-z0-9][a-z0-9._-]{0,63}$")),
        "version-plain": F.rlike("harness_version", F.lit(r"^(?:unknown|\d+(?:\.\d+){0,3})$")),
        "nothing-like-a-path": ~F.rlike("row_key", F.lit(r"(?i)/(?:home|users|tmp)/|\\|@|://")),
    }
    return violations(named, "row_key", rules)


def evidence_groups(evidence: DataFrame) -> DataFrame:
    """Neighbouring evidence of the same label and agent as one line with first, last and count (140, 141)."""
    w = Window.partitionBy("session_key", "claim_id").orderBy("position")
    change = F.when((F.col("label") == F.lag("label").over(w)) & F.col("agent").eqNullSafe(F.lag("agent").over(w)), 0).otherwise(1)
    run = evidence.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy("session_key", "claim_id", "run", "label", "agent").agg(F.count("*").alias("n"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


def also_did(writes: DataFrame, network: DataFrame, danger: DataFrame, git: DataFrame, claimed_paths: DataFrame, cap: int = 6) -> DataFrame:
    """What a turn did beside its claims: ordered categories, the first `cap`, then how many more (139, 161, 162, 168)."""
    unclaimed = writes.where("status = 'ok' AND NOT metadata_only").select("session_key", "turn_index", "path").distinct().join(claimed_paths.select("session_key", "path").distinct(), ["session_key", "path"], "left_anti")
    files = unclaimed.groupBy("session_key", "turn_index").agg(F.count("*").alias("n"), F.min("path").alias("example")).select("session_key", "turn_index", F.lit(2).alias("ordinal"), F.concat(F.lit("changed "), F.col("n").cast("string"), F.lit(" files it did not name, e.g. "), "example").alias("label"), F.lit(False).alias("warn"))
    dangers = danger.where("tier = 'danger'").groupBy("session_key", "turn_index", "kind").agg(F.count("*").alias("n"), F.min("detail").alias("example")).select("session_key", "turn_index", F.lit(1).alias("ordinal"), F.concat("kind", F.lit(": "), F.substring("example", 1, 80)).alias("label"), F.lit(True).alias("warn"))
    hosts = network.groupBy("session_key", "turn_index", "host").agg(F.count("*").alias("n")).select("session_key", "turn_index", F.lit(4).alias("ordinal"), F.concat(F.lit("reached "), "host").alias("label"), F.lit(False).alias("warn"))
    ops = git.where("op NOT IN ('commit', 'push', 'pr')").groupBy("session_key", "turn_index", "op").agg(F.count("*").alias("n")).select("session_key", "turn_index", F.lit(3).alias("ordinal"), F.concat(F.lit("git "), "op").alias("label"), F.lit(False).alias("warn"))
    every = dangers.unionByName(files).unionByName(ops).unionByName(hosts)
    w = Window.partitionBy("session_key", "turn_index").orderBy("ordinal", "label")
    ranked = every.withColumn("rank", F.row_number().over(w))
    over = ranked.where(F.col("rank") > cap).groupBy("session_key", "turn_index").agg(F.count("*").alias("n"), F.bool_or("warn").alias("warn")).select("session_key", "turn_index", F.lit(cap + 1).alias("rank"), F.concat(F.lit("+"), F.col("n").cast("string"), F.lit(" more")).alias("label"), "warn")
    return ranked.where(F.col("rank") <= cap).select("session_key", "turn_index", "rank", "label", "warn").unionByName(over)


def also_said(judgements: DataFrame, most: int = 3) -> DataFrame:
    """The first claims of a turn that are not scored, by position (160)."""
    w = Window.partitionBy("session_key", "turn_index").orderBy("position", "claim_id")
    return judgements.where("verdict = 'NOT_SCORED'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def confusion(expected: DataFrame, found: DataFrame, match: Sequence[str], rule: str = "rule") -> DataFrame:
    """Per rule, expected claims that were found, found ones that were not expected and the missed (147).

    Claims meet by the columns of `match` (nulls equal), each of a repeated claim once: of e expected and f found
    alike, the smaller number is right. Both sides are counted before they meet, so nothing is multiplied.
    """
    side = lambda df, e, f: df.select(rule, *match, F.lit(e).alias("e"), F.lit(f).alias("f"))
    met = side(expected, 1, 0).unionByName(side(found, 0, 1)).groupBy(rule, *match).agg(F.sum("e").alias("e"), F.sum("f").alias("f"))
    right = F.least("e", "f")
    return met.groupBy(rule).agg(F.sum(right).alias("tp"), F.sum(F.col("f") - right).alias("fp"), F.sum(F.col("e") - right).alias("fn"))
