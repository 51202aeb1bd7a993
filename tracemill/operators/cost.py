"""Pricing of token usage (rows 36-38, 106-108, 132-136, 169, 269-272, 290, 403, 404).

A price table is a small dated dimension. It is validated and its aliases are
resolved on the driver, where it belongs; usage rows meet it through a plain
join on the model id, which Spark broadcasts by its own size check. Everything
per row is Column arithmetic.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ALIAS_HOPS = 3
#: Prompt-side and output buckets of one attempt.
BUCKETS = ("in_tok", "w5", "w1", "wx", "wu", "rd", "out")
SYNTHETIC = "<synthetic>"


class PriceError(ValueError):
    """A price table that breaks a rule."""


@dataclass(frozen=True)
class Window_:
    """Rates within inclusive dates; USD per million tokens."""

    input: float
    output: float
    cache_read: float | None = None
    cache_write_5m: float | None = None
    cache_write_1h: float | None = None
    valid_from: date | None = None
    valid_until: date | None = None


@dataclass(frozen=True)
class Tier:
    above: int
    input: float
    output: float
    cache_read: float | None = None
    cache_write_5m: float | None = None
    cache_write_1h: float | None = None


@dataclass(frozen=True)
class Clock:
    """Rates at times of day, UTC, `HH:MM-HH:MM`; may wrap midnight."""

    utc: str
    input: float
    output: float
    cache_read: float | None = None


@dataclass(frozen=True)
class Model:
    provider: str = ""
    match: str = "exact"
    alias_of: str | None = None
    rates: Sequence[Window_] = ()
    tiers: Sequence[Tier] = ()
    clocks: Sequence[Clock] = ()
    speeds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    unpriced: str | None = None


@dataclass(frozen=True)
class PriceTable:
    version: str
    models: Mapping[str, Model]
    #: provider -> (cache read, 5-minute write, 1-hour write) as multiples of the input rate; a null read is unknown
    defaults: Mapping[str, tuple[float | None, float, float]] = field(default_factory=dict)


def validate(table: PriceTable) -> PriceTable:
    """Raise for negative rates, dates out of order, unknown matches and broken aliases (290, 404)."""
    for key, m in table.models.items():
        if m.match not in ("exact", "prefix", "regex"):
            raise PriceError(f"{key}: unknown match {m.match}")
        if m.match == "regex":
            re.compile(key)
        if not m.alias_of and not m.unpriced and not m.rates:
            raise PriceError(f"{key}: neither rates nor an alias")
        for w in m.rates:
            if min(w.input, w.output) < 0 or any(x is not None and x < 0 for x in (w.cache_read, w.cache_write_5m, w.cache_write_1h)):
                raise PriceError(f"{key}: negative rate")
            if w.valid_from and w.valid_until and w.valid_from > w.valid_until:
                raise PriceError(f"{key}: window ends before it begins")
        ends = sorted(m.rates, key=lambda w: w.valid_from or date.min)
        for a, b in zip(ends, ends[1:], strict=False):
            if (a.valid_until or date.max) >= (b.valid_from or date.min):
                raise PriceError(f"{key}: windows overlap")
        for c in m.clocks:
            if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d-([01]\d|2[0-3]):[0-5]\d", c.utc):
                raise PriceError(f"{key}: bad time of day {c.utc}")
        if m.alias_of and "$" not in m.alias_of:
            seen, at = [key], m.alias_of
            while True:
                if at in seen:
                    raise PriceError(f"{key}: alias cycle")
                if at not in table.models:
                    raise PriceError(f"{key}: alias of an unknown model {at}")
                seen.append(at)
                if len(seen) - 1 > MAX_ALIAS_HOPS:
                    raise PriceError(f"{key}: alias chain too long")
                nxt = table.models[at].alias_of
                if not nxt:
                    break
                at = nxt
    return table


def overlay(base: PriceTable, over: PriceTable) -> PriceTable:
    """Models of the override replace those of the same key; defaults are replaced by provider (169, 403)."""
    return validate(PriceTable(f"{base.version}+{over.version}", {**base.models, **over.models}, {**base.defaults, **over.defaults}))


def normalize_model(model: str) -> str:
    """Lower case, without a context-size suffix (270)."""
    return re.sub(r"(?:\[1m\]|-1m)$", "", model.strip().lower())


def match_model(model: str, table: PriceTable) -> tuple[str, Model] | None:
    """Exact key, else the longest prefix, else the first regex in table order; then once more without a date suffix; aliases followed (106, 107)."""
    for name in dict.fromkeys([model, re.sub(r"-\d{8}$", "", model)]):
        hit = None
        if name in table.models and table.models[name].match != "regex":
            hit = name, None
        if hit is None:
            prefixes = [k for k, m in table.models.items() if m.match == "prefix" and name.startswith(k)]
            if prefixes:
                hit = max(prefixes, key=len), None
        if hit is None:
            hit = next(((k, x) for k, m in table.models.items() if m.match == "regex" and (x := re.search(k, name))), None)
        if hit is None:
            continue
        key, m = hit[0], table.models[hit[0]]
        for _ in range(MAX_ALIAS_HOPS + 1):
            if not m.alias_of:
                return key, m
            key = hit[1].expand(m.alias_of.replace("$", "\\")) if hit[1] is not None and "$" in m.alias_of else m.alias_of
            if key not in table.models:
                return None
            m = table.models[key]
        return None
    return None


def price_dimension(spark: SparkSession, table: PriceTable, models: Sequence[str]) -> DataFrame:
    """One row per model, window and tier: model, dates, above, the five rates, flags. models: the distinct ids that occur."""
    validate(table)
    rows = []
    for raw in sorted(set(models)):
        hit = match_model(normalize_model(raw), table)
        if hit is None or hit[1].unpriced:
            continue
        m = hit[1]
        read, w5, w1 = table.defaults.get(m.provider, (None, 1.25, 2.0))
        ordered = sorted(m.rates, key=lambda w: w.valid_from or date.min)
        for i, w in enumerate(ordered):
            tiers = [Tier(-1, w.input, w.output, w.cache_read, w.cache_write_5m, w.cache_write_1h), *sorted(m.tiers, key=lambda t: t.above)]
            for j, t in enumerate(tiers):
                below = tiers[j + 1].above if j + 1 < len(tiers) else None
                known = t.cache_read if t.cache_read is not None else (None if read is None else t.input * read)
                rows.append((raw, w.valid_from, w.valid_until, i == 0, t.above, below, float(t.input), float(t.output), None if known is None else float(known), float(t.cache_write_5m if t.cache_write_5m is not None else t.input * w5), float(t.cache_write_1h if t.cache_write_1h is not None else t.input * w1)))
    return spark.createDataFrame(rows, "p_model string, valid_from date, valid_until date, is_first boolean, above long, up_to long, r_in double, r_out double, r_rd double, r_w5 double, r_w1 double")


def clock_rates(table: PriceTable, models: Sequence[str], model: Column, minute: Column, what: str, usual: Column) -> Column:
    """The rate at a time of day, where a model has such windows (269, 272)."""
    out = usual
    for raw in sorted(set(models)):
        hit = match_model(normalize_model(raw), table)
        for c in reversed(hit[1].clocks if hit else ()):
            a, b = (int(x[:2]) * 60 + int(x[3:]) for x in c.utc.split("-"))
            inside = (minute >= a) & (minute < b) if a < b else (minute >= a) | (minute < b)
            value = getattr(c, what)
            if value is not None:
                out = F.when((model == raw) & inside, F.lit(float(value))).otherwise(out)
    return out


def fold_usage_lines(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of the lines that report one message the last completed one, else the one with most output, later ones before earlier (35)."""
    done = F.col("stop_reason").isNotNull()
    order = [done.desc(), F.when(~done, F.col("out")).desc(), F.col("seq").desc()]
    w = Window.partitionBy(*key).orderBy(*order)
    return lines.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def mark_inherited(rows: DataFrame) -> DataFrame:
    """Within a session, the main file's row of a message owns it, else the earliest (137)."""
    own = (F.col("message_id").isNotNull()) & (F.col("message_id") != "")
    w = Window.partitionBy("session_key", "message_id").orderBy(F.col("agent_id").isNotNull(), "seq")
    return rows.withColumn("inherited", own & (F.row_number().over(w) > 1))


def dedupe_across_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """A message that several sessions report belongs to the one that started first (138)."""
    known = rows.join(sessions.select("session_key", "started_at", "session_id", "harness"), "session_key", "left")
    w = Window.partitionBy("message_id").orderBy(F.col("started_at").asc_nulls_last(), "session_id", "harness")
    owner = F.first("session_key").over(w)
    own = F.col("message_id").isNotNull() & (F.col("message_id") != "")
    return known.withColumn("inherited", F.col("inherited") | (own & (owner != F.col("session_key")))).select(*rows.columns)


def price_attempts(attempts: DataFrame, table: PriceTable, models: Sequence[str], as_of: date | None = None) -> DataFrame:
    """Attempts (session_key, model, ts, billed, inherited and the buckets) with usd, unpriced and estimated (132, 271, 272).

    Dated window, then time of day, then size tier by all prompt-side tokens; as_of replaces the day, never the time.
    """
    spark = attempts.sparkSession
    dim = price_dimension(spark, table, models)
    prompt = sum((F.col(b) for b in BUCKETS[:-1]), F.lit(0))
    day = F.lit(as_of).cast("date") if as_of else F.to_date("ts")
    billed = F.col("billed") & ~F.col("inherited") & (F.col("model") != SYNTHETIC)
    rows = attempts.withColumn("_prompt", prompt).withColumn("_day", day).withColumn("_billed", billed)
    in_window = (F.col("valid_from").isNull() | (F.col("_day") >= F.col("valid_from"))) & (F.col("valid_until").isNull() | (F.col("_day") <= F.col("valid_until")))
    early = F.col("is_first") & (F.col("_day").isNull() | (F.col("_day") < F.col("valid_from")))
    tier = (F.col("_prompt") > F.col("above")) & (F.col("up_to").isNull() | (F.col("_prompt") <= F.col("up_to")))
    hit = rows.join(dim, (F.col("model") == F.col("p_model")) & (F.coalesce(in_window, F.lit(False)) | F.coalesce(early, F.lit(False))) & tier, "left")
    minute = F.hour("ts") * 60 + F.minute("ts")
    rate = {w: clock_rates(table, models, F.col("model"), minute, w, F.col(c)) for w, c in (("input", "r_in"), ("output", "r_out"), ("cache_read", "r_rd"))}
    read = F.coalesce(rate["cache_read"], rate["input"])
    usd = (F.col("in_tok") * rate["input"] + (F.col("w5") + F.col("wu")) * F.col("r_w5") + (F.col("w1") + F.col("wx")) * F.col("r_w1") + F.col("rd") * read + F.col("out") * rate["output"]) / 1e6
    return hit.withColumn("usd", F.when(F.col("_billed"), F.coalesce(usd, F.lit(0.0))).otherwise(0.0)).withColumn("unpriced", F.col("_billed") & F.col("p_model").isNull()).withColumn("estimated", F.coalesce(early, F.lit(False)) | (F.col("r_rd").isNull() & F.col("p_model").isNotNull() & (F.col("rd") > 0))).select(*attempts.columns, "usd", "unpriced", "estimated")


def session_cost(priced: DataFrame) -> DataFrame:
    """usd rounded to six places, share of cached prompt tokens, unpriced models (132, 135)."""
    counts = F.col("billed") & ~F.col("inherited")
    prompt = sum((F.col(b) for b in BUCKETS[:-1]), F.lit(0))
    agg = priced.groupBy("session_key").agg(
        F.floor(F.sum("usd") * 1e6 + 0.5).alias("_micro"),
        F.sum(F.when(counts, F.col("rd"))).alias("_rd"),
        F.sum(F.when(counts, prompt)).alias("_prompt"),
        F.array_sort(F.collect_set(F.when(F.col("unpriced"), F.col("model")))).alias("unpriced_models"),
        F.bool_or("estimated").alias("estimated"),
    )
    return agg.select("session_key", (F.col("_micro") / 1e6).alias("usd"), F.when(F.col("_prompt") > 0, 100.0 * F.col("_rd") / F.col("_prompt")).alias("cache_hit_pct"), "unpriced_models", "estimated")


def usage_totals(attempts: DataFrame) -> DataFrame:
    """Billed tokens by session and model (38, 56)."""
    return attempts.where("billed AND NOT inherited").groupBy("session_key", "model").agg(*[F.sum(b).alias(b) for b in BUCKETS])


def delta_usd(d_in: Column, d_cached: Column, d_out: Column, rates: Mapping[str, Column]) -> Column:
    """USD of one delta of running totals, rounded to six places: cached tokens are part of the input (133, 134)."""
    usd = ((d_in - d_cached) * rates["input"] + d_cached * F.coalesce(rates["cache_read"], rates["input"]) + d_out * rates["output"]) / 1e6
    return F.floor(usd * 1e6 + 0.5) / 1e6


def price_deltas(deltas: DataFrame, table: PriceTable, models: Sequence[str]) -> DataFrame:
    """Rows of model, ts, d_in, d_cached, d_out, last_input with their usd; the tier goes by the last input, never by the sum (133)."""
    dim = price_dimension(deltas.sparkSession, table, models)
    day = F.to_date("ts")
    inside = (F.col("valid_from").isNull() | (day >= F.col("valid_from"))) & (F.col("valid_until").isNull() | (day <= F.col("valid_until")))
    early = F.col("is_first") & (day < F.col("valid_from"))
    tier = (F.col("last_input") > F.col("above")) & (F.col("up_to").isNull() | (F.col("last_input") <= F.col("up_to")))
    hit = deltas.join(dim, (F.col("model") == F.col("p_model")) & (F.coalesce(inside, F.lit(False)) | F.coalesce(early, F.lit(False))) & tier, "left")
    rates = {"input": F.col("r_in"), "cache_read": F.col("r_rd"), "output": F.col("r_out")}
    return hit.select(*deltas.columns, F.coalesce(delta_usd(F.col("d_in"), F.col("d_cached"), F.col("d_out"), rates), F.lit(0.0)).alias("usd"))


def format_usd(usd: Column, unverified: Column) -> Column:
    """$1,234.56, with a sign for estimates; a dash where unknown (288)."""
    return F.when(usd.isNull(), F.lit("—")).otherwise(F.concat(F.when(unverified, F.lit("≈")).otherwise(F.lit("")), F.lit("$"), F.format_number(usd, 2)))


def with_rates(m: Model, **changes) -> Model:
    """A model with some fields replaced."""
    return replace(m, **changes)
