"""Relational building blocks of the log engine, as DataFrame compositions.

Every function declares a plan; none collects. Windows partition by the
session (or whatever key is given), so one shuffle serves each. The numbers in
the docstrings are the rows of SURVEY section 2 that an operator covers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], carry: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Rows of left with the carried columns of the last right row at or before them (104, 105).

    One union and one window instead of a range join: linear in the rows. left_order and right_order name
    columns of equal types; a right row that ties comes first.
    """
    n = len(left_order)
    orders = [f"_o{i}" for i in range(n)]
    payload = F.struct(*[F.col(c) for c in carry])
    one = left.select("*", *[F.col(c).alias(o) for c, o in zip(left_order, orders, strict=True)], F.lit(1).alias("_side"))
    two = right.select(*by, *[F.col(c).alias(o) for c, o in zip(right_order, orders, strict=True)], F.lit(0).alias("_side"), payload.alias("_payload"))
    both = one.unionByName(two, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(*orders, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_payload", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select(*left.columns, *[F.col(f"_seen.{c}").alias(prefix + c) for c in carry])


def as_of_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], carry: Sequence[str], prefix: str = "near_") -> DataFrame:
    """The last right row at or before a left row, else the first after it (105)."""
    orders = [f"_o{i}" for i in range(len(left_order))]
    payload = F.struct(*[F.col(c) for c in carry])
    one = left.select("*", *[F.col(c).alias(o) for c, o in zip(left_order, orders, strict=True)], F.lit(1).alias("_side"))
    two = right.select(*by, *[F.col(c).alias(o) for c, o in zip(right_order, orders, strict=True)], F.lit(0).alias("_side"), payload.alias("_payload"))
    both = one.unionByName(two, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(*orders, "_side")
    back = F.last("_payload", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("_payload", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    seen = both.withColumn("_seen", F.coalesce(back, ahead)).where("_side = 1")
    return seen.select(*left.columns, *[F.col(f"_seen.{c}").alias(prefix + c) for c in carry])


def delta_of_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Deltas of running totals: an exact repeat gives no row, any decrease starts again from zero (55)."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for c in totals:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    kept = df.withColumn("_repeat", same & ~first).where(~F.col("_repeat")).drop("_repeat")
    back = F.lit(False)
    for c in totals:
        back = back | F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False))
    kept = kept.withColumn("is_reset", back)
    for c in totals:
        base = F.when(F.col("is_reset"), F.lit(0)).otherwise(F.coalesce(F.lag(c).over(w), F.lit(0)))
        kept = kept.withColumn(f"delta_{c}", F.col(c) - base)
    return kept


def mark_owner(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], out: str = "inherited") -> DataFrame:
    """True for every row but the first of its key; rows without a key own themselves (137, 138)."""
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(out, known & (F.row_number().over(w) > 1))


def running_max(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The largest value so far (43, 44, 149)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.max(value).over(w))


def sessionize(df: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column, out: str = "turn_index") -> DataFrame:
    """Number the spans that rows with `opens` begin; rows before the first have -1 (26, 48)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, (F.sum(F.when(opens, 1).otherwise(0)).over(w) - 1).cast("long"))


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str = "island") -> DataFrame:
    """Number the runs of equal values (141, 153)."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_change")


def top_with_rest(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, label: str, rest: str = "+{n} more") -> DataFrame:
    """The first k rows of a key, then one row that counts the others (160, 161, 162)."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w).cast("long"))
    top = ranked.where(F.col("rank") <= k).select(*by, "rank", F.col(label).cast("string").alias("label"))
    before, _, after = rest.partition("{n}")
    over = ranked.where(F.col("rank") > k).groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(k + 1).cast("long").alias("rank"), F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after)).alias("label"))
    return top.unionByName(over)


def dated_window(df: DataFrame, windows: DataFrame, day: str, by: Mapping[str, str], from_col: str = "valid_from", until_col: str = "valid_until") -> DataFrame:
    """Interval join with a small dimension: inclusive ends, null ends open; before the first window the earliest holds, marked as an estimate (108).

    by: column of df -> column of the dimension. The dimension is tiny by nature (dated prices); it is left to
    Spark's size check whether it is broadcast.
    """
    ids = "_row"
    rows = df.withColumn(ids, F.monotonically_increasing_id())
    cond = F.lit(True)
    for a, b in by.items():
        cond = cond & (rows[a] == windows[b])
    inside = (windows[from_col].isNull() | (rows[day] >= windows[from_col])) & (windows[until_col].isNull() | (rows[day] <= windows[until_col]))
    early = Window.partitionBy(*by.values()).orderBy(F.col(from_col).asc_nulls_first())
    first = windows.withColumn("_first", F.row_number().over(early) == 1)
    cond = cond & (inside | (first["_first"] & (rows[day] < first[from_col])))
    hit = rows.join(first, cond, "left")
    return hit.withColumn("is_estimate", F.coalesce(F.col("_first") & (F.col(day) < F.col(from_col)), F.lit(False))).drop(ids, "_first")


def tiered(amount: Column, tiers: Sequence[tuple[float, float]], base: float) -> Column:
    """The rate of the highest tier that the amount exceeds, else the base rate (272)."""
    rate = F.lit(float(base))
    for above, value in sorted(tiers):
        rate = F.when(amount > F.lit(above), F.lit(float(value))).otherwise(rate)
    return rate


def prefix_match(text: Column, keys: Sequence[str], default: str) -> Column:
    """The key that equals the text, else the longest key it starts with, else the default (106)."""
    out = F.lit(default)
    for k in sorted(keys, key=lambda k: (len(k), k)):
        out = F.when(F.startswith(text, F.lit(k)), F.lit(k)).otherwise(out)
    for k in keys:
        out = F.when(text == F.lit(k), F.lit(k)).otherwise(out)
    return out


def overlay(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Override rows replace base rows of the same key; others are added (169, 403)."""
    return base.join(override, key, "left_anti").unionByName(override.select(*base.columns))


def pivot_counts(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str], prefix: str = "n_") -> DataFrame:
    """Counts per value as columns, zero where there is none (125): conditional sums, so no pivot job is needed."""
    return df.groupBy(*by).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(f"{prefix}{v}") for v in values])


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks (289, 290): one pass, whatever the number of rules."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def merge_counters(df: DataFrame, by: Sequence[str], counters: Column) -> DataFrame:
    """Sum maps of counts key by key (128, 362)."""
    return df.select(*by, F.explode(counters).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))


def weighted_fold(df: DataFrame, by: Sequence[str], sums: Sequence[str], weighted: Mapping[str, str]) -> DataFrame:
    """Fold aggregate rows once more: sums add, averages are weighted by another column (119, 122)."""
    aggs = [F.sum(c).alias(c) for c in sums]
    for c, weight in weighted.items():
        has = F.col(c).isNotNull() & (F.col(weight) > 0)
        aggs.append((F.sum(F.when(has, F.col(c) * F.col(weight))) / F.sum(F.when(has, F.col(weight)))).alias(c))
    return df.groupBy(*by).agg(*aggs)


def collisions(df: DataFrame, short: str, full: str) -> DataFrame:
    """Mark short ids that stand for two or more full ids (148). Two aggregates by the short id, no set is gathered."""
    many = df.groupBy(short).agg((F.min(full) != F.max(full)).alias("collides"))
    return df.join(many, short)


def in_clock_window(ts: Column, start: str, end: str) -> Column:
    """Time of day within [start, end), `HH:MM`; a window may wrap midnight (269)."""
    a, b = (int(x[:2]) * 60 + int(x[3:5]) for x in (start, end))
    minute = F.hour(ts) * 60 + F.minute(ts)
    if a == b:
        return F.lit(False)
    return (minute >= a) & (minute < b) if a < b else (minute >= a) | (minute < b)


def since_until(df: DataFrame, ts: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows at or after `since` and before `until`; rows without a time stay (83, 84)."""
    out = df
    if since is not None:
        out = out.where(F.col(ts).isNull() | (F.col(ts) >= since))
    if until is not None:
        out = out.where(F.col(ts).isNull() | (F.col(ts) < until))
    return out
