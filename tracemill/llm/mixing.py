"""Mixing sources to target weights (operator 7): pivotal dependent rounding.

Every source has a target in words. A document is expected target / source size
times: the whole part is sure, the fraction is rounded. Rounding is pivotal:
two fractional documents of a source meet, mass moves from one to the other at
random, weighted by their sizes so that the expected words stay exactly what
they were, until one of the two is integral. The last fractional document of
each small group goes up a reduction tree, where such residuals meet again. At
the root one document of each source is left and is drawn by its probability:
taken words miss the target by less than that document's size, and every
document's expected copies are exactly target / source size.

All random draws and groups are hashes of what names a row: its id, its text's
hash and, for rows equal in both, a running number. Rows without an id or that
repeat one are thus spread like others, and reruns agree whatever the
partitioning.

Defined results: null or empty text has size 0 and takes 0 words; a null source
is a source of its own and sorts last; repeated rows are rounded one by one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import WORD, checkpointed, unused

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: Rows that meet in one group of the tree, on average.
GROUP_ROWS = 1000
#: Sources are few and named by people; more than this many is refused rather than gathered.
MAX_SOURCES = 1_000_000
#: Rows equal in id, source and text that one task numbers.
EQUAL_ROWS = 10_000
#: Below this many sources their targets are sent to all executors (some 50 bytes each).
BROADCAST_SOURCES = 50_000
#: Keys of repeated rows are sent to all executors up to this many (some 50 bytes each).
BROADCAST_KEYS = 50_000
_MASK = (1 << 64) - 1


def targets_of(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> dict[str | None, float]:
    """Target words per source. sizes: (source, words). All words are shared by weight; what exceeds max_copies times a source's size is shared again among the others."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(ordered)}
    size, target = dict(ordered), {s: 0.0 for s, _ in ordered}
    left, active = float(sum(size.values())), [s for s, _ in ordered]
    while active and left > 0:
        unit = left / sum(weight[s] for s in active)
        above = [s for s in active if unit * weight[s] > max_copies * size[s]]
        if not above:
            for s in active:
                target[s] = unit * weight[s]
            break
        for s in above:
            target[s] = float(max_copies * size[s])
            left -= target[s]
        gone = set(above)
        active = [s for s in active if s not in gone]
    return target


def _draw(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends on the two ids and the seed only."""
    z = (a * 0x9E3779B97F4A7C15 + b * 0xBF58476D1CE4E5B9 + seed * 0x94D049BB133111EB + 0x2545F4914F6CDD1D) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return ((z ^ (z >> 31)) >> 11) / float(1 << 53)


def pivotal_round(ids: Sequence[int], sizes: Sequence[int], probs: Sequence[float], seed: int, root: bool) -> tuple[list[int], int, float]:
    """0 or 1 for each row; the place of the row that stays fractional (-1: none) and its probability. At the root it is drawn, and none stays."""
    eps = 1e-12
    out = [0] * len(ids)
    held, p = -1, 0.0
    for j in range(len(ids)):
        q = float(probs[j])
        if held < 0:
            held, p = j, q
        else:
            ratio = sizes[held] / sizes[j]  # words that leave the one arrive at the other
            up, down = min(1.0 - p, q / ratio), min(p, (1.0 - q) / ratio)
            if _draw(int(ids[held]), int(ids[j]), seed) * (up + down) < down:
                p, q = p + up, q - up * ratio
            else:
                p, q = p - down, q + down * ratio
            if eps < q < 1 - eps:  # then the held one is integral
                out[held] = int(p > 0.5)
                held, p = j, q
            else:
                out[j] = int(q > 0.5)
        if held >= 0 and not eps < p < 1 - eps:
            out[held] = int(p > 0.5)
            held = -1
    if root and held >= 0:
        out[held], held = int(_draw(int(ids[held]), len(ids), seed) < p), -1
    return out, held, p


def _rounder(seed: int, root: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable", ignore_index=True)
        up, held, p = pivotal_round(pdf["key"].tolist(), pdf["size"].tolist(), pdf["prob"].tolist(), seed, root)
        prob = np.full(len(pdf), np.nan)
        if held >= 0:
            prob[held] = p
        return pdf[["doc_id", "text_hash", "key", "size", "source_ix", "sure"]].assign(up=np.array(up, dtype=np.int32), prob=prob)

    return run


_ROUNDED = "doc_id long, text_hash long, key long, size long, source_ix long, sure int, up int, prob double"


def _named_rows(counted: DataFrame) -> DataFrame:
    """A row for each of `n` equal ones, and its `key`: a hash of id, text and running number."""
    first = F.col("n") > EQUAL_ROWS
    lots = counted.where(first)
    if lots.limit(1).count():  # many equal rows are numbered by several tasks
        lots = lots.withColumn("from_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL_ROWS).cast("long"))))
        lots = checkpointed(lots.repartition("doc_id", "text_hash", "from_n")).withColumn("no", F.explode(F.sequence("from_n", F.least(F.col("n"), F.col("from_n") + EQUAL_ROWS) - 1))).drop("from_n")
        every = counted.where(~first).withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).unionByName(lots)
    else:
        every = counted.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return every.withColumn("key", F.xxhash64("doc_id", "text_hash", "no")).drop("n", "no")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, text_hash, source, size, source_size, target, copies, taken (copies times size)."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), F.xxhash64(text).alias("text_hash"))
    counted = checkpointed(counted.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("n")))
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    target = targets_of([(r["source"], r["size"]) for r in totals], weights, max_copies)
    plan, names, most = [], sorted((r["source"] for r in totals), key=lambda s: (s is None, s or "")), 0
    by = {r["source"]: r for r in totals}
    for ix, s in enumerate(names):
        x = target[s] / by[s]["size"] if by[s]["size"] else 0.0
        sure = min(max_copies, math.floor(x + 1e-12))
        part = min(max(x - sure, 0.0), 1.0) if sure < max_copies else 0.0
        plan.append((ix, s, int(by[s]["size"]), float(target[s]), sure, part if 1e-12 < part < 1 - 1e-12 else 0.0, int(by[s]["n"])))
        most = max(most, by[s]["n"])
    sources = spark.createDataFrame(plan, "source_ix long, s_name string, source_size long, target double, sure int, part double, n_rows long")
    if len(plan) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    known = _named_rows(counted).join(sources, F.col("source").eqNullSafe(F.col("s_name"))).drop("s_name")
    still = (F.col("part") > 0) & (F.col("size") > 0)
    row = ["doc_id", "text_hash", "key", "size", "source_ix", "sure"]
    settled = [known.where(~still).select(*row, F.lit(0).alias("up"))]
    level, groups = 0, max(1, math.ceil(most / GROUP_ROWS))
    rest = known.where(still).select(*row, F.col("part").alias("prob"), "n_rows")
    group_rows = F.lit(GROUP_ROWS)
    while True:
        root = groups == 1
        n_groups = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / group_rows)) if not root else F.lit(1)
        keyed = rest.withColumn("part_of", F.pmod(F.xxhash64(F.col("key"), F.lit(level)), n_groups.cast("long")))
        done = keyed.groupBy("source_ix", "part_of").applyInPandas(_rounder(seed * 1009 + level, root), _ROUNDED)
        done = checkpointed(done)
        fractional = F.col("prob").isNotNull() & ~F.isnan("prob")
        settled.append(done.where(~fractional).select(*row, "up"))
        if root:
            break
        counts = spark.createDataFrame([(p[0], p[6]) for p in plan], "source_ix long, n_rows long")
        if len(plan) <= BROADCAST_SOURCES:
            counts = F.broadcast(counts)
        rest = done.where(fractional).select(*row, "prob").join(counts, "source_ix")
        level += 1
        group_rows = F.lit(float(GROUP_ROWS) ** (level + 1))
        groups = math.ceil(most / float(GROUP_ROWS) ** (level + 1))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = F.col("sure") + F.col("up")
    return out.join(sources.select("source_ix", F.col("s_name").alias("source"), "source_size", "target"), "source_ix").select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixture itself: every document as many times as the mix takes it, with the columns of docs.

    Rows that share id, source and text are one key to the join. The copies that the mix gives them are handed
    out over them in the order of their hashes: they differ by one at most, as in the mix. These rows alone meet
    in one window per key.
    """
    own = list(docs.columns)
    i, s, h, total, rows, copies, at, copy, long_id, text_hash = unused(own, "_i", "_s", "_h", "_sum", "_rows", "_copies", "_at", "_copy", "_long", "_text_hash")
    per = mixed.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("text_hash").alias(h)).agg(F.sum("copies").alias(total), F.count("*").alias(rows)).where(F.col(total) > 0)
    named = docs.withColumn(text_hash, F.xxhash64(F.col("text").cast("string"))).withColumn(long_id, F.col("doc_id").cast("long"))

    def hit(keys: DataFrame) -> DataFrame:
        return named.join(keys, named[long_id].eqNullSafe(keys[i]) & named["source"].cast("string").eqNullSafe(keys[s]) & (named[text_hash] == keys[h]))

    taken = hit(per.where(F.col(rows) == 1)).withColumn(copies, F.col(total).cast("int"))
    again = checkpointed(per.where(F.col(rows) > 1))
    n_again = again.count()
    if n_again:
        among = Window.partitionBy(i, s, h).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in own]))
        repeated = hit(F.broadcast(again) if n_again <= BROADCAST_KEYS else again).withColumn(at, F.row_number().over(among))
        share = F.floor(F.col(total) / F.col(rows)) + (F.col(at) <= F.col(total) % F.col(rows)).cast("int")
        taken = taken.unionByName(repeated.withColumn(copies, share.cast("int")).drop(at))
    return taken.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in own])
