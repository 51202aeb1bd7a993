"""Sharding (operator 9): global byte-size prefix sums, cut at equal targets.

Rows are range-partitioned by id, each partition's total is taken, the driver
turns those few totals into offsets, and every partition then continues its own
running sum from its offset. A row goes to the shard in whose equal share of
all bytes its midpoint falls, so shards are contiguous in id order and differ
by at most one row's size from the target.

Defined results: null text counts as no bytes; a null id sorts first; rows with
equal ids are ordered by their text's checksum and size; an empty table gives
no rows; columns other than the id and the text are ignored, so clashing names
do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, shuffle_parts, unused

#: Bytes that a row costs besides its text.
ROW_OVERHEAD = 8


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size and checksum of each row: all that the shuffles below carry."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))


def prefix_shards(sized: DataFrame, n_shards: int) -> DataFrame:
    """Add shard and slot (gapless from 0 in each shard) to rows of doc_id, size, text_crc32."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = sized.sparkSession
    order = ["doc_id", "size", "text_crc32"]
    # The sorted narrow rows are written once: both passes then see the same partitions, whatever is lost between them.
    laid = checkpointed(sized.repartitionByRange(max(1, shuffle_parts(spark)), *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    totals = {r["pid"]: (r["b"], r["n"]) for r in laid.groupBy("pid").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    offsets: dict[int, tuple[int, int]] = {}
    at_bytes = at_rows = 0
    for pid in sorted(totals):
        offsets[pid] = (at_bytes, at_rows)
        at_bytes, at_rows = at_bytes + totals[pid][0], at_rows + totals[pid][1]
    total = max(1, at_bytes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = seen = None
        for pdf in batches:
            if not len(pdf):
                continue
            if before is None:
                before, seen = offsets[int(pdf["pid"].iloc[0])]
            size = pdf["size"].to_numpy(np.int64)
            end = before + np.cumsum(size)
            # Twice the midpoint over twice the total, in Python integers where 64 bits could overflow.
            twice = end * 2 - size
            if total < 2**62 // max(1, 2 * n_shards):
                shard = twice * n_shards // (2 * total)
            else:
                shard = np.array([int(x) * n_shards // (2 * total) for x in twice], dtype=np.int64)
            yield pdf[["doc_id", "size", "text_crc32"]].assign(shard=np.minimum(shard, n_shards - 1).astype(np.int32), row=seen + np.arange(len(pdf), dtype=np.int64))
            before, seen = int(end[-1]), seen + len(pdf)

    placed = laid.mapInPandas(place, "doc_id long, size long, text_crc32 long, shard int, row long")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    first = F.create_map(*[F.lit(x) for k, v in sorted(firsts.items()) for x in (int(k), int(v))])[F.col("shard")] if firsts else F.lit(0).cast("long")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - first).alias("slot"))


def write_shards(docs: DataFrame, assignment: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as one folder per shard, files in slot order.

    Rows without an id and rows that repeat one are matched by size and checksum too; equal ones are numbered on
    both sides and matched one to one. Shards are cut into as many files as there are shuffle partitions for them.
    """
    own = list(docs.columns)
    shard, slot, i, size, crc, no, j, size_, crc_, no_ = unused(own, "shard", "slot", "_i", "_size", "_crc", "_no", "_j", "_size2", "_crc2", "_no2")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    left = docs.withColumn(i, F.col(id_col).cast("long")).withColumn(size, (F.octet_length(raw) + ROW_OVERHEAD).cast("long")).withColumn(crc, F.crc32(raw).cast("long"))
    left = left.withColumn(no, F.row_number().over(Window.partitionBy(i, size, crc).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in own]))))
    right = assignment.select(F.col("doc_id").alias(j), F.col("size").alias(size_), F.col("text_crc32").alias(crc_), F.col("shard").alias(shard), F.col("slot").alias(slot))
    right = right.withColumn(no_, F.row_number().over(Window.partitionBy(j, size_, crc_).orderBy(shard, slot)))
    placed = left.join(right, left[i].eqNullSafe(right[j]) & (left[size] == right[size_]) & (left[crc] == right[crc_]) & (left[no] == right[no_]))
    placed = placed.select(*[F.col(f"`{c}`") for c in own], shard, slot)
    placed.repartitionByRange(max(1, shuffle_parts(docs.sparkSession)), shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).mode("overwrite").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, by the law `bytes`."""
    return prefix_shards(sizes_of(docs, id_col, text_col), n_shards)
