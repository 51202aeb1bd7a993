"""A corpus pipeline of five stages; each stage's rows are written and read again as the next one's documents.

1. toxicity: fits on the labelled rows and drops the documents that it rejects;
2. near_dedup: five-word shingles, Jaccard 0.8; one document of each group stays;
3. secrets: every secret found in a text is replaced by a mark, the document stays;
4. mixing: documents are repeated or left out so that sources meet their weights;
5. bpe: the tokens of every document that is left.

All but the last return the columns of documents. SQL can express neither the
fitted classifier nor the rounding, so ORACLE_SQL is None and what the stages
call is tested in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, mixing, near_dedup, secret_scan, toxicity
from tracemill.llm.common import checkpointed, table
from tracemill.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs, mixing.mix_sources(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
