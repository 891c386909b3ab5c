"""Corpus pipeline: documents to tokens, in stages that are each written as Parquet and reread.

1. ``toxicity``: documents scored 0.3 or more go.
2. ``ngram_join``: of each component of near copies the document with the smallest id stays.
3. ``decontamination``: documents that hold a window of a benchmark item go.
4. ``secrets``: secrets in texts become ``[secret]`` (``n_chars`` follows); no document goes.
5. ``bpe``: token counts and digests of the ids and of the decoded bytes.

All stages but the last return the columns they got.  Null texts and null ids
pass through: they are never toxic, linked or contaminated.  An empty table
gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelift.llm import bpe, decontaminate, ngram_join, secrets, toxicity
from pagelift.llm.common import table, trimmed, written

BATCH_CHARS = 1 << 19


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_component(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redacted(docs, secrets.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(docs, ranks, batch_chars=BATCH_CHARS, hold=trimmed)  # in workers that four stages have used before


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontamination", drop_benchmark),
          ("secrets", redact_secrets), ("bpe", encode)]

#: Trained scores and tokens can't be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
