"""The corpus pipeline: five stages, each of which applies one training-data operator to all that the
stage before it kept. Stages but the last return the columns of ``documents``.

1. ``language_id`` drops texts without an identified language (no letter, or a posterior under one half).
2. ``near_duplicates`` keeps one document of each component of the Jaccard join (five words, 0.8).
3. ``decontamination`` drops documents in which a window of a benchmark item occurs.
4. ``secrets`` replaces every secret by a mark; ``n_chars`` is counted anew.
5. ``tokens`` encodes the texts to byte-level BPE ids and decodes them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard, langid, secret_scan
from tessera.llm.common import read, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, n=5, t=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared = bpe.vocabulary(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, shared, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

ORACLE_SQL = None  # SQL cannot express the classifiers and the tokenizer; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage returns is written and read again."""
    docs = read(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
