"""Operator 9: a quality classifier by the perplexity of an interpolated modified Kneser-Ney model.

The model is one of word trigrams over all trusted texts (``word_model``), counted, and looked up for every
n-gram of every document, by Spark joins sharded by n-gram; it grows with the trusted text and is never
gathered.

Trusted texts are those that ``labels`` marks with quality 1. One fold of them in ``FOLDS`` is left out of
the counts, and its perplexities give each language's quantile; documents up to the quantile are kept.

Defined results: null texts and texts without words have no perplexity and are not kept; each
language with a left-out trusted document takes its own quantile, one without any, and no language, that of
all; perplexities are compared by their logarithms, rounded up to ``STEP``, so that a quantile needs few
distinct values and a text at the threshold is kept; without any trusted text all
probabilities are equal and every text with words is kept; rows are scored one by one; labels that
contradict count by the lowest quality; rows with a null doc_id are scored and never trusted; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import word_model
from tessera.llm.common import remainder, small_side, table

QUANTILE = 0.995
FOLDS = 5
STEP = 1e-4


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept of every document."""
    trusted = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    left_out = remainder("doc_id", FOLDS) == 0
    model = word_model.train(docs.select("doc_id", "text").join(small_side(trusted.where(~left_out)), "doc_id", "left_semi"))
    scored = table(word_model.perplexity(docs.select("doc_id", "text", "lang"), model), "perplexity")
    level = F.ceil(F.round(F.ln("perplexity") / STEP, 6))
    sample = scored.join(trusted.where(left_out), "doc_id", "left_semi").where("perplexity is not null").withColumn("x", level)
    by_lang = sample.where("lang is not null").groupBy("lang").agg(F.percentile("x", F.lit(quantile)).alias("t"))
    overall = sample.agg(F.percentile("x", F.lit(quantile))).first()[0]  # one number
    limit = F.coalesce("t", F.lit(float("inf") if overall is None else overall))
    return scored.join(F.broadcast(by_lang), "lang", "left").select("doc_id", "lang", "perplexity", F.exp(limit * STEP).alias("threshold"), F.coalesce(level <= limit, F.lit(False)).alias("kept"))
