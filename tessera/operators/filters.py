"""Dataset validation and filtering with reasons (FLT-01 to FLT-19)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidatorChain:
    """FLT-03, UDF-06: named rules in order; a row is charged to the first rule that it fails."""

    def __init__(self, rules: dict[str, Column] | None = None):
        self.rules = dict(rules or {})

    def add_validator(self, name: str, keep: Column) -> ValidatorChain:
        self.rules[name] = keep
        return self

    def first_failed(self) -> Column:
        """The first failed rule's name, null for rows that pass; a rule that is null fails."""
        if not self.rules:
            return F.lit(None).cast("string")
        return reduce(lambda c, r: c.when(~F.coalesce(r[1], F.lit(False)), r[0]), self.rules.items(), F)

    def keep(self, df: DataFrame) -> DataFrame:
        return df.where(self.first_failed().isNull())

    def counts(self, df: DataFrame) -> DataFrame:
        return df.groupBy(F.coalesce(self.first_failed(), F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))


def valid_media(path: str, caption: str, duration: str, fps: str) -> Column:
    """FLT-01: a caption, and either a video with duration and rate or a picture."""
    video = F.col(path).endswith(".mp4") & F.col(duration).isNotNull() & F.col(fps).isNotNull()
    return F.col(caption).isNotNull() & (video | F.col(path).endswith(".jpg"))


def fits_length(fps: Column, duration: Column, frames: int, train_fps: int, tolerance: float, speed: float = 1.0) -> Column:
    """FLT-02: not longer than the tolerance allows."""
    return F.ceil(fps * duration) / fps <= tolerance * (frames / train_fps * speed)


def kept_by_hash(key: Column, seed: int, drop: float) -> Column:
    """FLT-02, SMP-08: a share of ``drop`` of the keys goes, the same ones in every run."""
    return unit_hash(key, seed) >= drop


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of a SHA-1 of seed and key."""
    digits = F.substring(F.sha1(F.concat_ws("/", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 32))


def metric_verdict(metrics: dict[str, tuple[Column, float]]) -> Column:
    """FLT-11: empty for rows whose every metric reaches its threshold, else the reasons."""
    reasons = [F.when(c.isNull() | F.isnan(c), f"{name} missing").when(c < least, f"{name} below {least:g}") for name, (c, least) in metrics.items()]
    return F.concat_ws("; ", *reasons)


def valid_data_type(caption: str, fps: str, frames: str) -> Column:
    """FLT-04: a caption that is not empty, a rate and a number of frames above zero; nulls are invalid."""
    return F.coalesce((F.length(caption) > 0) & (F.col(fps) > 0) & (F.col(frames) > 0), F.lit(False))


def valid_size(width: Column, height: Column) -> Column:
    """FLT-04: both sides are there; their limits are not checked."""
    return width.isNotNull() & height.isNotNull()


def classified(df: DataFrame, text: str, classify, threshold: float, unsafe: str = "unsafe") -> DataFrame:
    """UDF-08: label, score, decision and reason of each row's text by any classifier.

    ``classify`` is a function of a list of texts (line ends as blanks) that gives a label and a score of each; it runs
    on Arrow batches, and may load its model the first time. None as classifier is one that is not there. BLOCK is an
    unsafe label with a score at the threshold or over; a batch on which the classifier fails has no decision.
    """
    kind = T.StructType().add("label", "string").add("score", "double").add("reason", "string")

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        values = [(v or "").replace("\n", " ") for v in texts.to_pylist()]
        try:
            got = classify(values)
            rows = [{"label": label, "score": float(score), "reason": None} for label, score in got]
            if len(rows) != len(values):
                raise ValueError(f"{len(rows)} labels for {len(values)} texts")
        except Exception as e:  # the classifier is the user's: what fails in it is their rows' reason
            rows = [{"label": None, "score": None, "reason": f"classifier error: {e}"}] * len(values)
        return pa.array(rows, pa.struct([("label", pa.string()), ("score", pa.float64()), ("reason", pa.string())]))

    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"), F.lit("no classifier").alias("reason"))
    out = df.withColumn("_c", run(text) if classify is not None else none)
    label, score, reason = F.col("_c.label"), F.col("_c.score"), F.col("_c.reason")
    decision = F.when(reason.isNotNull(), "UNAVAILABLE").when((label == unsafe) & (score >= threshold), "BLOCK").otherwise("ALLOW")
    return out.withColumns({"label": label, "score": score, "decision": decision, "reason": reason}).drop("_c")


def safety_decision(score: Column, threshold: float) -> Column:
    """UDF-08: BLOCK at the threshold or above, ALLOW below it, UNAVAILABLE without a score."""
    return F.when(score.isNull() | F.isnan(score), "UNAVAILABLE").when(score >= threshold, "BLOCK").otherwise("ALLOW")
