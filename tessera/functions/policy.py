"""Regression policy: tolerant scalars, thresholds per metric, deltas and verdicts (SCL-01 to SCL-12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metric, direction, relative threshold in percent, absolute threshold.
DEFAULT_POLICY = (
    ("latency", "lower", 8.0, 0.5),
    ("throughput", "higher", 8.0, 0.05),
    ("memory", "lower", 5.0, 256.0),
    ("text_encoder_time_s", "lower", 5.0, 0.25),
    ("dit_time_s", "lower", 5.0, 0.25),
    ("vae_decode_time_s", "lower", 5.0, 0.25),
)
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")
RUN_SOURCES = ("pr", "local", "scheduled_main", "unknown")


def tolerant_double(c: Column) -> Column:
    """SCL-01: a double or null; booleans count as 1 and 0; NaN is null."""
    text = F.lower(F.trim(c.cast("string")))
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(c.try_cast("double"))
    return F.when(~F.isnan(number), number)


def strict_double(json: Column, path: str) -> Column:
    """SCL-02: a JSON number; booleans, strings and nulls are null."""
    raw = F.get_json_object(json, path)
    return F.when(raw.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), raw.try_cast("double"))


def tolerant_bool(c: Column) -> Column:
    """SCL-07: true and false words in any case; anything else is null."""
    w = F.lower(F.trim(c.cast("string")))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def utc_timestamp(c: Column) -> Column:
    """SCL-06: an ISO-8601 text as a timestamp, naive ones as UTC; others are null."""
    return F.try_to_timestamp(c)


def policy_table(spark: SparkSession) -> DataFrame:
    """SCL-04: six rows, small enough to broadcast."""
    return spark.createDataFrame(DEFAULT_POLICY, "metric string, direction string, threshold_percent double, threshold_absolute double")


def resolve(override: Column, default: Column) -> Column:
    """SCL-05: an override that is a finite number of zero or more, else the default."""
    return F.when(override.isNotNull() & ~F.isnan(override) & (override >= 0), override).otherwise(default)


def delta(current: Column, baseline: Column, direction: Column, percent: Column, absolute: Column) -> dict[str, Column]:
    """SCL-03: how much worse ``current`` is, in percent and absolute; exceeded if both pass their threshold."""
    worse = F.when(direction == "lower", current - baseline).otherwise(baseline - current)
    ok = (baseline > 0) & current.isNotNull()
    return {
        "regression_percent": F.when(ok, worse / baseline * 100.0),
        "absolute_delta": F.when(ok, worse),
        "exceeded": F.coalesce(F.when(ok, (worse / baseline * 100.0 > percent) & (worse > absolute)), F.lit(False)),
    }


def first_of(cases: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first case that holds (SCL-10, FLT-12, FLT-18)."""
    chain = reduce(lambda c, case: c.when(F.coalesce(case[1], F.lit(False)), case[0]), cases, F)
    return chain.otherwise(otherwise)
