"""Summaries with their own percentile rules (AGG-07, AGG-08, AGG-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_summary(c: str) -> list[Column]:
    """AGG-08, AGG-33: count, min, linear p50/p95/p99, max and mean; nulls for an empty series."""
    q = F.percentile(c, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return [F.count(c).alias("n"), F.min(c).alias("min"), *[F.round(q[i], 6).alias(name) for i, name in enumerate(("p50", "p95", "p99"))], F.max(c).alias("max"), F.round(F.avg(c), 4).alias("mean")]


def serving_summary(latency: Column, memory: Column, ok: Column, seconds: float) -> list[Column]:
    """AGG-07: counts, rate, mean latency of successes, memory above zero; 0 when empty. The percentiles of large
    groups come from ``cohorts.group_quantiles``."""
    x, m = F.when(ok, latency), F.when(memory > 0, memory)
    return [F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.round(F.count_if(ok) / seconds, 6).alias("qps"), or_zero(F.avg(x)).alias("mean"), or_zero(F.max(m)).alias("max_memory")]


def or_zero(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 4)


def upper_median(c: str) -> Column:
    """AGG-14: the value at position n div 2 of the sorted values."""
    values = F.sort_array(F.collect_list(c))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))
