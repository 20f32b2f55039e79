"""Evaluation of corpora: a registry of metrics, per-row and mergeable ones, and set metrics (UDF-*, AGG-22)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays
from tessera.operators.cohorts import group_quantiles, linear, with_halo


@dataclass(frozen=True)
class Metric:
    """UDF-01, UDF-02: ``score`` is a column per row (null is a skipped row); ``reduce`` its aggregate; ``skipped``
    the reason why a row has no score (null: it has one)."""

    name: str
    score: Callable[[], Column]
    reduce: Callable[[Column], Column] = F.avg
    skipped: Callable[[], Column] | None = None


_METRICS: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    _METRICS[metric.name] = metric
    return metric


def resolve(names: str | list[str], strict: bool = True) -> list[Metric]:
    """UDF-03, UDF-04: all, a group by its prefix, or names; each once, in order."""
    asked = [names] if isinstance(names, str) else list(names)
    out: dict[str, Metric] = {}
    for n in asked:
        got = list(_METRICS) if n == "all" else [n] if n in _METRICS else [m for m in _METRICS if m.startswith(f"{n}.")]
        if not got and strict:
            raise KeyError(f"no metric or group {n!r}")
        out |= {g: _METRICS[g] for g in got}
    return list(out.values())


def evaluate_rows(df: DataFrame, key: list[str], metrics: list[Metric]) -> DataFrame:
    """UDF-05, SNK-13: long form (key, metric, score, skipped)."""
    wide = df.select(*key, *[m.score().cast("double").alias(m.name.replace(".", "__")) for m in metrics])
    long = wide.unpivot(key, [m.name.replace(".", "__") for m in metrics], "metric", "score")
    return long.withColumn("metric", F.replace("metric", F.lit("__"), F.lit("."))).withColumn("skipped", F.col("score").isNull())


def explained_rows(df: DataFrame, key: list[str], metrics: list[Metric]) -> DataFrame:
    """UDF-01: long form (key, metric, score, reason): a row is skipped where its metric gives a reason, and its score is
    null then; a null score without one has the reason ``no score``."""

    def result(m: Metric) -> Column:
        why = m.skipped() if m.skipped else F.lit(None).cast("string")
        score = F.when(why.isNull(), m.score().cast("double"))
        return F.struct(F.lit(m.name).alias("metric"), score.alias("score"), F.coalesce(why, F.when(score.isNull(), "no score")).alias("reason"))

    return df.select(*key, F.inline(F.array(*map(result, metrics))))


def spatial_masks(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """ARR-10: over a clip's frames (rows with two masks as arrays of 0 and 1) the IoU of the places that any frame
    marks (spatial), and of how often each is marked (weighted); 1 where neither marks any."""
    pixels = df.select(group, F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("i", "z"))
    each = pixels.groupBy(group, "i").agg(F.max("z.a").alias("any_a"), F.max("z.b").alias("any_b"), F.sum("z.a").alias("a"), F.sum("z.b").alias("b"))
    iou = lambda low, high: F.coalesce(F.try_divide(F.sum(low), F.nullif(F.sum(high), F.lit(0))), F.lit(1.0))
    return each.groupBy(group).agg(iou(F.least("any_a", "any_b"), F.greatest("any_a", "any_b")).alias("spatial_iou"), iou(F.least("a", "b"), F.greatest("a", "b")).alias("weighted_spatial_iou"))


def block_correlation(df: DataFrame, key: str, a: str, b: str, width: int, height: int, factor: int) -> DataFrame:
    """ARR-13: Pearson correlation of two frames (arrays of ``height`` rows) after means over blocks of ``factor`` by
    ``factor``, what is left over at the ends trimmed; NaN if a side is constant or a single block."""
    x, y = F.col("i") % width, F.floor(F.col("i") / width)
    pixels = df.select(key, F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("i", "z")).where((x < width // factor * factor) & (y < height // factor * factor))
    blocks = pixels.groupBy(key, F.floor(x / factor).alias("x"), F.floor(y / factor).alias("y")).agg(F.avg("z.a").alias("a"), F.avg("z.b").alias("b"))
    flat = (F.min("a") == F.max("a")) | (F.min("b") == F.max("b"))
    safe = F.when(flat, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop("a", "b"), F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))))
    return blocks.groupBy(key).agg(F.coalesce(safe, F.lit(float("nan"))).alias("r"))


def evaluate_corpus(df: DataFrame, by: list[str], metrics: list[Metric]) -> DataFrame:
    """UDF-02, UDF-05: one aggregate for each metric; partial aggregation merges what tasks accumulated."""
    return df.groupBy(*by).agg(*[m.reduce(m.score()).alias(m.name.replace(".", "_")) for m in metrics])


def consistency(df: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """WIN-05: mean over later frames of the cosines with the frame before and the first; 1 for one frame.

    Frames are numbered over ranges and meet the one before inside blocks, so a group may have any size.
    """
    parts = with_halo(df.select(group, order, vec), [group], [order], 1)
    start = parts.where((F.col("pos") == 0) & ~F.col("_halo")).select(F.col(group).alias("_g"), F.col(vec).alias("start"))
    before = F.lag(vec).over(Window.partitionBy(group, "_block").orderBy("pos"))
    frames = parts.withColumn("before", before).where("not _halo").join(start, F.col(group).eqNullSafe(F.col("_g")))
    score = (F.greatest(arrays.cosine(F.col(vec), F.col("before")), F.lit(0.0)) + F.greatest(arrays.cosine(F.col(vec), F.col("start")), F.lit(0.0))) / 2
    return frames.groupBy(group).agg(F.coalesce(F.avg(F.when(F.col("pos") > 0, score)), F.lit(1.0)).alias("score"))


def flicker(df: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """WIN-06: (255 - mean absolute difference of neighbours) / 255."""
    parts = with_halo(df.select(group, order, vec), [group], [order], 1)
    diff = arrays.mean_abs_diff(F.col(vec), F.lag(vec).over(Window.partitionBy(group, "_block").orderBy("pos")))
    return parts.select(group, "_halo", diff.alias("x")).where("not _halo").groupBy(group).agg(((255 - F.avg("x")) / 255).alias("score"))


def first_crossing(df: DataFrame, group: list[str], order: list[str], value: str, width: int, threshold: Column) -> DataFrame:
    """WIN-07: the first place at which the mean of ``width`` full rows from it passes ``threshold``; groups without
    one have no row. The mean belongs to the window's last row, which blocks with a halo see whole."""
    parts = with_halo(df, group, order, width - 1)
    mean = F.avg(value).over(Window.partitionBy(*group, "_block").orderBy("pos").rowsBetween(1 - width, 0))
    full = parts.withColumn("_m", mean).where(~F.col("_halo") & (F.col("pos") >= width - 1) & (F.col("_m") > threshold))
    return full.groupBy(*group).agg((F.min("pos") - (width - 1)).alias("onset"))


def collate(df: DataFrame, batch: str, key: str, vec: str, width: int, info: dict[str, Column]) -> DataFrame:
    """ARR-04: a row a batch: ids, the stacked vectors (padded or cut to ``width``), their shape, and a list for
    each detail, all in order of ``key``. Batches are as large as a training step."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), arrays.pad(F.col(vec), width).alias("v"), *[c.alias(n) for n, c in info.items()])))
    out = df.groupBy(batch).agg(rows.alias("r"))
    column = lambda n: F.transform("r", lambda x: x[n])
    return out.select(batch, column("k").alias("ids"), column("v").alias("tensor"), F.array(F.size("r"), F.lit(width)).alias("shape"), *[column(n).alias(n) for n in info])


def pad_to_batch(df: DataFrame, batch: str, vec: str) -> DataFrame:
    """ARR-05: vectors filled with zeros to the longest of their batch, and the masks of what was there."""
    longest = F.max(F.size(vec)).over(Window.partitionBy(batch))
    x = df.withColumn("_n", longest)
    fill = lambda c, one: F.concat(c, F.array_repeat(one, F.col("_n") - F.size(c)))
    mask = fill(F.transform(vec, lambda _: F.lit(1)), F.lit(0))
    return x.withColumn("mask", mask).withColumn(vec, fill(F.col(vec), F.lit(0).cast("float"))).drop("_n")


def gaussian_sums(df: DataFrame, group: str, vec: str) -> DataFrame:
    """AGG-22: group, n, sum and sum of outer products of finite vectors; partial sums per task, then merged."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, type_ = {}, None
        for b in batches:
            type_ = b.schema.field(0).type
            for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.asarray(v if v is not None else [np.nan], dtype=float)
                if np.isfinite(x).all():
                    x = np.append(x, 1.0)
                    sums[g] = sums.get(g, 0) + np.outer(x, x)
        for g, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * m.size, type_), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], names=["g", "i", "x"])

    kind = df.schema[group].dataType.simpleString()
    parts = df.select(group, vec).mapInArrow(partial, f"g {kind}, i int, x double")
    return parts.groupBy("g", "i").agg(F.sum("x").alias("x"))


def frechet_distance(df: DataFrame, group: str, vec: str, reference) -> DataFrame:
    """AGG-22: distance of each group's Gaussian (sample covariance) from the reference group's."""
    sums = gaussian_sums(df, group, vec)
    ref = sums.where(F.col("g") == F.lit(reference)).select("i", F.col("x").alias("r"))
    both = sums.join(F.broadcast(ref), "i")  # one matrix of the vectors' dimensions

    def fit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        d, n = m.shape[0] - 1, m[-1, -1]
        if n < 2:
            return None
        mean = m[:d, d] / n
        return mean, (m[:d, :d] - n * np.outer(mean, mean)) / (n - 1)

    def root(m: np.ndarray) -> np.ndarray:
        values, axes = np.linalg.eigh((m + m.T) / 2)
        return (axes * np.sqrt(np.clip(values, 0, None))) @ axes.T

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(round(np.sqrt(len(pdf))))
        pdf = pdf.sort_values("i")
        a, b = fit(pdf["x"].to_numpy().reshape(d, d)), fit(pdf["r"].to_numpy().reshape(d, d))
        value = None
        if a and b:
            half = root(a[1])
            value = float(((a[0] - b[0]) ** 2).sum() + np.trace(a[1]) + np.trace(b[1]) - 2 * np.trace(root(half @ b[1] @ half)))
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "distance": [value]})

    return both.groupBy("g").applyInPandas(distance, f"g {df.schema[group].dataType.simpleString()}, distance double")


def exponential_background(values: Column, alpha: float) -> Column:
    """WIN-08: avg = (1 - alpha) avg + alpha x over an ordered array, from its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda a, x: (1 - alpha) * a + alpha * x)


def drift(df: DataFrame, reference: DataFrame, channel: str, value: str) -> DataFrame:
    """AGG-37: shift and spread of a channel against the reference, and the share outside its 0.1 to 99.9 %."""
    q = group_quantiles(reference.select(channel, value), [channel], value, {"lo": linear(0.001), "hi": linear(0.999)}).drop("n")
    ref = reference.groupBy(channel).agg(F.avg(value).alias("rm"), F.stddev_samp(value).alias("rs")).where("rs > 1e-6").join(q, channel)
    x = df.join(ref, channel)
    out = F.avg(((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi"))).cast("int"))
    return x.groupBy(channel).agg((F.abs(F.avg(value) - F.first("rm")) / F.first("rs")).alias("shift"), (F.stddev_samp(value) / F.first("rs")).alias("spread"), out.alias("tail"))
