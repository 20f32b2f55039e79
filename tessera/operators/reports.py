"""Reports with the whole of their rules: stress, batches, duplicates, filters, series, scores (AGG-10 to AGG-36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cohorts import group_quantiles, linear, with_halo
from tessera.operators.joins import group_positions, positions


def stress_report(sessions: DataFrame, chunks: DataFrame, threshold_ms: float) -> DataFrame:
    """AGG-11: one row about a stress run.

    ``sessions``: status, and progressive (boolean or null). ``chunks``: gap_ms (null for a first one), finish
    (seconds, null if unknown) and size_bytes. Ratios are over what is known; goodput is all bytes over the time
    between the first and the last chunk, buckets are the bytes of whole seconds. Nulls where there is nothing to
    say; a run passes if all sessions succeeded and there are gaps, none of them at the threshold or over.
    """
    known = ("success", "failed", "timeout", "protocol_error")
    status, flag = F.coalesce("status", F.lit("unknown")), F.col("progressive")
    s = sessions.agg(
        F.count("*").alias("total"), *[F.count_if(status == k).alias(k) for k in known], F.count_if(~status.isin(*known)).alias("other"),
        F.count(flag).alias("eligible"), F.count_if(flag).alias("progressive"),
    )
    sized = F.col("finish").isNotNull() & (F.coalesce("size_bytes", F.lit(0)) > 0)
    c = chunks.agg(
        F.count("gap_ms").alias("gaps"), F.min("gap_ms").alias("gap_min"), F.max("gap_ms").alias("gap_max"), F.avg("gap_ms").alias("gap_avg"), F.count_if(F.col("gap_ms") >= threshold_ms).alias("breaches"),
        F.count_if(sized).alias("sized"), F.sum(F.when(sized, F.col("size_bytes"))).alias("bytes"), (F.max(F.when(sized, F.col("finish"))) - F.min(F.when(sized, F.col("finish")))).alias("span"),
    )
    q = group_quantiles(chunks.select("gap_ms"), [], "gap_ms", {"gap_p50": linear(0.5), "gap_p95": linear(0.95), "gap_p99": linear(0.99)}).drop("n")
    buckets = chunks.where(sized).groupBy(F.floor("finish").alias("second")).agg((F.sum("size_bytes") * 8 / 1e6).alias("mbps")).agg(F.count("*").alias("buckets"), F.avg("mbps").alias("bucket_avg"), F.max("mbps").alias("bucket_peak"))
    one = s.join(F.broadcast(c)).join(F.broadcast(buckets)).join(F.broadcast(q), F.lit(True), "left")  # rows of one each
    bad = F.col("total") - F.col("success")
    reasons = F.array_compact(F.array(
        F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" session(s) did not succeed"))),
        F.when(F.col("gaps") == 0, "no chunk gaps"),
        F.when(F.col("breaches") > 0, F.concat(F.col("breaches").cast("string"), F.lit(" chunk gap(s) at the threshold or over"))),
    ))
    goodput = F.when((F.col("sized") >= 2) & (F.col("span") > 0), F.col("bytes") * 8 / F.col("span") / 1e6)
    return one.select(
        "total", *known, "other", "gaps", "gap_min", "gap_p50", "gap_p95", "gap_p99", "gap_max", "gap_avg", "breaches", "eligible", "progressive",
        F.try_divide("progressive", F.nullif("eligible", F.lit(0))).alias("progressive_ratio"), goodput.alias("goodput_mbps"), "buckets", "bucket_avg", "bucket_peak",
        (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, "; ").alias("reasons"),
    )


def batch_consistency(values: DataFrame, by: list[str], member: str, lower_is_better: Column, most: float) -> DataFrame:
    """AGG-32: of each batch and metric (``by``) its number of values, median, the member that regresses most against
    the median (of equals the first) and by how much, and a verdict: ``skipped`` under two values, ``invalid`` where
    the median is not positive, else ``fail`` over ``most`` or ``pass``. Values that are null or not finite are
    left out."""
    finite = values.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    medians = group_quantiles(finite.select(*by, "value"), by, "value", {"median": linear(0.5)})
    off = F.when(lower_is_better, F.col("value") - F.col("median")).otherwise(F.col("median") - F.col("value")) / F.when(F.col("median") > 0, F.col("median"))
    worst = finite.join(medians.drop("n"), by).withColumn("off", off).groupBy(*by).agg(F.max("off").alias("regression"), F.max_by(member, F.struct("off", -F.col(member))).alias("worst"))
    verdict = F.when(F.col("n") < 2, "skipped").when(F.col("median") <= 0, "invalid").when(F.col("regression") > most, "fail").otherwise("pass")
    told = verdict.isin("pass", "fail")
    return medians.join(worst, by).select(*by, "n", "median", F.when(told, F.col("worst")).alias("worst"), F.when(told, F.col("regression")).alias("regression"), verdict.alias("verdict"))


def duplicate_sources(records: DataFrame, order: str, path: Column, content: Column, provenance: list[tuple[str, Column]]) -> DataFrame:
    """AGG-28: records that come again under a key of theirs: kind (path, content, provenance), key, how many (n), the
    first of them.

    ``provenance`` lists the keys by priority: the first that is not null names a record; without any it has no such
    key. ``content`` is digested."""
    first = F.coalesce(*[F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), c)) for name, c in provenance])
    named = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.array(named("path", path), named("content", F.sha2(content.cast("binary"), 256)), named("provenance", first))
    rows = records.select(order, F.explode(keys).alias("k")).where("k.key is not null").groupBy("k.kind", "k.key")
    return rows.agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")


def filter_statistics(df: DataFrame, stages: list[tuple[str, Column]], measure: Column) -> DataFrame:
    """AGG-26: rows before and after ordered filters, rows that each stage refused, and how often each ``measure``
    occurs among those kept: (kind, key, n)."""
    refused = F.lit(None).cast("string")
    for name, keep in reversed(stages):
        refused = F.when(~F.coalesce(keep, F.lit(False)), name).otherwise(refused)
    parts = df.select(refused.alias("r"), measure.cast("string").alias("m")).groupBy("r", F.when(F.col("r").isNull(), F.col("m")).alias("m")).count()
    kept = F.col("r").isNull()
    mark = lambda kind, key, n: F.struct(kind.alias("kind"), key.alias("key"), n.alias("n"))
    n, none = F.col("count"), F.lit("")
    marks = F.array(
        mark(F.lit("before"), none, n),
        mark(F.lit("after"), none, F.when(kept, n).otherwise(F.lit(0))),
        mark(F.when(kept, "measure").otherwise("refused"), F.when(kept, F.coalesce("m", F.lit("null"))).otherwise(F.col("r")), n),
    )
    return parts.select(F.explode(marks).alias("x")).groupBy("x.kind", "x.key").agg(F.sum("x.n").alias("n"))


def compared_series(series: DataFrame, group: str, order: list[str], boundary: int) -> DataFrame:
    """AGG-36: columns a, b and reference by place, means over the groups up to the shortest one, then before and from
    ``boundary`` on: n, mean a, mean b, the change from a to b in percent, and the rates of a and b against the
    reference (null where that is zero)."""
    at = group_positions(series, [group], order, "i")
    shortest = at.groupBy(group).agg(F.max("i").alias("last")).agg(F.min("last").alias("last"))
    means = at.join(F.broadcast(shortest), F.col("i") <= F.col("last")).groupBy("i").agg(*[F.avg(c).alias(c) for c in ("a", "b", "reference")])
    rate = lambda c: F.try_divide(F.avg(c), F.nullif(F.avg("reference"), F.lit(0.0)))
    change = F.try_divide(F.avg("b") - F.avg("a"), F.nullif(F.avg("a"), F.lit(0.0))) * 100
    return means.groupBy((F.col("i") >= boundary).alias("judged")).agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), change.alias("change_percent"), rate("a").alias("rate_a"), rate("b").alias("rate_b"))


def listed_mean(values: str) -> Column:
    """The mean over all elements of the groups' lists: longer lists weigh more."""
    return F.sum(F.aggregate(values, F.lit(0.0), lambda s, x: s + x)) / F.nullif(F.sum(F.size(values)), F.lit(0))


def corpus_score(results: DataFrame, by: list[str]) -> DataFrame:
    """AGG-17: the corpus score of each group. Per-frame lists (mse, st, and of the reference pv_mse, pv_st) weigh by
    their frames, row values (s, ws, pv_s, pv_ws) by row; clipped to [0, 100], two decimals."""
    parts = results.groupBy(*by).agg(*[listed_mean(c).alias(c) for c in ("mse", "st", "pv_mse", "pv_st")], *[F.avg(c).alias(c) for c in ("s", "ws", "pv_s", "pv_ws")])
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    score = 100 * ((ratio("st", "pv_st") + ratio("s", "pv_s") + ratio("ws", "pv_ws")) / 3 - (F.col("mse") - F.col("pv_mse")))
    return parts.withColumn("score", F.round(F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)), 2))


def base_ratios(rows: DataFrame, base: DataFrame, key: str, value: str, norm: str, top: int) -> DataFrame:
    """JOIN-20: how far values are from their base: (part, key, value): the ``top`` largest ratios with their keys, the
    smallest, keys without a base, and totals as roots of sums of squares (of the matched ones). A base of no size
    gives an infinite ratio."""
    both = rows.select(key, F.col(value).alias("_x")).join(base.select(key, F.col(norm).alias("_n")), key, "left")
    matched = both.where(F.col("_n").isNotNull()).withColumn("_r", F.when(F.col("_n") > 1e-12, F.col("_x") / F.nullif("_n", F.lit(0.0))).otherwise(F.lit(float("inf"))))
    k = F.col(key).cast("string").alias("key")
    part = lambda df, name, v: df.select(F.lit(name).alias("part"), k, v.alias("value"))
    size = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    totals = matched.agg(size("_n").alias("base"), size("_x").alias("rows"), F.count("*").cast("double").alias("matched")).unpivot([], ["base", "rows", "matched"], "key", "value")
    out = part(matched.orderBy(F.desc("_r"), F.desc(key)).limit(top), "largest", F.col("_r")).unionByName(part(matched.orderBy("_r", key).limit(1), "smallest", F.col("_r")))
    return out.unionByName(part(both.where("_n is null"), "unmatched", F.lit(None).cast("double"))).unionByName(totals.select(F.lit("total").alias("part"), "key", "value"))


def benchmark_record(runs: DataFrame, by: list[str], seconds: str, memory: str, frames: float, components: list[str]) -> DataFrame:
    """AGG-10: runs as one record: mean seconds, peak memory, frames a second (one run a second without frames), and the
    mean of each component over the runs that measured it, rounded."""
    mean = F.avg(seconds)
    fps = F.when(mean > 0, F.lit(float(frames or 1.0)) / mean)
    parts = [F.round(F.avg(c), 3).alias(f"{c}_avg") for c in components]
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.round(mean, 3).alias("avg_time"), F.round(fps, 3).alias("fps"), F.round(F.max(memory), 1).alias("peak_memory"), *parts)


def temporal_onset(df: DataFrame, group: str, order: list[str], value: str, width: int = 5) -> DataFrame:
    """AGG-23: of each series the threshold (twice the median of its first ``width`` values, 1 at least) and the first
    place at which the mean of ``width`` values passes it; a shorter series is one window."""
    parts = with_halo(df.select(group, *order, value), [group], order, width - 1)
    own = parts.where("not _halo")
    head = own.where(F.col("pos") < width).groupBy(group).agg(F.greatest(F.median(value) * 2, F.lit(1.0)).alias("threshold"))
    sizes = own.groupBy(group).agg(F.least(F.max("pos") + 1, F.lit(width)).alias("w"))
    w = Window.partitionBy(group, "_block").orderBy("pos").rowsBetween(1 - width, 0)
    full = parts.withColumn("_m", F.avg(value).over(w)).where("not _halo").join(sizes, group).where(F.col("pos") >= F.col("w") - 1).join(head, group)
    onset = full.where(F.col("_m") > F.col("threshold")).groupBy(group).agg(F.min(F.col("pos") - F.col("w") + 1).alias("onset"))
    return head.join(onset, group, "left")


def markdown_table(df: DataFrame, order: list[str], columns: dict[str, Column], right: set[str] = frozenset(), title: str | None = None) -> DataFrame:
    """SNK-10: a table as lines by ``pos``: a title and a blank line, the names, the rule (right-aligned where asked
    for), a line for each row in ``order``."""
    at = positions(df.withColumns({f"_c{i}": c for i, c in enumerate(columns.values())}), order)
    head = ([f"## {title}", ""] if title else []) + ["| " + " | ".join(columns) + " |", "|" + "|".join("---:" if c in right else "---" for c in columns) + "|"]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[f"_c{i}" for i in range(len(columns))]), F.lit(" |"))
    body = at.select((F.col("pos") + len(head)).alias("pos"), cells.alias("line"))
    return df.sparkSession.createDataFrame(list(enumerate(head)), "pos bigint, line string").unionByName(body)
