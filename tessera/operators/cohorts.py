"""Benchmark telemetry by cohort: latest runs, rolling baselines, verdicts and trends (AGG-01 to AGG-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import cumulated, group_positions

BLOCK = 1 << 14


def latest(df: DataFrame, cohort: list[str], order: list[Column]) -> DataFrame:
    """WIN-01: the last row of each cohort; ``order`` is descending."""
    w = Window.partitionBy(*cohort).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def prior_eligible(df: DataFrame, cohort: list[str], order: str, eligible: Column, n: int) -> DataFrame:
    """WIN-02: rows of each cohort that are eligible and before its latest row, the last ``n`` of them.

    Eligibility is decided first, then rows are counted. The latest row's order is a partial maximum, and
    Spark keeps ``n`` rows of a cohort in each task before it brings a cohort together (WindowGroupLimit).
    """
    last = df.groupBy(*cohort).agg(F.max(order).alias("_last"))
    prior = df.where(eligible).join(last, cohort).where(F.col(order) < F.col("_last")).drop("_last")
    w = Window.partitionBy(*cohort).orderBy(F.desc(order))
    return prior.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def with_halo(df: DataFrame, cohort: list[str], order: list[str], n: int, block: int = BLOCK) -> DataFrame:
    """Rows with their place ``pos`` in the cohort, dealt in blocks of ``block`` places: ``_block``, and ``_halo``
    for copies of the ``n`` rows before each block, which rolling windows over a block see but do not return."""
    at = group_positions(df, cohort, order).withColumn("_b", F.floor(F.col("pos") / block))
    late = F.col("pos") - F.col("_b") * block >= block - n
    copies = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return at.withColumn("_halo", F.explode(copies)).withColumn("_block", F.col("_b") + F.col("_halo")).withColumn("_halo", F.col("_halo") > 0).drop("_b")


def rolling(df: DataFrame, cohort: list[str], order: list[str], n: int, **columns: Column) -> DataFrame:
    """WIN-02, WIN-03: each column over the row and the ``n`` rows before it (a function of a window), for
    cohorts of any size."""
    parts = with_halo(df, cohort, order, n, max(BLOCK, n))
    w = Window.partitionBy(*cohort, "_block").orderBy("pos")
    return parts.withColumns({name: make(w) for name, make in columns.items()}).where("not _halo").drop("_halo", "_block", "pos")


def rolling_baseline(df: DataFrame, cohort: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """WIN-02 for every eligible row: median of the ``n`` rows before it, and how many there are."""
    return rolling(
        df, cohort, order, n,
        baseline=lambda w: F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-n, -1)),
        baseline_n=lambda w: F.count(value).over(w.rowsBetween(-n, -1)),
    )


def group_quantiles(df: DataFrame, group: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """AGG-03, AGG-07, AGG-09: exact order statistics of few groups of any size: the values at the places
    ``ranks`` (from 0, of ``n``, the group's number of values; a fraction lies between two of them). Nulls are
    left out.

    Equal values are counted first; running counts over ranges of values then say which value holds a place,
    so no group's values are ever in one task or buffer.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    upto = cumulated(counts, group, ["_x"], F.col("_c"), "_upto")
    sizes = upto.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.max("_upto").alias("n"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    rows = upto.join(F.broadcast(sizes) if not group else sizes, same)
    from_ = F.col("_upto") - F.col("_c")
    holds = lambda place: F.max(F.when((from_ <= place) & (place < F.col("_upto")), F.col("_x")))
    aggs = [holds(edge(r)).alias(f"_{name}_{k}") for name, r in ranks.items() for k, edge in (("lo", F.floor), ("hi", F.ceil))]
    got = rows.groupBy(*group, "n").agg(*aggs)
    value_at = lambda name, r: F.when(F.floor(r) == F.ceil(r), F.col(f"_{name}_lo")).otherwise(F.col(f"_{name}_lo") * (F.ceil(r) - r) + F.col(f"_{name}_hi") * (r - F.floor(r)))
    return got.select(*group, "n", *[value_at(name, r).alias(name) for name, r in ranks.items()])


def summarised(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """AGG-08, AGG-33: count, min, linear p50, p95 and p99, max and mean of each group's values, for groups of any
    size; nulls for a group without values."""
    rest = df.groupBy(*group).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 4).alias("mean"))
    q = group_quantiles(df.select(*group, value), group, value, {"p50": linear(0.5), "p95": linear(0.95), "p99": linear(0.99)}).drop("n")
    q = q.select(*[F.col(g).alias(f"_k_{g}") for g in group], *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    return rest.join(q, same, "left").select(*group, "n", "min", "p50", "p95", "p99", "max", "mean")


def bucket(pos: str, n: str, k: int) -> Column:
    """WIN-11: the bucket (from 0) of place ``pos`` when ``n`` rows are split into ``k`` (no more than there are
    rows), the first ones larger by one."""
    few = F.least(F.col(n), F.lit(k))
    size, extra = F.floor(F.col(n) / few), F.col(n) % few
    late = extra + F.floor((F.col(pos) - extra * (size + 1)) / size)
    return F.when(F.col(pos) < extra * (size + 1), F.floor(F.col(pos) / (size + 1))).otherwise(late).cast("bigint")


def linear(q: float) -> Column:
    """The place of quantile ``q`` by linear interpolation."""
    return F.lit(q) * (F.col("n") - 1)


def nearest(q: float) -> Column:
    """AGG-09: the place of quantile ``q`` by the nearest rank, halves to even."""
    return F.bround(F.lit(q) * (F.col("n") - 1))


def unpivot_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric of a record; metrics are cast to double."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def trend_points(df: DataFrame, cohort: list[str], order: list[str]) -> DataFrame:
    """AGG-05: every row with its position in its cohort, from 0. Rows are dealt by range, so no cohort is
    gathered in one task or array."""
    return group_positions(df, cohort, order)


# ------------------------------------------------------------------ the latest summary (AGG-04)


def metric_policies(long: DataFrame, policies: DataFrame, overrides: str) -> DataFrame:
    """SCL-05: rows (.., metric) with the policy of their metric; ``overrides`` names a column of JSON, by metric,
    whose finite numbers and booleans win. Anything else in it changes nothing."""
    own = F.from_json(F.col(overrides), "map<string,string>")[F.col("metric")]
    raw = lambda field: F.get_json_object(own, f"$.{field}")
    number = lambda field: F.when(raw(field).rlike(r"^\d+(\.\d+)?([eE][-+]?\d+)?$"), raw(field).try_cast("double"))
    rows = long.join(F.broadcast(policies), "metric")
    gated = F.when(raw("gated") == "true", True).when(raw("gated") == "false", False).otherwise(True)
    return rows.withColumns({"threshold_percent": F.coalesce(number("threshold_percent"), "threshold_percent"), "threshold_absolute": F.coalesce(number("threshold_absolute"), "threshold_absolute"), "gated": gated})


def latest_metrics(runs: DataFrame, cohort: list[str], metrics: list[str], policies: DataFrame, n: int = 5, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """AGG-04: each cohort's latest run, and one row for each of its metrics against the median of the last ``n``
    eligible runs before it.

    ``runs`` has ``at`` (its order), success, eligible, run_source, thresholds (JSON) and the metrics. With
    ``source`` the latest run is the last one from there. Policies come in the order of their column ``place``.
    """
    candidates = runs if source is None else runs.where(F.col("run_source") == source)
    last = candidates.groupBy(*cohort).agg(F.max_by(F.struct(*[c for c in runs.columns if c not in cohort]), "at").alias("r")).select(*cohort, "r.*")
    pool = runs.where(F.coalesce("success", F.lit(True)) & F.col("eligible")).join(last.select(*cohort, F.col("at").alias("_last")), cohort).where("at < _last")
    w = Window.partitionBy(*cohort).orderBy(F.desc("at"))
    pool = pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    baselines = unpivot_metrics(pool, cohort, metrics).groupBy(*cohort, "metric").agg(F.median("value").alias("baseline"), F.count("*").alias("baseline_n"))
    now = unpivot_metrics(last, [*cohort, "thresholds"], metrics).withColumnRenamed("value", "current")
    return last, metric_policies(now, policies, "thresholds").join(baselines, [*cohort, "metric"], "left")


def latest_summary(last: DataFrame, deltas: DataFrame, cohort: list[str]) -> DataFrame:
    """AGG-04: the latest runs with their verdicts; ``deltas`` are their metrics with regression_percent, exceeded
    and regressed. Lists name metrics in the policies' order."""
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c), F.struct("place", "metric")))), lambda x: x["metric"]), ",")
    rows = deltas.groupBy(*cohort).agg(
        F.coalesce(F.max("baseline_n"), F.lit(0)).alias("baseline_n"),
        F.max("regression_percent").alias("worst_regression"),
        names("exceeded").alias("exceeded_metrics"),
        names("regressed").alias("failing_metrics"),
    )
    computed = F.when(F.col("failing_metrics") == "", "pass").otherwise("fail")
    return last.join(rows, cohort).withColumns({"regression_status": computed, "status": F.when(F.col("success"), "pass").otherwise("fail")})


def eligible_for_baseline(flag: Column, source: Column) -> Column:
    """FLT-07: marked eligible, or from before there were marks and sources."""
    return F.coalesce(flag, F.lit(False)) | (flag.isNull() & source.isNull())


def filter_records(df: DataFrame, **equal) -> DataFrame:
    """FLT-05, FLT-08: text equality on each given column; empty or None arguments do not filter."""
    for name, value in equal.items():
        if isinstance(value, bool):
            df = df.where(F.col(name) == value)
        elif value:
            df = df.where(F.col(name).cast("string") == str(value))
    return df


def recent(df: DataFrame, ts: str, since) -> DataFrame:
    """FLT-06: rows from ``since`` on and rows without a timestamp."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= F.lit(since)))


def with_defaults(df: DataFrame, fields: list[str]) -> DataFrame:
    """PRJ-01: the fields as text, empty where missing or null; other columns stay."""
    return df.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f in df.columns else F.lit("") for f in fields})


def seed_records(df: DataFrame, origin: Column, branch: str, scope: str = "baseline_seed") -> DataFrame:
    """SCL-20: records as a baseline's seed: trusted, of the schedule, without the pull request they came from,
    and with their origin."""
    return df.withColumns({"seeded_from": origin, "branch": F.lit(branch), "run_source": F.lit("scheduled_main"), "baseline_eligible": F.lit(True), "pr_number": F.lit(""), "test_scope": F.lit(scope)})
