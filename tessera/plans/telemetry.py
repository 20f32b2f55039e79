"""Queries on benchmark telemetry; ``events`` stands for run records: event_type is the cohort, value the
latency, (ts, event_id) the order, and a run succeeded unless its type is ``error``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import policy
from tessera.operators import cohorts, joins, scans
from tessera.plans.registry import query, read

WINDOW = 5


def _records(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        "event_id", "ts", "event_type", "value", "user_id",
        F.struct("ts", "event_id").alias("at"),
        (F.col("event_type") != "error").alias("success"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )


METRICS = [m[0] for m in policy.DEFAULT_POLICY]


def _runs(spark, d) -> DataFrame:
    """Events as benchmark runs with everything the summary reads: six metrics (some never measured), flags and
    sources of all kinds, and thresholds as JSON, stated, malformed or absent."""
    i, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    return _records(spark, d).select(
        "event_id", "at", F.col("event_type").alias("model_id"), F.concat(F.lit("g"), u % 3).alias("gpu_type"), (i % 6 != 0).alias("success"),
        F.coalesce(F.when(u % 5 == 0, "pr").when(u % 5 == 1, "local").when(u % 5 == 2, "scheduled_main"), F.lit("unknown")).alias("run_source"),
        cohorts.eligible_for_baseline(F.when(i % 4 == 0, False).when(i % 4 == 1, True), F.when(u % 5 != 4, "stated")).alias("eligible"),
        F.when(u % 3 == 0, '{"latency": {"threshold_percent": 0.5, "gated": false}, "memory": {"threshold_percent": true}}').when(u % 3 == 1, '{"throughput": {"threshold_percent": 1, "threshold_absolute": 0.001}}').otherwise("[]").alias("thresholds"),
        F.col("value").alias("latency"), (1000 / (F.col("value") + 1)).alias("throughput"), F.when(i % 11 != 0, k * 100.0).alias("memory"), (F.col("value") / 10).alias("text_encoder_time_s"),
        F.lit(None).cast("double").alias("dit_time_s"), F.when(i % 2 == 0, k / 10.0).alias("vae_decode_time_s"))


_COHORT = ["model_id", "gpu_type"]
_RUNS = """r AS (SELECT event_id, ts, event_type AS model_id, 'g' || user_id % 3 AS gpu_type, event_id % 6 <> 0 AS success, coalesce(CASE user_id % 5 WHEN 0 THEN 'pr' WHEN 1 THEN 'local' WHEN 2 THEN 'scheduled_main' END, 'unknown') AS run_source,
 event_id % 4 = 1 OR (event_id % 4 > 1 AND user_id % 5 = 4) AS eligible, user_id % 3 AS u, [value, 1000 / (value + 1), CASE WHEN event_id % 11 <> 0 THEN k * 100::DOUBLE END, value / 10, NULL::DOUBLE, CASE WHEN event_id % 2 = 0 THEN k / 10::DOUBLE END] AS x FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)),
l AS (SELECT * FROM r {source} QUALIFY row_number() OVER (PARTITION BY model_id, gpu_type ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT r.* FROM r JOIN l USING (model_id, gpu_type) WHERE (r.ts, r.event_id) < (l.ts, l.event_id) AND r.success AND r.eligible QUALIFY row_number() OVER (PARTITION BY model_id, gpu_type ORDER BY r.ts DESC, r.event_id DESC) <= 5),
m AS (SELECT model_id, gpu_type, i, median(x[i]) AS baseline, count(*) AS baseline_n FROM b, range(1, 7) t(i) GROUP BY ALL),
p(i, metric, lower, pct, least) AS (VALUES (1, 'latency', true, 8.0::DOUBLE, 0.5::DOUBLE), (2, 'throughput', false, 8.0, 0.05), (3, 'memory', true, 5.0, 256.0), (4, 'text_encoder_time_s', true, 5.0, 0.25), (5, 'dit_time_s', true, 5.0, 0.25), (6, 'vae_decode_time_s', true, 5.0, 0.25)),
c AS (SELECT l.*, p.i, p.metric, x[p.i] AS current, baseline, coalesce(baseline_n, 0) AS baseline_n, CASE WHEN u = 0 AND p.i = 1 THEN 0.5 WHEN u = 1 AND p.i = 2 THEN 1 ELSE pct END AS pct, CASE WHEN u = 1 AND p.i = 2 THEN 0.001 ELSE least END AS least, NOT (u = 0 AND p.i = 1) AS gated, CASE WHEN lower THEN x[p.i] - baseline ELSE baseline - x[p.i] END AS worse FROM l CROSS JOIN p LEFT JOIN m ON m.model_id = l.model_id AND m.gpu_type = l.gpu_type AND m.i = p.i),
e AS (SELECT *, CASE WHEN baseline > 0 THEN worse / baseline * 100 END AS reg, CASE WHEN baseline > 0 THEN worse END AS delta, coalesce(baseline > 0 AND worse / baseline * 100 > pct AND worse > least, false) AS exceeded FROM c)"""


def _deltas(spark, d, source=None):
    places = policy.policy_table(spark).withColumn("place", F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric")))
    last, rows = cohorts.latest_metrics(_runs(spark, d), _COHORT, METRICS, places, WINDOW, source)
    x = policy.delta(F.col("current"), F.col("baseline"), F.col("direction"), F.col("threshold_percent"), F.col("threshold_absolute"))
    return last, rows.withColumns(x).withColumn("regressed", F.col("exceeded") & F.col("gated"))


_SUMMARY = """SELECT model_id, gpu_type, any_value(event_id) AS event_id, any_value(run_source) AS run_source, any_value(eligible) AS eligible, any_value(success) AS success, max(baseline_n) AS baseline_n, round(max(reg), 6) AS worst_regression,
 coalesce(string_agg(metric, ',' ORDER BY i) FILTER (WHERE exceeded), '') AS exceeded_metrics, coalesce(string_agg(metric, ',' ORDER BY i) FILTER (WHERE exceeded AND gated), '') AS failing_metrics,
 CASE WHEN bool_or(exceeded AND gated) THEN 'fail' ELSE 'pass' END AS regression_status, CASE WHEN any_value(success) THEN 'pass' ELSE 'fail' END AS status FROM e GROUP BY 1, 2"""
_SHOWN = ["event_id", "run_source", "eligible", "success", "baseline_n"]


@query("agg04_latest_summary", f"WITH {_RUNS.format(source='')} {_SUMMARY}")
def agg04(spark, d, source=None):
    """AGG-04, AGG-03, SCL-03, SCL-05: the flagship: each cohort's last run against the median of the five
    eligible ones before it, metric by metric, with its lists, worst regression and status."""
    last, deltas = _deltas(spark, d, source)
    out = cohorts.latest_summary(last, deltas, _COHORT)
    return out.select(*_COHORT, *_SHOWN, F.round("worst_regression", 6).alias("worst_regression"), "exceeded_metrics", "failing_metrics", "regression_status", "status")


@query("agg04_latest_of_source", f"WITH {_RUNS.format(source=" WHERE run_source = 'pr'")} {_SUMMARY}")
def agg04_source(spark, d):
    """AGG-04 for one source: its last run of each cohort, against runs of every source before it."""
    return agg04(spark, d, "pr")


@query("agg04_metric_deltas", f"WITH {_RUNS.format(source='')} SELECT model_id, gpu_type, metric, round(current, 6) AS current, round(baseline, 6) AS baseline, baseline_n, round(reg, 6) AS regression_percent, round(delta, 6) AS absolute_delta, pct AS threshold_percent, least AS threshold_absolute, gated, exceeded, exceeded AND gated AS regressed FROM e")
def agg04_metrics(spark, d):
    """AGG-04, PRJ-02: the metrics behind each summary, in long form, with the thresholds that applied."""
    r6 = [F.round(c, 6).alias(c) for c in ("current", "baseline", "regression_percent", "absolute_delta")]
    return _deltas(spark, d)[1].select(*_COHORT, "metric", F.coalesce("baseline_n", F.lit(0)).alias("baseline_n"), *r6, "threshold_percent", "threshold_absolute", "gated", "exceeded", "regressed")


@query("agg01_cohort_sizes", """SELECT event_type, event_type <> 'error' AS success, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2""")
def agg01(spark, d):
    """AGG-01: runs by cohort."""
    return _records(spark, d).groupBy("event_type", "success").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("agg02_null_cohorts", "SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type, user_id % 2 AS half, count(*) AS n FROM events GROUP BY 1, 2")
def agg02(spark, d):
    """AGG-02: a null in the key is a cohort of its own."""
    return read(spark, d, "events").groupBy(F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"), (F.col("user_id") % 2).alias("half")).agg(F.count("*").alias("n"))


@query("agg03_median", "SELECT event_type, median(value) AS median_value, count(value) AS n FROM events GROUP BY 1")
def agg03(spark, d):
    """AGG-03: exact median of groups of any size, nulls left out."""
    return cohorts.group_quantiles(read(spark, d, "events").select("event_type", "value"), ["event_type"], "value", {"median_value": cohorts.linear(0.5)})


@query("agg05_trends", "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, event_id, ts, value FROM events")
def agg05(spark, d):
    """AGG-05: the points of each cohort in order, as rows with their positions."""
    return cohorts.trend_points(_records(spark, d).select("event_type", "event_id", "ts", "value"), ["event_type"], ["ts", "event_id"])


@query("agg06_status_counts", "SELECT count(*) FILTER (WHERE event_type <> 'error') AS n_pass, count(*) FILTER (WHERE event_type = 'error') AS n_fail FROM events")
def agg06(spark, d):
    """AGG-06."""
    return _records(spark, d).agg(F.count_if("success").alias("n_pass"), F.count_if(~F.col("success")).alias("n_fail"))


@query("win01_latest", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def win01(spark, d):
    """WIN-01."""
    return cohorts.latest(_records(spark, d), ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", "value")


@query("win02_rolling_baseline", """SELECT event_id, baseline_n, round(baseline, 6) AS baseline FROM (SELECT event_id, count(value) OVER w AS baseline_n, median(value) OVER w AS baseline FROM events WHERE event_type <> 'error'
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""")
def win02(spark, d):
    """WIN-02: for every successful run the median of the five before it."""
    r = cohorts.rolling_baseline(_records(spark, d).where("success"), ["event_type"], ["ts", "event_id"], "value", WINDOW)
    return r.select("event_id", "baseline_n", F.round("baseline", 6).alias("baseline"))


@query("win03_rolling_mean", "SELECT event_id, avg(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) / 100 AS mean_100 FROM events")
def win03(spark, d):
    """WIN-03: mean of the last hundred steps of each series."""
    e = read(spark, d, "events").select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("c"))
    return cohorts.rolling(e, ["event_type"], ["ts", "event_id"], 99, mean=lambda w: F.avg("c").over(w.rowsBetween(-99, 0))).select("event_id", (F.col("mean") / 100).alias("mean_100"))


@query("win04_gaps", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events")
def win04(spark, d):
    """WIN-04: microseconds since the session's event before."""
    e = read(spark, d, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return scans.previous(e, ["user_id"], ["ts", "event_id"], b=F.col("t")).select("event_id", (F.col("t") - F.col("b")).alias("gap_us"))


@query("scl03_delta", """SELECT o_orderkey, round(CASE WHEN o_totalprice > 0 THEN (b - o_totalprice) / o_totalprice * 100 END, 4) AS regression_percent,
coalesce(o_totalprice > 0 AND (b - o_totalprice) / o_totalprice * 100 > 8 AND b - o_totalprice > 0.5, false) AS exceeded FROM (SELECT o_orderkey, o_totalprice, sum(l_extendedprice) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
def scl03(spark, d):
    """SCL-03: order totals against the sum of their lines."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("b"))
    x = policy.delta(F.col("b"), F.col("o_totalprice"), F.lit("lower"), F.lit(8.0), F.lit(0.5))
    return read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.round(x["regression_percent"], 4).alias("regression_percent"), x["exceeded"].alias("exceeded"))


@query("scl04_policy", """SELECT * FROM (VALUES ('latency','lower',8.0::DOUBLE,0.5::DOUBLE),('throughput','higher',8.0,0.05),('memory','lower',5.0,256.0),('text_encoder_time_s','lower',5.0,0.25),('dit_time_s','lower',5.0,0.25),('vae_decode_time_s','lower',5.0,0.25)) t(metric, direction, threshold_percent, threshold_absolute)""")
def scl04(spark, d):
    """SCL-04."""
    return policy.policy_table(spark)


@query("scl05_resolved_policy", """SELECT event_id, CASE WHEN k % 7 = 0 THEN k::DOUBLE ELSE 8.0 END AS threshold_percent FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def scl05(spark, d):
    """SCL-05: a record's own threshold (here every seventh k) over the default."""
    k = F.col("k")
    return _records(spark, d).select("event_id", policy.resolve(F.when(k % 7 == 0, k.cast("double")), F.lit(8.0)).alias("threshold_percent"))


@query("scl01_tolerant_double", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 1.0 WHEN event_id % 5 = 2 THEN 0.0 ELSE value END AS x FROM events""")
def scl01(spark, d):
    """SCL-01: texts that are no number become null, booleans become 1 and 0."""
    m = F.col("event_id") % 5
    raw = F.when(m == 0, "n/a").when(m == 1, "True").when(m == 2, "false").otherwise(F.col("value").cast("string"))
    return read(spark, d, "events").select("event_id", policy.tolerant_double(raw).alias("x"))


@query("scl02_strict_double", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')::DOUBLE END AS x FROM events""")
def scl02(spark, d):
    """SCL-02: a JSON number counts, a boolean does not."""
    doc = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise('{"k": true}')
    return read(spark, d, "events").select("event_id", policy.strict_double(doc, "$.k").alias("x"))


@query("scl06_utc", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events""")
def scl06(spark, d):
    """SCL-06: ISO texts back to timestamps; bad ones are null."""
    text = F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return read(spark, d, "events").select("event_id", policy.utc_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("scl07_tolerant_bool", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS flag FROM events""")
def scl07(spark, d):
    """SCL-07."""
    raw = F.element_at(F.array(F.lit(" Yes"), F.lit("0"), F.lit("maybe"), F.lit("ON ")), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", policy.tolerant_bool(raw).alias("flag"))


@query("scl08_malformed_container", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 8 ELSE json_extract_string(props, '$.k')::INT END AS k FROM events""")
def scl08(spark, d):
    """SCL-08: a container that is no mapping gives the default."""
    doc = F.when(F.col("event_id") % 3 == 0, F.lit('[1, 2')).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", F.coalesce(F.from_json(doc, "k int")["k"], F.lit(8)).alias("k"))


@query("scl09_static_threshold", """SELECT event_type, metric, value FROM (SELECT event_type, unnest(['avg_value','max_value']) AS metric, unnest([avg(value), max(value)]) AS value FROM events GROUP BY 1) WHERE value > CASE metric WHEN 'avg_value' THEN 50 ELSE 350 END""".replace("metric, value FROM (", "metric, round(value, 6) AS value FROM ("))
def scl09(spark, d):
    """SCL-09: each metric above its fixed cap."""
    m = read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"))
    long = cohorts.unpivot_metrics(m, ["event_type"], ["avg_value", "max_value"])
    return long.where(F.col("value") > F.when(F.col("metric") == "avg_value", 50).otherwise(350)).select("event_type", "metric", F.round("value", 6).alias("value"))


_VERDICT = """CASE WHEN user_id IS NULL THEN 'IDENTITY_ERROR' WHEN user_id % 50 = 0 THEN 'RECIPE_MISMATCH' WHEN value > 200 THEN 'STATIC_FAIL' WHEN event_type = 'error' THEN 'INFRA_ERROR' WHEN k < 10 THEN 'CALIBRATION_NEEDED' WHEN value > 60 THEN 'REGRESSION' ELSE 'PASS' END"""


@query("scl10_verdicts", f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT} AS verdict FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)) GROUP BY 1")
def scl10(spark, d):
    """SCL-10: the first case in order names the verdict."""
    c = F.col
    verdict = policy.first_of([("IDENTITY_ERROR", c("user_id").isNull()), ("RECIPE_MISMATCH", c("user_id") % 50 == 0), ("STATIC_FAIL", c("value") > 200), ("INFRA_ERROR", ~c("success")), ("CALIBRATION_NEEDED", c("k") < 10), ("REGRESSION", c("value") > 60)], "PASS")
    return _records(spark, d).select(verdict.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("scl11_write_eligible", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' AND value <= 60 AND user_id % 4 = 0 GROUP BY 1")
def scl11(spark, d):
    """SCL-11: passed, from the scheduled branch, and successful."""
    return _records(spark, d).where(F.col("success") & (F.col("value") <= 60) & (F.col("user_id") % 4 == 0)).groupBy("event_type").agg(F.count("*").alias("n"))


_SOURCE = "CASE WHEN event_type = 'view' THEN 'local' WHEN user_id % 3 = 0 THEN 'pr' WHEN user_id % 3 = 1 THEN 'scheduled_main' ELSE 'unknown' END"


def _source(c=F.col):
    stated = policy.first_of([("local", c("event_type") == "view"), ("pr", c("user_id") % 3 == 0), ("scheduled_main", c("user_id") % 3 == 1)], "elsewhere")
    return F.when(stated.isin(*policy.RUN_SOURCES), stated).otherwise("unknown")


@query("scl12_run_source", f"SELECT run_source, count(*) AS n FROM (SELECT {_SOURCE} AS run_source FROM events) GROUP BY 1")
def scl12(spark, d):
    """SCL-12: a stated source, then the pull request, then the schedule."""
    return _records(spark, d).groupBy(_source().alias("run_source")).agg(F.count("*").alias("n"))


@query("flt09_known_domain", f"SELECT event_id, {_SOURCE} AS run_source FROM events")
def flt09(spark, d):
    """FLT-09: values outside the four known ones become unknown."""
    return _records(spark, d).select("event_id", _source().alias("run_source"))


@query("flt08_identity", "SELECT event_id FROM events WHERE user_id::VARCHAR = '7' AND event_type = 'view'")
def flt08(spark, d):
    """FLT-08: records of one identity; arguments that are not given do not filter."""
    return cohorts.filter_records(read(spark, d, "events"), user_id="7", event_type="view", props="").select("event_id")


@query("scl20_seed_records", "SELECT event_id, 'seed/main' AS branch, 'scheduled_main' AS run_source, true AS baseline_eligible, '' AS pr_number, 'baseline_seed' AS test_scope, substr(md5(event_id::VARCHAR), 1, 7) AS seeded_from, value AS latency FROM events WHERE event_type <> 'error'")
def scl20(spark, d):
    """SCL-20: copies of successful records with the provenance of a seed."""
    runs = _records(spark, d).where("success").select("event_id", F.col("value").alias("latency"), F.lit("pr/9").alias("branch"), F.lit("pr").alias("run_source"), F.lit("9").alias("pr_number"))
    return cohorts.seed_records(runs, F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 7), "seed/main").select("event_id", "branch", "run_source", "baseline_eligible", "pr_number", "test_scope", "seeded_from", "latency")


@query("prj01_provenance", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS branch, coalesce(nullif((user_id % 4)::VARCHAR, '0'), '') AS pr_number, '' AS build_url FROM events")
def prj01(spark, d):
    """PRJ-01: provenance fields, empty text where a record has none."""
    r = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("branch"), F.nullif((F.col("user_id") % 4).cast("string"), F.lit("0")).alias("pr_number"))
    return cohorts.with_defaults(r, ["branch", "pr_number", "build_url"])


@query("prj02_normalised_runs", "SELECT event_id, event_type AS model_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS latency, CASE WHEN event_id % 4 = 0 THEN true ELSE event_type <> 'error' END AS success FROM events")
def prj02(spark, d):
    """PRJ-02: raw records renamed, numbers parsed, success where nothing says otherwise."""
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    ok = F.when(F.col("event_id") % 4 != 0, F.col("event_type") != "error")
    return read(spark, d, "events").select("event_id", F.col("event_type").alias("model_id"), policy.tolerant_double(raw).alias("latency"), F.coalesce(ok, F.lit(True)).alias("success"))


@query("srt01_null_first", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END NULLS FIRST, sha1(event_id::VARCHAR)) - 1 AS pos FROM events")
def srt01(spark, d):
    """SRT-01: by time, undated rows first, ties by commit; positions over the whole table."""
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("ts"), F.sha1(F.col("event_id").cast("string").cast("binary")).alias("sha"))
    return joins.positions(e, ["ts", "sha"]).select("event_id", "pos")


@query("srt03_newest_first", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS pos FROM events")
def srt03(spark, d):
    """SRT-03: the newest first, over the whole table."""
    e = read(spark, d, "events").select("event_id", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("back"), (-F.col("event_id")).alias("i"))
    return joins.positions(e, ["back", "i"]).select("event_id", "pos")


@query("srt05_head_cycle", "SELECT i, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders), range(25) t(i) WHERE pos = i % 10")
def srt05(spark, d):
    """SRT-05: the first ten in order, going round until there are twenty-five requests."""
    top = read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    place = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1
    return spark.range(25).select(F.col("id").alias("i"), (F.col("id") % 10).alias("pos")).join(top.select("o_orderkey", place.alias("pos")), "pos").select("i", "o_orderkey")


@query("flt05_records", "SELECT event_id, ts, value FROM events WHERE event_type = 'purchase' AND user_id = 7")
def flt05(spark, d):
    """FLT-05: equality filters, in order of time."""
    return cohorts.filter_records(_records(spark, d), event_type="purchase", user_id=7, k=None, success=True).orderBy(F.col("ts").asc_nulls_first(), "event_id").select("event_id", "ts", "value")


@query("flt06_recent", "SELECT event_id FROM events WHERE event_id % 9 = 0 OR ts >= TIMESTAMP '2024-01-20'")
def flt06(spark, d):
    """FLT-06: recent rows and rows without a time (here every ninth)."""
    e = read(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 9 != 0, F.col("ts")))
    return cohorts.recent(e, "ts", "2024-01-20").select("event_id")


@query("flt07_eligible", "SELECT event_type, count(*) AS n FROM events WHERE user_id % 3 = 0 OR user_id % 3 = 2 GROUP BY 1")
def flt07(spark, d):
    """FLT-07: flagged true, or neither flag nor source."""
    m = F.col("user_id") % 3
    flag = F.when(m == 0, True).when(m == 1, False)
    source = F.when(m != 2, "scheduled_main")
    return read(spark, d, "events").where(cohorts.eligible_for_baseline(flag, source)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt10_recipe_mismatch", """SELECT count(*) AS n FROM events e JOIN (SELECT event_type, mode_k FROM (SELECT event_type, min(json_extract_string(props,'$.k')::INT) AS mode_k FROM events GROUP BY 1)) m USING (event_type) WHERE json_extract_string(props,'$.k')::INT <> mode_k AND event_type <> 'error'""")
def flt10(spark, d):
    """FLT-10: trusted runs of a cohort whose fingerprint is another."""
    r = _records(spark, d)
    own = r.groupBy("event_type").agg(F.min("k").alias("own"))
    return r.join(own, "event_type").where("success and k <> own").agg(F.count("*").alias("n"))


@query("flt17_valid_measurements", "SELECT event_type, count(*) AS n FROM events WHERE value > 0 AND isfinite(value) AND (event_id % 4 = 0 OR json_extract_string(props,'$.k')::INT >= 0) GROUP BY 1")
def flt17(spark, d):
    """FLT-17: core metrics finite and above zero, others finite and not below zero, or null."""
    r = _records(spark, d).withColumn("k", F.when(F.col("event_id") % 4 != 0, F.col("k")))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    core = finite(F.col("value")) & (F.col("value") > 0)
    return r.where(core & (F.col("k").isNull() | (F.col("k") >= 0))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt18_calibration_gate", "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'not successful' WHEN user_id % 5 = 0 THEN 'pull request' WHEN json_extract_string(props,'$.k')::INT > 90 THEN 'wrong scope' WHEN value <= 1 THEN 'no measurement' END AS reason FROM events) GROUP BY 1")
def flt18(spark, d):
    """FLT-18: the first failed condition, in order."""
    c = F.col
    reason = policy.first_of([("not successful", ~c("success")), ("pull request", c("user_id") % 5 == 0), ("wrong scope", c("k") > 90), ("no measurement", c("value") <= 1)], "accepted")
    return _records(spark, d).select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("flt19_same_identity", "SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) = 1 AS same FROM orders GROUP BY 1")
def flt19(spark, d):
    """FLT-19: whether all rows of a batch (a customer's orders) have one identity."""
    identity = F.struct("o_orderstatus", "o_orderpriority")
    return read(spark, d, "orders").groupBy("o_custkey").agg((F.min(identity) == F.max(identity)).alias("same"))


@query("prj04_normalised", "SELECT event_id, substr(md5(event_id::VARCHAR), 1, 7) AS config_id, coalesce(nullif(event_type, 'view'), '') AS branch FROM events")
def prj04(spark, d):
    """PRJ-04: short commit, empty text for what is missing."""
    e = read(spark, d, "events")
    return e.select("event_id", F.substring(F.coalesce(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit("unknown")), 1, 7).alias("config_id"), F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("")).alias("branch"))


@query("prj03_nested_fallback", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'k' || json_extract_string(props, '$.k') END AS workload FROM events")
def prj03(spark, d):
    """PRJ-03, HSH-06: a top-level label, else the one nested in the recipe."""
    top = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id")))
    return read(spark, d, "events").select("event_id", F.coalesce(top, F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("workload"))


@query("srt02_fail_first", "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type <> 'error', event_type, event_id) AS pos FROM events QUALIFY pos <= 50")
def srt02(spark, d):
    """SRT-02: failures first, then by key; the first fifty."""
    top = read(spark, d, "events").orderBy(F.col("event_type") != "error", "event_type", "event_id").limit(50)
    w = Window.orderBy(F.col("event_type") != "error", "event_type", "event_id")
    return top.select("event_id", "event_type", F.row_number().over(w).cast("bigint").alias("pos"))


@query("srt04_tail", "SELECT event_id, ts FROM (SELECT * FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20)")
def srt04(spark, d):
    """SRT-04: the last twenty after the filters, in order of time."""
    return read(spark, d, "events").where("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).orderBy("ts", "event_id").select("event_id", "ts")


@query("srt08_undated_last", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END NULLS LAST, event_id) AS pos FROM events")
def srt08(spark, d):
    """SRT-08: by time, undated rows after them in the order of input; over the whole table."""
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("at"))
    return joins.positions(e.withColumn("undated", F.col("at").isNull()), ["undated", "at", "event_id"]).select("event_id", (F.col("pos") + 1).alias("pos"))
