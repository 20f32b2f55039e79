"""Reports and comparisons with the whole of their rules; ``events`` by user are sessions or series, ``embeddings``
frames or flow fields of 8 by 4 points."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import evaluation as ev
from tessera.operators import filters, flow, reports, scans
from tessera.plans.registry import query, read

_E = "list_transform(embedding, lambda x: x::DOUBLE)"


def _flows(spark, d):
    """Points of each vector (truth) and the one after it (generated): frame, i, u, v, gu, gv."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("e"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("g")), "vec_id")
    at = lambda c, k: F.get(F.col(c), F.col("i") * 2 + k)
    rows = both.select("vec_id", "e", "g", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    return rows.select("vec_id", "i", at("e", 0).alias("u"), at("e", 1).alias("v"), at("g", 0).alias("gu"), at("g", 1).alias("gv"))


_FLOWS = f"f AS (SELECT vec_id, {_E} AS e FROM embeddings), x AS (SELECT a.vec_id, i, a.e[2 * i + 1] * 8 AS u, a.e[2 * i + 2] * 8 AS v, b.e[2 * i + 1] * 8 AS gu, b.e[2 * i + 2] * 8 AS gv FROM f a JOIN f b ON b.vec_id = a.vec_id + 1, range(32) t(i))"


@query("agg34_flow_divergence", f"""WITH {_FLOWS}, s AS (SELECT vec_id, 'a' AS side, u, v FROM x UNION ALL SELECT vec_id, 'b', gu, gv FROM x),
m AS (SELECT vec_id, side, sqrt(u * u + v * v) AS m, CASE WHEN degrees(atan2(v, u)) < 0 THEN degrees(atan2(v, u)) + 360 ELSE degrees(atan2(v, u)) END AS angle FROM s), k AS (SELECT * FROM m WHERE m >= 0.5),
t AS (SELECT vec_id, side, count(*) AS n, greatest(max(m), 1.5) AS top FROM k GROUP BY 1, 2),
c AS (SELECT vec_id, side, least(floor(angle / 10), 35) * 20 + least(floor(log10(m / 0.5) / log10(top / 0.5) * 20), 19) AS cell, count(*) AS h FROM k JOIN t USING (vec_id, side) GROUP BY 1, 2, 3),
g AS (SELECT vec_id, cell, sum(h) FILTER (WHERE side = 'a') AS a, sum(h) FILTER (WHERE side = 'b') AS b FROM (SELECT * FROM c UNION ALL SELECT DISTINCT vec_id, 'none', cell::DOUBLE, 0 FROM x, range(720) r(cell)) GROUP BY 1, 2),
n AS (SELECT vec_id, coalesce(max(n) FILTER (WHERE side = 'a'), 0) AS na, coalesce(max(n) FILTER (WHERE side = 'b'), 0) AS nb FROM t GROUP BY 1),
p AS (SELECT vec_id, (coalesce(a, 0) + 1) / (na + 720)::DOUBLE AS p, (coalesce(b, 0) + 1) / (nb + 720)::DOUBLE AS q, na, nb FROM g JOIN n USING (vec_id)),
o AS (SELECT vec_id, CASE WHEN min(na) < 10 OR min(nb) < 10 THEN 0 ELSE sum(p * ln(p / q)) END AS kl FROM p GROUP BY 1) SELECT w.vec_id, round(coalesce(kl, 0), 6) + 0.0::DOUBLE AS kl FROM (SELECT DISTINCT vec_id FROM x) w LEFT JOIN o USING (vec_id)""")
def agg34_flow(spark, d):
    """AGG-34: divergence of the joint histograms of angle and magnitude, edges by each side's own largest."""
    x = _flows(spark, d)
    sides = x.select("vec_id", F.lit("a").alias("side"), "u", "v").unionByName(x.select("vec_id", F.lit("b").alias("side"), F.col("gu").alias("u"), F.col("gv").alias("v")))
    return flow.flow_divergence(sides, "vec_id").select("vec_id", (F.round("kl", 6) + F.lit(0.0)).alias("kl"))


@query("agg35_flow_errors", f"""WITH {_FLOWS}, m AS (SELECT *, greatest(sqrt(u * u + v * v), sqrt(gu * gu + gv * gv)) AS top, sqrt(u * u + v * v) AS mag, sqrt((u - gu) ** 2 + (v - gv) ** 2) AS e, (i // 8 // 2) * 2 + (i % 8) // 4 AS cell FROM x),
h AS (SELECT vec_id, quantile_cont(top, 0.8) AS hi FROM m GROUP BY 1), k AS (SELECT m.*, top >= 0.5 AND top <= hi AS ok FROM m JOIN h USING (vec_id)),
c AS (SELECT vec_id, cell, CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN avg(e) FILTER (WHERE ok) ELSE avg(e) END AS mean FROM k GROUP BY 1, 2),
f1 AS (SELECT vec_id, count(*) FILTER (WHERE ok) AS n_valid, CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN avg(e) FILTER (WHERE ok) ELSE avg(e) END AS em, CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN max(e) FILTER (WHERE ok) ELSE max(e) END AS ex,
CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN count(*) FILTER (WHERE ok AND e > 3 AND e > 0.05 * mag) / count(*) FILTER (WHERE ok) ELSE count(*) FILTER (WHERE e > 3 AND e > 0.05 * mag) / count(*) END AS fl,
{", ".join(f"CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN avg({c}) FILTER (WHERE ok) ELSE avg({c}) END AS m_{c}" for c in ("u", "v", "gu", "gv"))} FROM k GROUP BY 1),
a AS (SELECT *, sqrt(m_u * m_u + m_v * m_v) AS a, sqrt(m_gu * m_gu + m_gv * m_gv) AS b, greatest(-1, least(1, (m_u * m_gu + m_v * m_gv) / nullif(sqrt(m_u * m_u + m_v * m_v) * sqrt(m_gu * m_gu + m_gv * m_gv), 0))) AS cos FROM f1)
SELECT vec_id, n_valid, round(sqrt((m_u - m_gu) ** 2 + (m_v - m_gv) ** 2), 6) AS mf_epe, round(CASE WHEN a < 0.1 AND b < 0.1 THEN 0 WHEN a < 0.1 OR b < 0.1 THEN 90 ELSE degrees(acos(cos)) END, 4) AS mf_angle_err, round(CASE WHEN a < 0.1 AND b < 0.1 THEN 1 WHEN a < 0.1 OR b < 0.1 THEN 0 ELSE cos END, 6) AS mf_cosine,
round(em, 6) AS pixel_epe_mean, round(ex, 6) AS pixel_epe_max, round(g.gm, 6) AS grid_epe_mean, round(g.gx, 6) AS grid_epe_max, round(fl, 6) AS fl_all FROM a JOIN (SELECT vec_id, avg(mean) AS gm, max(mean) AS gx FROM c GROUP BY 1) g USING (vec_id)""")
def agg35_flow(spark, d):
    """AGG-35: masked errors of each frame, by cells of its grid too."""
    x = _flows(spark, d)
    cell = flow.grid_cell(F.col("i") % 8, F.floor(F.col("i") / 8), 8, 4, 2)
    got = flow.flow_errors(x, "vec_id", cell)
    return got.select("vec_id", "n_valid", *[F.round(c, 4 if c == "mf_angle_err" else 6).alias(c) for c in got.columns[2:]])


@query("agg11_stress_report", """WITH e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000::DOUBLE AS gap FROM events),
s AS (SELECT user_id, arg_max(event_type, (us, event_id)) AS last, CASE WHEN user_id % 3 > 0 THEN bool_or(value > 150) END AS pr FROM e GROUP BY 1), b AS (SELECT sum(round(value * 100)::BIGINT) * 8 / 1e6 AS mbps FROM e WHERE round(value * 100) > 0 GROUP BY us // 1000000),
c AS (SELECT count(gap) AS gaps, min(gap) AS gap_min, max(gap) AS gap_max, avg(gap) AS gap_avg, quantile_cont(gap, 0.5) AS p50, quantile_cont(gap, 0.95) AS p95, quantile_cont(gap, 0.99) AS p99, count(*) FILTER (WHERE gap >= 90000000) AS breaches, sum(round(value * 100)::BIGINT) AS bytes, (max(us) FILTER (WHERE round(value * 100) > 0) - min(us) FILTER (WHERE round(value * 100) > 0)) / 1000000::DOUBLE AS span FROM e)
SELECT (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM s WHERE last = 'purchase') AS success, (SELECT count(*) FROM s WHERE last = 'error') AS failed, (SELECT count(*) FROM s WHERE last = 'click') AS timeout, (SELECT count(*) FROM s WHERE last = 'view') AS protocol_error, (SELECT count(*) FROM s WHERE last = 'signup') AS other,
gaps, round(gap_min, 3) AS gap_min, round(p50, 3) AS gap_p50, round(p95, 3) AS gap_p95, round(p99, 3) AS gap_p99, round(gap_max, 3) AS gap_max, round(gap_avg, 3) AS gap_avg, breaches, (SELECT count(pr) FROM s) AS eligible, (SELECT count(*) FILTER (WHERE pr) FROM s) AS progressive, round((SELECT count(*) FILTER (WHERE pr) / count(pr) FROM s), 6) AS progressive_ratio,
round(bytes * 8 / span / 1e6, 9) AS goodput_mbps, (SELECT count(*) FROM b) AS buckets, round((SELECT avg(mbps) FROM b), 6) AS bucket_avg, round((SELECT max(mbps) FROM b), 6) AS bucket_peak, false AS passed,
(SELECT count(*) FROM s WHERE last <> 'purchase') || ' session(s) did not succeed' || CASE WHEN breaches > 0 THEN '; ' || breaches || ' chunk gap(s) at the threshold or over' ELSE '' END AS reasons FROM c""")
def agg11_stress(spark, d):
    """AGG-11: users as sessions, their events as chunks."""
    e = read(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    c = scans.previous(e, ["user_id"], ["ts", "event_id"], b=F.col("us"))
    chunks = c.select(((F.col("us") - F.col("b")) / 1000).alias("gap_ms"), (F.col("us") / 1000000).alias("finish"), F.round(F.col("value") * 100).cast("bigint").alias("size_bytes"))
    last = F.max_by("event_type", F.struct("us", "event_id"))
    status = F.create_map(*map(F.lit, ("purchase", "success", "error", "failed", "click", "timeout", "view", "protocol_error")))
    s = e.groupBy("user_id").agg(last.alias("last"), F.bool_or(F.col("value") > 150).alias("p"))
    sessions = s.select(F.coalesce(F.try_element_at(status, F.col("last")), "last").alias("status"), F.when(F.col("user_id") % 3 > 0, F.col("p")).alias("progressive"))
    r = reports.stress_report(sessions, chunks, 90_000_000.0)
    digits = {"progressive_ratio": 6, "goodput_mbps": 9, "bucket_avg": 6, "bucket_peak": 6} | {f"gap_{x}": 3 for x in ("min", "p50", "p95", "p99", "max", "avg")}
    return r.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in r.columns])


@query("agg32_directions", """WITH v AS (SELECT event_type AS batch, event_id, 'latency' AS metric, value FROM events UNION ALL SELECT event_type, event_id, 'throughput', user_id::DOUBLE FROM events UNION ALL SELECT event_type, event_id, 'memory', CASE WHEN event_type = 'view' THEN -value WHEN event_type = 'error' AND event_id > (SELECT min(event_id) FROM events WHERE event_type = 'error') THEN NULL ELSE value + 900 END FROM events),
m AS (SELECT batch, metric, count(value) AS n, median(value) AS median FROM v WHERE value IS NOT NULL GROUP BY 1, 2), o AS (SELECT v.batch, v.metric, event_id, CASE WHEN v.metric = 'throughput' THEN median - value ELSE value - median END / CASE WHEN median > 0 THEN median END AS off FROM v JOIN m ON m.batch = v.batch AND m.metric = v.metric WHERE value IS NOT NULL),
w AS (SELECT batch, metric, max(off) AS regression, arg_max(event_id, (off, -event_id)) AS worst FROM o GROUP BY 1, 2), r AS (SELECT *, CASE WHEN n < 2 THEN 'skipped' WHEN median <= 0 THEN 'invalid' WHEN regression > 0.9 THEN 'fail' ELSE 'pass' END AS verdict FROM m JOIN w USING (batch, metric))
SELECT batch, metric, n, round(median, 6) AS median, CASE WHEN verdict IN ('pass', 'fail') THEN worst END AS worst, round(CASE WHEN verdict IN ('pass', 'fail') THEN regression END, 6) AS regression, verdict FROM r""")
def agg32_directions(spark, d):
    """AGG-32: members against their batch's median, by the metric's direction, with the guards."""
    e = read(spark, d, "events")
    first = e.where("event_type = 'error'").agg(F.min("event_id")).first()[0]
    memory = F.when(F.col("event_type") == "view", -F.col("value")).when((F.col("event_type") == "error") & (F.col("event_id") > first), F.lit(None)).otherwise(F.col("value") + 900)
    v = e.select(F.col("event_type").alias("batch"), "event_id", F.col("value").alias("latency"), F.col("user_id").cast("double").alias("throughput"), memory.alias("memory")).unpivot(["batch", "event_id"], ["latency", "throughput", "memory"], "metric", "value")
    r = reports.batch_consistency(v, ["batch", "metric"], "event_id", F.col("metric") != "throughput", 0.9)
    return r.withColumns({c: F.round(c, 6) for c in ("median", "regression")})


@query("agg28_keys", """WITH r AS (SELECT doc_id, source || '/' || n_chars AS path, text, CASE WHEN doc_id % 3 = 0 THEN 'job:' || (doc_id // 6) WHEN doc_id % 3 = 1 THEN 'build:' || (doc_id % 50) WHEN lang <> 'en' THEN 'commit:' || lang || n_chars END AS prov FROM documents),
k AS (SELECT doc_id, 'path' AS kind, path AS key FROM r UNION ALL SELECT doc_id, 'content', sha256(text) FROM r UNION ALL SELECT doc_id, 'provenance', prov FROM r) SELECT kind, key, count(*) AS n, min(doc_id) AS first FROM k WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def agg28_keys(spark, d):
    """AGG-28: duplicates by path, by content and by the first provenance key that a record has."""
    i = F.col("doc_id")
    provenance = [("job", F.when(i % 3 == 0, F.floor(i / 6).cast("string"))), ("build", F.when(i % 3 == 1, (i % 50).cast("string"))), ("commit", F.when(F.col("lang") != "en", F.concat("lang", F.col("n_chars").cast("string"))))]
    return reports.duplicate_sources(read(spark, d, "documents"), "doc_id", F.concat_ws("/", "source", F.col("n_chars").cast("string")), F.col("text"), provenance)


@query("agg26_filter_histogram", """WITH s AS (SELECT CASE WHEN n_chars < 200 THEN 'too_short' WHEN contains(text, 'http') THEN 'links' END AS r, (n_chars % 90)::VARCHAR AS m FROM documents)
SELECT 'before' AS kind, '' AS key, count(*) AS n FROM s UNION ALL SELECT 'after', '', count(*) FILTER (WHERE r IS NULL) FROM s UNION ALL SELECT 'refused', r, count(*) FROM s WHERE r IS NOT NULL GROUP BY 2 UNION ALL SELECT 'measure', m, count(*) FROM s WHERE r IS NULL GROUP BY 2""")
def agg26_histogram(spark, d):
    """AGG-26: what each filter refused and how many frames the kept samples have."""
    stages = [("too_short", F.col("n_chars") >= 200), ("links", ~F.contains("text", F.lit("http")))]
    return reports.filter_statistics(read(spark, d, "documents"), stages, F.col("n_chars") % 90)


@query("agg36_compared", """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM events GROUP BY user_id)),
p AS (SELECT i, avg(value) AS a, avg(value * value / 100) AS b, avg(value + user_id) AS reference FROM s, m WHERE i < m.n GROUP BY 1) SELECT i >= 5 AS judged, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round((avg(b) - avg(a)) / avg(a) * 100, 4) AS change_percent, round(avg(a) / avg(reference), 6) AS rate_a, round(avg(b) / avg(reference), 6) AS rate_b FROM p GROUP BY 1""")
def agg36_compared(spark, d):
    """AGG-36: two curves before and after the boundary, and their rates against the reference."""
    v = F.col("value")
    s = read(spark, d, "events").select("user_id", "ts", "event_id", v.alias("a"), (v * v / 100).alias("b"), (v + F.col("user_id")).alias("reference"))
    r = reports.compared_series(s, "user_id", ["ts", "event_id"], 5)
    return r.select("judged", "n", *[F.round(c, 4 if c == "change_percent" else 6).alias(c) for c in r.columns[2:]])


@query("agg17_corpus_score", f"""WITH e AS (SELECT label, {_E} AS e, 3 + (vec_id % 7)::INT AS n FROM embeddings), m AS (SELECT label, sum(list_sum(list_transform(e[1:n], lambda x: x * x))) / sum(n) AS mse, sum(list_sum(list_transform(e[11:10 + n], lambda x: abs(x)))) / sum(n) AS st, sum(list_sum(list_transform(e[21:20 + n], lambda x: x * x))) / sum(n) AS pv_mse, sum(list_sum(list_transform(e[31:32 + n], lambda x: 1.5 * abs(x)))) / sum(n + 2) AS pv_st,
avg(abs(e[50])) AS s, avg(abs(e[51])) AS ws, avg(2 * abs(e[52])) AS pv_s, avg(2 * abs(e[53])) AS pv_ws FROM e GROUP BY 1) SELECT label, round(greatest(least(100 * ((st / pv_st + s / pv_s + ws / pv_ws) / 3 - (mse - pv_mse)), 100), 0), 2) AS score, round(mse, 6) AS mse, round(st, 6) AS st FROM m""")
def agg17_score(spark, d):
    """AGG-17: lists of frames of differing lengths, row values beside them."""
    e, n = F.transform("embedding", lambda x: x.cast("double")), (F.col("vec_id") % 7 + 3).cast("int")
    part = lambda start, f, more=0: F.transform(F.slice(e, F.lit(start), n + more), f)
    one = lambda i, k=1: k * F.abs(F.get(e, F.lit(i)))
    rows = read(spark, d, "embeddings").select("label", part(1, lambda x: x * x).alias("mse"), part(11, F.abs).alias("st"), part(21, lambda x: x * x).alias("pv_mse"), part(31, lambda x: 1.5 * F.abs(x), 2).alias("pv_st"), one(49).alias("s"), one(50).alias("ws"), one(51, 2).alias("pv_s"), one(52, 2).alias("pv_ws"))
    return reports.corpus_score(rows, ["label"]).select("label", "score", F.round("mse", 6).alias("mse"), F.round("st", 6).alias("st"))


@query("agg23_onset", """WITH s AS (SELECT user_id, round(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, least(5, count(*) OVER (PARTITION BY user_id)) AS w FROM events), h AS (SELECT user_id, greatest(2 * median(v), 1) AS threshold FROM s WHERE i < 5 GROUP BY 1),
m AS (SELECT user_id, i - w + 1 AS i, w, avg(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, i >= w - 1 AS whole FROM s) SELECT h.user_id, threshold::DOUBLE AS threshold, min(i) FILTER (WHERE whole AND m > threshold) AS onset FROM h JOIN m USING (user_id) GROUP BY 1, 2""")
def agg23_onset(spark, d):
    """AGG-23: where a curve's moving mean first passes twice its beginning."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return reports.temporal_onset(e, "user_id", ["ts", "event_id"], "v")


@query("agg10_components", "SELECT l_suppkey, count(*) AS runs, round(avg(l_quantity), 3) AS avg_time, round(121 / avg(l_quantity), 3) AS fps, round(max(l_extendedprice), 1) AS peak_memory, round(avg(CASE WHEN l_linenumber > 2 THEN l_tax END), 3) AS text_encoder_avg, round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 3) AS dit_avg, NULL::DOUBLE AS vae_avg FROM lineitem GROUP BY 1")
def agg10_components(spark, d):
    """AGG-10: a record with the means of its components, null for one that no run measured."""
    li = read(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("text_encoder"), F.when(F.col("l_returnflag") == "R", F.col("l_discount")).alias("dit"), F.lit(None).cast("double").alias("vae"))
    return reports.benchmark_record(li, ["l_suppkey"], "l_quantity", "l_extendedprice", 121, ["text_encoder", "dit", "vae"])


@query("join20_base_report", """WITH b AS (SELECT p_partkey AS k, CASE WHEN p_size = 7 THEN 0 ELSE p_retailprice END AS n FROM part WHERE p_size % 5 <> 0), r AS (SELECT p_partkey AS k, p_size + p_partkey / 100.0::DOUBLE AS x FROM part), m AS (SELECT k, x, n, CASE WHEN n > 1e-12 THEN x / n ELSE 'inf'::DOUBLE END AS q FROM r JOIN b USING (k))
SELECT 'largest' AS part, k::VARCHAR AS key, round(q, 9) AS value FROM (SELECT * FROM m ORDER BY q DESC, k DESC LIMIT 12) UNION ALL SELECT 'smallest', k::VARCHAR, round(q, 9) FROM (SELECT * FROM m ORDER BY q, k LIMIT 1) UNION ALL SELECT 'unmatched', k::VARCHAR, NULL FROM r WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT 'total', 'base', round(sqrt(sum(n * n)), 6) FROM m UNION ALL SELECT 'total', 'rows', round(sqrt(sum(x * x)), 6) FROM m UNION ALL SELECT 'total', 'matched', count(*) FROM m""")
def join20_report(spark, d):
    """JOIN-20: ratios to the base, what has none, and the norms of the whole."""
    p = read(spark, d, "part")
    base = p.where("p_size % 5 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") == 7, 0.0).otherwise(F.col("p_retailprice")).alias("n"))
    rows = p.select(F.col("p_partkey").alias("k"), (F.col("p_size") + F.col("p_partkey") / 100.0).alias("x"))
    r = reports.base_ratios(rows, base, "k", "x", "n", 12)
    return r.withColumn("value", F.when(F.col("part") == "total", F.round("value", 6)).otherwise(F.round("value", 9)))


@query("arr10_clip_masks", f"""WITH m AS (SELECT label, i, (embedding[i + 1] > 0.3)::INT AS a, (embedding[64 - i] > 0.3)::INT AS b FROM embeddings, range(64) t(i)), p AS (SELECT label, i, max(a) AS xa, max(b) AS xb, sum(a) AS a, sum(b) AS b FROM m GROUP BY 1, 2)
SELECT label, round(coalesce(sum(least(xa, xb)) / nullif(sum(greatest(xa, xb)), 0), 1), 6) AS spatial_iou, round(coalesce(sum(least(a, b)) / nullif(sum(greatest(a, b)), 0), 1), 6) AS weighted_spatial_iou FROM p GROUP BY 1""")
def arr10_clips(spark, d):
    """ARR-10: a label's vectors as the frames of a clip: where masks ever agree, and how often."""
    mask = lambda v: F.transform(v, lambda x: (x > 0.3).cast("int"))
    e = read(spark, d, "embeddings").select("label", mask(F.col("embedding")).alias("a"), mask(F.reverse("embedding")).alias("b"))
    return ev.spatial_masks(e, "label", "a", "b").select("label", F.round("spatial_iou", 6).alias("spatial_iou"), F.round("weighted_spatial_iou", 6).alias("weighted_spatial_iou"))


@query("arr13_correlation", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 1.0 ELSE embedding[i + 1]::DOUBLE END AS v, i FROM embeddings, range(64) t(i)), b AS (SELECT vec_id, (i % 9) // 3 AS x, (i // 9) // 3 AS y, avg(v) AS m FROM e WHERE i // 9 < 6 GROUP BY 1, 2, 3),
p AS (SELECT a.vec_id, a.m AS a, b.m AS b FROM b a JOIN b ON b.vec_id = a.vec_id + 1 AND b.x = a.x AND b.y = a.y) SELECT vec_id, CASE WHEN min(a) = max(a) OR min(b) = max(b) THEN 'nan'::DOUBLE ELSE round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 5) + 0.0::DOUBLE END AS r FROM p GROUP BY 1""")
def arr13_correlation(spark, d):
    """ARR-13: neighbouring vectors as frames of 9 by 7, means of 3 by 3, correlated; constant ones are NaN."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 9 == 0, 1.0).otherwise(x.cast("double"))).alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return ev.block_correlation(both, "vec_id", "a", "b", 9, 7, 3).select("vec_id", (F.round("r", 5) + F.lit(0.0)).alias("r"))


@query("udf01_reasons", "SELECT doc_id, 'text.caps' AS metric, CASE WHEN n_chars >= 100 AND lang <> 'fr' THEN len(regexp_extract_all(text, '[A-Z]')) / length(text)::DOUBLE END AS score, CASE WHEN lang = 'fr' THEN 'wrong language' WHEN n_chars < 100 THEN 'too short' END AS reason FROM documents UNION ALL SELECT doc_id, 'media.rate', CASE WHEN n_chars > 1000 THEN n_chars / 24.0::DOUBLE END, CASE WHEN n_chars <= 1000 THEN 'no score' END FROM documents")
def udf01_reasons(spark, d):
    """UDF-01: a score, or why there is none."""
    why = lambda: F.when(F.col("lang") == "fr", "wrong language").when(F.col("n_chars") < 100, "too short")
    caps = ev.Metric("text.caps", lambda: F.regexp_count("text", F.lit("[A-Z]")) / F.length("text"), skipped=why)
    return ev.explained_rows(read(spark, d, "documents"), ["doc_id"], [caps, *ev.resolve("media.rate")])


@query("udf08_classifier", "SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'unsafe' ELSE 'safe' END AS label, round(least(len(string_split(text, ' ')) / 200.0::DOUBLE, 1), 6) AS score, CASE WHEN regexp_matches(text, '[0-9]{4}') AND least(len(string_split(text, ' ')) / 200.0::DOUBLE, 1) >= 0.5 THEN 'BLOCK' ELSE 'ALLOW' END AS decision FROM documents")
def udf08_classifier(spark, d):
    """UDF-08: a classifier of the user's by its seam: whole texts in, labels and scores out."""
    digits = re.compile("[0-9]{4}")

    def classify(texts: list[str]) -> list[tuple[str, float]]:
        return [("unsafe" if digits.search(t) else "safe", min(1.0, len(re.split(" ", t)) / 200)) for t in texts]

    r = filters.classified(read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("_")).alias("text")), "text", classify, 0.5)
    return r.select("doc_id", "label", F.round("score", 6).alias("score"), "decision")


@query("snk10_table", """SELECT 0::BIGINT AS pos, '## Suppliers' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| Name | Balance | Nation |' UNION ALL SELECT 3, '|---|---:|---|'
UNION ALL SELECT 3 + row_number() OVER (ORDER BY s_suppkey), '| ' || replace(s_name, '#', '\\|') || ' | ' || printf('%.2f', s_acctbal) || ' | ' || coalesce(n_name, 'n/a') || ' |' FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 2) ON n_nationkey = s_nationkey""")
def snk10(spark, d):
    """SNK-10: the whole table as Markdown, cells escaped, numbers to the right."""
    n = read(spark, d, "nation").where("n_nationkey > 2")
    s = read(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    columns = {"Name": text.markdown_cell(F.replace("s_name", F.lit("#"), F.lit("|"))), "Balance": F.format_string("%.2f", "s_acctbal"), "Nation": text.markdown_cell(F.col("n_name"))}
    return reports.markdown_table(s, ["s_suppkey"], columns, {"Balance"}, "Suppliers")
