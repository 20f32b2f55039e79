"""Tensor, vector and evaluation queries; ``embeddings`` by label stands for the frames of a clip."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import arrays
from tessera.operators import cohorts, corpus_metrics, joins, scans
from tessera.operators import evaluation as ev
from tessera.plans.registry import query, read

ev.register(ev.Metric("text.length", lambda: F.length("text")))
ev.register(ev.Metric("text.lines", lambda: F.size(F.split("text", "\n"))))
ev.register(ev.Metric("media.rate", lambda: F.when(F.col("n_chars") > 1000, F.col("n_chars") / 24.0), F.max))


def _frames(spark, d):
    return read(spark, d, "embeddings")


_COS = "list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform({o}, lambda x: x::DOUBLE))"


@query("udf01_row_metrics", "SELECT doc_id, 'text.length' AS metric, length(text)::DOUBLE AS score, false AS skipped FROM documents UNION ALL SELECT doc_id, 'text.lines', len(string_split(text, chr(10)))::DOUBLE, false FROM documents UNION ALL SELECT doc_id, 'media.rate', CASE WHEN n_chars > 1000 THEN n_chars / 24.0::DOUBLE END, n_chars <= 1000 FROM documents")
def udf01(spark, d):
    """UDF-01: every registered metric per row, skipped rows with null scores."""
    return ev.evaluate_rows(read(spark, d, "documents"), ["doc_id"], ev.resolve("all"))


@query("udf02_corpus_metrics", "SELECT lang, avg(length(text)) AS text_length, avg(len(string_split(text, chr(10)))) AS text_lines, max(CASE WHEN n_chars > 1000 THEN n_chars / 24.0::DOUBLE END) AS media_rate FROM documents GROUP BY 1")
def udf02(spark, d):
    """UDF-02: metrics reduced over the corpus."""
    return ev.evaluate_corpus(read(spark, d, "documents"), ["lang"], ev.resolve(["text", "media.rate"]))


@query("udf02_kendall", """WITH t AS (SELECT l_returnflag AS g, l_linenumber AS x, l_quantity AS y, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT a.g, sum(a.n * b.n * sign(b.y - a.y)) AS s FROM t a JOIN t b ON a.g = b.g AND b.x > a.x GROUP BY 1),
n AS (SELECT g, sum(n) AS n FROM t GROUP BY 1), tx AS (SELECT g, sum(c * (c - 1) / 2) AS t FROM (SELECT g, x, sum(n) AS c FROM t GROUP BY 1, 2) GROUP BY 1), ty AS (SELECT g, sum(c * (c - 1) / 2) AS t FROM (SELECT g, y, sum(n) AS c FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT g AS l_returnflag, 'ratings.kendall' AS metric, round(s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 9) AS score, NULL::VARCHAR AS skipped FROM s JOIN n USING (g) JOIN tx USING (g) JOIN ty USING (g)""")
def udf02_kendall(spark, d):
    """UDF-02: a metric with states of its own, accumulated a task, merged in rounds, finalized."""
    got = corpus_metrics.evaluate_states(read(spark, d, "lineitem"), ["l_returnflag"], [corpus_metrics.RankCorrelation("l_linenumber", "l_quantity")])
    return got.withColumn("score", F.round("score", 9))


@query("udf02_effective_rank")
def udf02_rank(spark, d):
    """UDF-02: in how many directions the vectors of each label spread."""
    got = corpus_metrics.evaluate_states(_frames(spark, d), ["label"], [corpus_metrics.EffectiveRank("embedding")])
    return got.withColumn("score", F.round("score", 6))


@query("udf07_fan_out", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS prompt, unnest(range(len(string_split(p_name, ' '))))::INT AS i FROM part")
def udf07(spark, d):
    """UDF-07: one row for each prompt of a list, with its number."""
    return read(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "prompt"))


@query("udf09_cached_verdict", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'win' ELSE 'loss' END, 'ask') AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)".replace("coalesce(CASE WHEN l.quality = 1 THEN 'win' ELSE 'loss' END, 'ask')", "CASE WHEN l.doc_id IS NULL THEN 'ask' WHEN l.quality = 1 THEN 'win' ELSE 'loss' END"))
def udf09(spark, d):
    """UDF-09: a judge's cached verdicts; the rest is to be asked."""
    cache = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "win").otherwise("loss").alias("v"))
    return read(spark, d, "documents").join(cache, "doc_id", "left").select("doc_id", F.coalesce("v", F.lit("ask")).alias("verdict"))


@query("arr01_round_trip", "SELECT vec_id, len(embedding) AS n, embedding[1] AS first_value, embedding[-1] AS last_value FROM embeddings")
def arr01(spark, d):
    """ARR-01: to bytes and back."""
    x = _frames(spark, d).select("vec_id", arrays.decode_tensor(arrays.encode_tensor("embedding"), F.lit("float32")).alias("v"))
    return x.select("vec_id", F.size("v").cast("bigint").alias("n"), F.col("v")[0].alias("first_value"), F.element_at("v", -1).alias("last_value"))


@query("arr03_pad_mask", "SELECT vec_id, 70 AS n, len(embedding)::INT AS kept, 0.0::FLOAT AS last FROM embeddings")
def arr03(spark, d):
    """ARR-03: filled to seventy with its mask."""
    x = _frames(spark, d).select("vec_id", arrays.pad(F.col("embedding"), 70).alias("v"), arrays.pad_mask(F.col("embedding"), 70).alias("m"))
    return x.select("vec_id", F.size("v").alias("n"), F.aggregate("m", F.lit(0), lambda a, b: a + b).alias("kept"), F.col("v")[69].alias("last"))


@query("arr06_unpad", "SELECT vec_id, embedding[1:(vec_id % 60 + 1)::INT][-1] AS last FROM embeddings")
def arr06(spark, d):
    """ARR-06: as many values as the mask has ones."""
    n = (F.col("vec_id") % 60 + 1).cast("int")
    mask = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i <= n).cast("int"))
    return _frames(spark, d).select("vec_id", F.element_at(arrays.unpad(F.col("embedding"), mask), -1).alias("last"))


@query("arr04_collate", "SELECT vec_id // 16 AS batch, vec_id, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS place, 40 AS width, embedding[40] AS last, label::VARCHAR AS info FROM embeddings")
def arr04(spark, d):
    """ARR-04: batches of sixteen as stacked tensors of one width with the list of their details, taken apart again."""
    rows = _frames(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 16))
    stacked = ev.collate(rows, "batch", "vec_id", "embedding", 40, {"info": F.col("label").cast("string")})
    x = stacked.select("batch", "shape", F.posexplode(F.arrays_zip("ids", "tensor", "info")).alias("place", "r"))
    return x.select("batch", F.col("r.ids").alias("vec_id"), F.col("place").cast("bigint").alias("place"), F.col("shape")[1].alias("width"), F.element_at("r.tensor", 40).alias("last"), "r.info")


@query("arr02_triplets", "SELECT vec_id, 4 * len(embedding) AS n_bytes, [len(embedding)] AS shape, 'float32' AS dtype FROM embeddings")
def arr02(spark, d):
    """ARR-02: a vector as bytes, shape and dtype."""
    t = _frames(spark, d).select("vec_id", arrays.encode_tensor("embedding").alias("b"), F.array(F.size("embedding").cast("bigint")).alias("shape"))
    return t.select("vec_id", F.octet_length("b").cast("bigint").alias("n_bytes"), "shape", F.lit("float32").alias("dtype"))


@query("arr05_batch_pad", "SELECT vec_id, (max(n) OVER (PARTITION BY vec_id // 16))::INT AS width, n::INT AS kept FROM (SELECT vec_id, vec_id % 60 + 1 AS n FROM embeddings)")
def arr05(spark, d):
    """ARR-05: rows of other lengths filled to the longest of their batch, with masks."""
    n = (F.col("vec_id") % 60 + 1).cast("int")
    rows = _frames(spark, d).select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch"), F.slice("embedding", F.lit(1), n).alias("v"))
    x = ev.pad_to_batch(rows, "batch", "v")
    return x.select("vec_id", F.size("v").alias("width"), F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("kept"))


@query("arr07_frames_last", "SELECT vec_id, list_transform(range(64), lambda j: embedding[(j // 4) % 4 * 16 + j % 4 * 4 + j // 16 + 1]) AS v FROM embeddings")
def arr07(spark, d):
    """ARR-07: four frames of one by four with four channels, channels first."""
    shape = F.array(*map(F.lit, (4, 1, 4, 4)))
    return _frames(spark, d).select("vec_id", arrays.frames_last("embedding", shape).alias("v"))


@query("arr08_similarity", f"SELECT a.vec_id, round({_COS.format(o='o')}, 4) AS cosine, round(list_sum(list_transform(list_zip(embedding, o), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) / len(embedding), 4) AS mse FROM embeddings a JOIN (SELECT vec_id - 1 AS vec_id, embedding AS o FROM embeddings) b USING (vec_id)")
def arr08(spark, d):
    """ARR-08: neighbours compared."""
    f = _frames(spark, d)
    x = f.join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o")), "vec_id")
    return x.select("vec_id", F.round(arrays.cosine(F.col("embedding"), F.col("o")), 4).alias("cosine"), F.round(arrays.mse(F.col("embedding"), F.col("o")), 4).alias("mse"))


@query("arr08_psnr", "SELECT a.vec_id, round(10 * log10(1 / greatest(list_sum(list_transform(list_zip(embedding, o), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) / len(embedding), 1e-10)), 4) AS psnr FROM embeddings a JOIN (SELECT vec_id - 1 AS vec_id, embedding AS o FROM embeddings) b USING (vec_id)")
def arr08_psnr(spark, d):
    """ARR-08: peak signal to noise."""
    f = _frames(spark, d)
    x = f.join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o")), "vec_id")
    return x.select("vec_id", F.round(arrays.psnr(F.col("embedding"), F.col("o")), 4).alias("psnr"))


@query("arr09_ssim")
def arr09(spark, d):
    """ARR-09: each vector as an image of eight by eight against the next one."""
    f = _frames(spark, d)
    x = f.join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o")), "vec_id")
    return x.select("vec_id", F.round(arrays.ssim("embedding", "o", F.array(F.lit(8), F.lit(8))), 6).alias("ssim"))


@query("arr10_mask_iou", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(embedding, o), lambda z: (z[1] > 0 AND z[2] > 0)::INT)) / list_sum(list_transform(list_zip(embedding, o), lambda z: (z[1] > 0 OR z[2] > 0)::INT)), 6) AS iou FROM embeddings a JOIN (SELECT vec_id - 1 AS vec_id, embedding AS o FROM embeddings) b USING (vec_id)")
def arr10(spark, d):
    """ARR-10: overlap of two binary masks."""
    f = _frames(spark, d).select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("bigint")).alias("m"))
    x = f.join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("m").alias("o")), "vec_id")
    return x.select("vec_id", F.round(arrays.mask_iou(F.col("m"), F.col("o")), 6).alias("iou"))


@query("arr11_by_dimension", "SELECT dim, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS dim FROM part) GROUP BY 1")
def arr11(spark, d):
    """ARR-11."""
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("dim")).groupBy("dim").agg(F.count("*").alias("n"))


@query("arr12_repeat", "SELECT p_partkey, i::INT AS i FROM part, range(3) t(i)")
def arr12(spark, d):
    """ARR-12: three samples for each row."""
    return read(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))


@query("arr13_blocks", "SELECT vec_id, b::INT AS b, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT vec_id, (i - 1) // 8 AS b, embedding[i] AS x FROM embeddings, range(1, 65) t(i)) GROUP BY 1, 2")
def arr13(spark, d):
    """ARR-13: means of blocks of eight."""
    x = _frames(spark, d).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return x.groupBy("vec_id", F.floor(F.col("i") / 8).cast("int").alias("b")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("arr14_leading", "SELECT vec_id, list_sum(list_transform(embedding[1:5], lambda x: (x > 0)::INT))::INT AS n_positive FROM embeddings")
def arr14(spark, d):
    """ARR-14: the first five values; a shorter row fails the query."""
    head = F.when(F.size("embedding") >= 5, F.slice("embedding", 1, 5)).otherwise(F.raise_error(F.lit("fewer actions than frames")))
    return _frames(spark, d).select("vec_id", F.aggregate(head, F.lit(0), lambda s, x: s + (x > 0).cast("int")).alias("n_positive"))


@query("win05_consistency", f"SELECT label, round(avg((greatest({_COS.format(o='b')}, 0) + greatest({_COS.format(o='s')}, 0)) / 2), 4) AS score FROM (SELECT label, embedding, lag(embedding) OVER w AS b, first(embedding) OVER w AS s FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE b IS NOT NULL GROUP BY 1")
def win05(spark, d):
    """WIN-05."""
    return ev.consistency(_frames(spark, d), "label", "vec_id", "embedding").select("label", F.round("score", 4).alias("score"))


@query("win06_flicker", "SELECT label, round((255 - avg(list_sum(list_transform(list_zip(embedding, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len(embedding))) / 255, 6) AS score FROM (SELECT label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL GROUP BY 1")
def win06(spark, d):
    """WIN-06."""
    return ev.flicker(_frames(spark, d), "label", "vec_id", "embedding").select("label", F.round("score", 6).alias("score"))


@query("win07_crossing", "SELECT user_id, min(i) AS onset FROM (SELECT user_id, i, n, avg(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)) WHERE i <= n - 5 AND m > 9000 GROUP BY 1")
def win07(spark, d):
    """WIN-07: where the mean of five full frames first passes the threshold."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("c"))
    return ev.first_crossing(e, ["user_id"], ["ts", "event_id"], "c", 5, F.lit(9000))


@query("win08_background", "SELECT vec_id, round(list_reduce(list_transform(embedding, lambda x: x::DOUBLE), lambda a, x: 0.9 * a + 0.1 * x), 6) AS background FROM embeddings")
def win08(spark, d):
    """WIN-08: a recursive mean as a fold."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return _frames(spark, d).select("vec_id", F.round(ev.exponential_background(v, 0.1), 6).alias("background"))


@query("win08_recursive", """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, value AS a FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, (1 - 1 / 7.0::DOUBLE) * r.a + 1 / 7.0::DOUBLE * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT event_id, round(a, 6) AS background FROM r""")
def win08_recursive(spark, d):
    """WIN-08 over rows: the exponential background of each user's values, whatever their number."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return scans.exponential_mean(e, ["user_id"], ["ts", "event_id"], "value", 1 / 7).select("event_id", F.round("background", 6).alias("background"))


@query("win09_lagged", "WITH x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)) SELECT a.vec_id, lag, round(corr(a.v, b.v), 4) + 0.0::DOUBLE AS r FROM (SELECT unnest([5, 17, 41]) AS lag), x a JOIN x b ON b.vec_id = a.vec_id + 1 AND b.i = (a.i + lag) % 64 GROUP BY 1, 2")
def win09(spark, d):
    """WIN-09: correlation at cyclic lags of every vector and the next one."""
    x = _frames(spark, d).select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    a = x.select("vec_id", F.explode(F.array(F.lit(5), F.lit(17), F.lit(41))).alias("lag"), "i", "v").select("vec_id", "lag", ((F.col("i") + F.col("lag")) % 64).alias("i"), F.col("v").alias("a"))
    return a.join(x.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("v").alias("b")), ["vec_id", "i"]).groupBy("vec_id", "lag").agg((F.round(F.corr("a", "b"), 4) + F.lit(0.0)).alias("r"))  # no -0.0


@query("win10_prefix", "WITH r AS (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) AS k FROM (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i))), b AS (SELECT vec_id, median(x) FILTER (WHERE k <= 12) AS lo, median(x) FILTER (WHERE k > 52) AS hi FROM r GROUP BY 1) SELECT vec_id, min(i)::INT AS onset FROM r JOIN b USING (vec_id) WHERE x > lo + 0.25 * (hi - lo) GROUP BY 1")
def win10(spark, d):
    """WIN-10: the first value a quarter of the way from the low fifth's median to the high fifth's."""
    x = _frames(spark, d).select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    r = x.withColumn("k", F.row_number().over(Window.partitionBy("vec_id").orderBy("x", "i")))
    b = r.groupBy("vec_id").agg(F.median(F.when(F.col("k") <= 12, F.col("x"))).alias("lo"), F.median(F.when(F.col("k") > 52, F.col("x"))).alias("hi"))
    return r.join(b, "vec_id").where("x > lo + 0.25 * (hi - lo)").groupBy("vec_id").agg(F.min("i").alias("onset"))


@query("agg17_physics_score", "SELECT label, round(least(greatest(100 * ((st / vst + s / vs) / 2 - (mse - vmse)), 0), 100), 2) AS score FROM (SELECT label, avg(abs(x[1])) AS st, 1.5 AS vst, avg(abs(x[2])) AS s, 1.25 AS vs, avg(x[3] * x[3]) AS mse, 0.9 AS vmse FROM (SELECT label, list_transform(embedding, lambda y: y::DOUBLE) AS x FROM embeddings) GROUP BY 1)")
def agg17(spark, d):
    """AGG-17: weighted parts of a corpus score, clipped to [0, 100]."""
    v = lambda i: F.col("embedding")[i].cast("double")
    a = _frames(spark, d).groupBy("label").agg(F.avg(F.abs(v(0))).alias("st"), F.avg(F.abs(v(1))).alias("s"), F.avg(v(2) * v(2)).alias("mse"))
    score = 100 * ((F.col("st") / 1.5 + F.col("s") / 1.25) / 2 - (F.col("mse") - 0.9))
    return a.select("label", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 2).alias("score"))


@query("agg22_moments", "SELECT label, round(avg(embedding[1]::DOUBLE), 4) AS mean_0, round(covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 4) AS cov_01, count(*) AS n FROM embeddings GROUP BY 1")
def agg22(spark, d):
    """AGG-22: mean and sample covariance of the Gaussian fit."""
    v = lambda i: F.col("embedding")[i].cast("double")
    return _frames(spark, d).groupBy("label").agg(F.round(F.avg(v(0)), 4).alias("mean_0"), F.round(F.covar_samp(v(0), v(1)), 4).alias("cov_01"), F.count("*").alias("n"))


@query("agg22_frechet")
def agg22_frechet(spark, d):
    """AGG-22: distance of every label from label 0."""
    return ev.frechet_distance(_frames(spark, d), "label", "embedding", 0).select(F.col("g").alias("label"), F.round("distance", 4).alias("distance"))


@query("agg23_temporal", "SELECT user_id, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS std, max(v) AS top, round(sum((v + b) / 2) / (count(*) - 1), 3) AS auc FROM (SELECT user_id, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1 HAVING count(*) > 1")
def agg23(spark, d):
    """AGG-23: mean, population deviation, maximum and trapezoid area of a curve."""
    e = scans.previous(read(spark, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("v")), ["user_id"], ["ts", "event_id"], b=F.col("v"))
    return e.groupBy("user_id").agg(F.round(F.avg("v"), 3).alias("mean"), F.round(F.stddev_pop("v"), 3).alias("std"), F.max("v").alias("top"), F.round(F.sum((F.col("v") + F.col("b")) / 2) / F.nullif(F.count("*") - 1, F.lit(0)), 3).alias("auc"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("agg24_vote", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.5)) >= round_even(4 * (64 / 16.0), 0) AS dynamic FROM embeddings")
def agg24(spark, d):
    """AGG-24: votes over a threshold against a quarter of the frames."""
    return _frames(spark, d).select("vec_id", (F.size(F.filter("embedding", lambda x: x > 0.5)) >= F.bround(4 * (F.size("embedding") / F.lit(16.0)))).alias("dynamic"))


@query("agg25_match_ratio", "SELECT lang, round(avg(contains(text, 'the')::INT), 6) AS ratio, round(count(*) FILTER (WHERE n_chars > 2000 AND contains(text, 'the')) / nullif(count(*) FILTER (WHERE n_chars > 2000), 0)::DOUBLE, 6) AS long_ratio FROM documents GROUP BY 1")
def agg25(spark, d):
    """AGG-25: share of frames that match, and of those that qualify."""
    m, q = F.contains(F.col("text"), F.lit("the")), F.col("n_chars") > 2000
    return read(spark, d, "documents").groupBy("lang").agg(F.round(F.avg(m.cast("int")), 6).alias("ratio"), F.round(F.try_divide(F.count_if(q & m), F.nullif(F.count_if(q), F.lit(0))), 6).alias("long_ratio"))


@query("agg34_histogram_kl", "WITH h AS (SELECT event_type, least(floor(ln(1 + value) * 2), 11)::INT AS b, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT t.event_type, b.b, coalesce(h.n, 0) + 1 AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT unnest(range(12))::INT AS b) b LEFT JOIN h ON h.event_type = t.event_type AND h.b = b.b), p AS (SELECT event_type, b, n / sum(n) OVER (PARTITION BY event_type) AS p FROM g) SELECT a.event_type, round(sum(a.p * ln(a.p / r.p)), 6) AS kl FROM p a JOIN p r ON r.b = a.b AND r.event_type = 'view' GROUP BY 1")
def agg34(spark, d):
    """AGG-34: divergence of histograms over a full grid of bins, each count plus one."""
    e = read(spark, d, "events")
    h = e.groupBy("event_type", F.least(F.floor(F.log(1 + F.col("value")) * 2), F.lit(11)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    grid = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("b"))
    g = grid.join(h, ["event_type", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    p = g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("event_type"))).select("event_type", "b", "p")
    r = p.where("event_type = 'view'").select("b", F.col("p").alias("q"))
    return p.join(r, "b").groupBy("event_type").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 6).alias("kl"))


@query("agg35_masked_grid", "SELECT c_nationkey, round(avg(c_acctbal) FILTER (WHERE c_acctbal BETWEEN lo AND hi), 3) AS mean, round(avg((c_acctbal < lo OR c_acctbal > hi)::INT), 6) AS outliers FROM customer JOIN (SELECT c_nationkey, quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.95) AS hi FROM customer GROUP BY 1) USING (c_nationkey) GROUP BY 1")
def agg35(spark, d):
    """AGG-35: means within percentile bounds and the share outside, by cell."""
    c = read(spark, d, "customer")
    b = cohorts.group_quantiles(c.select("c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", {"lo": cohorts.linear(0.05), "hi": cohorts.linear(0.95)}).drop("n")
    inside = F.col("c_acctbal").between(F.col("lo"), F.col("hi"))
    return c.join(b, "c_nationkey").groupBy("c_nationkey").agg(F.round(F.avg(F.when(inside, F.col("c_acctbal"))), 3).alias("mean"), F.round(F.avg((~inside).cast("int")), 6).alias("outliers"))


@query("agg36_positional_mean", "WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM events GROUP BY user_id)) SELECT i, round(avg(value), 3) AS mean FROM s, m WHERE i <= m.n GROUP BY 1")
def agg36(spark, d):
    """AGG-36: mean by position, up to the shortest series."""
    e = joins.group_positions(read(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "i").withColumn("i", F.col("i") + 1)
    shortest = e.groupBy("user_id").agg(F.max("i").alias("n")).agg(F.min("n").alias("n"))
    return e.join(F.broadcast(shortest), F.col("i") <= F.col("n")).groupBy("i").agg(F.round(F.avg("value"), 3).alias("mean"))


@query("agg37_drift", "WITH x AS (SELECT label, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)), r AS (SELECT i, avg(v) AS rm, stddev_samp(v) AS rs, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM x WHERE label < 5 GROUP BY 1) SELECT i::INT AS i, round(abs(avg(v) - first(rm)) / first(rs), 4) AS shift, round(stddev_samp(v) / first(rs), 4) AS spread, round(avg((v < lo OR v > hi)::INT), 6) AS tail FROM x JOIN r USING (i) WHERE label >= 5 GROUP BY 1")
def agg37(spark, d):
    """AGG-37: channels of one half of the labels against the other."""
    x = _frames(spark, d).select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    r = ev.drift(x.where("label >= 5"), x.where("label < 5"), "i", "v")
    return r.select("i", F.round("shift", 4).alias("shift"), F.round("spread", 4).alias("spread"), F.round("tail", 6).alias("tail"))


@query("scl13_frames", "SELECT p_partkey, CASE WHEN n - (((n - 5) % 17) + 17) % 17 >= 5 THEN n - (((n - 5) % 17) + 17) % 17 END AS frames FROM (SELECT p_partkey, p_size * 3 AS n FROM part)")
def scl13(spark, d):
    """SCL-13."""
    return read(spark, d, "part").select("p_partkey", arrays.largest_frames(F.col("p_size") * 3).alias("frames"))


@query("scl14_duration", "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN n_chars / (doc_id % 4)::DOUBLE ELSE 0 END AS duration FROM documents")
def scl14(spark, d):
    """SCL-14: frames over rate, 0 without a rate."""
    return read(spark, d, "documents").select("doc_id", F.coalesce(F.try_divide(F.col("n_chars").cast("double"), (F.col("doc_id") % 4).cast("double")), F.lit(0.0)).alias("duration"))


@query("scl15_crop", 'SELECT p_partkey, (w - cw) // 2 AS "left", (h - ch) // 2 AS top, cw AS width, ch AS height FROM (SELECT p_partkey, w, h, CASE WHEN w * 480 > h * 832 THEN round_even(h * 832 / 480.0::DOUBLE, 0)::BIGINT ELSE w END AS cw, CASE WHEN w * 480 > h * 832 THEN h ELSE round_even(w * 480 / 832.0::DOUBLE, 0)::BIGINT END AS ch FROM (SELECT p_partkey, (p_size * 40 + 100)::BIGINT AS w, (p_partkey % 900 + 100)::BIGINT AS h FROM part))')
def scl15(spark, d):
    """SCL-15."""
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 40 + 100).cast("bigint").alias("w"), (F.col("p_partkey") % 900 + 100).alias("h"))
    return p.select("p_partkey", *[c.alias(n) for n, c in arrays.crop_box(F.col("w"), F.col("h"), 832, 480).items()])


@query("scl16_box_iou", "SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(i / nullif(2 * q * q - i, 0), 0), 6) AS iou FROM (SELECT *, l_quantity AS q, greatest(q - 5, 0) * greatest(q - 3, 0) AS i FROM lineitem)")
def scl16(spark, d):
    """SCL-16: a box against the same one moved by five and three."""
    q, z = F.col("l_quantity"), F.lit(0.0)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(arrays.box_iou(z, z, q, q, z + 5, z + 3, q, q), 6).alias("iou"))


@query("scl17_clipped", "SELECT event_id, greatest(least(greatest(least(a, 5.0), -5.0) / 5.0 / 2 + 0.5, 1.0), 0.0) AS weight FROM (SELECT event_id, (value - 60) / 10 AS a FROM events)")
def scl17(spark, d):
    """SCL-17."""
    return read(spark, d, "events").select("event_id", arrays.clipped_advantage((F.col("value") - 60) / 10, 5.0).alias("weight"))


@query("scl18_decay", "SELECT event_id, CASE WHEN event_id <= 1000 THEN 1.0 ELSE 1.0 + (0.1 - 1.0) * least((event_id - 1000) / 4000.0::DOUBLE, 1.0) END::DOUBLE AS rate FROM events")
def scl18(spark, d):
    """SCL-18."""
    return read(spark, d, "events").select("event_id", arrays.decay(F.col("event_id"), 1000, 5000, 1.0, 0.1).alias("rate"))


@query("scl19_kl", "WITH x AS (SELECT a.vec_id, i, embedding[i]::DOUBLE AS p, o[i]::DOUBLE AS q FROM embeddings a JOIN (SELECT vec_id - 1 AS vec_id, embedding AS o FROM embeddings) USING (vec_id), range(1, 65) t(i)), z AS (SELECT vec_id, ln(sum(exp(p))) AS zp, ln(sum(exp(q))) AS zq FROM x GROUP BY 1) SELECT vec_id, round(sum(exp(p - zp) * ((p - zp) - (q - zq))), 4) AS kl FROM x JOIN z USING (vec_id) GROUP BY 1")
def scl19(spark, d):
    """SCL-19: neighbours' logits."""
    f = _frames(spark, d)
    x = f.join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o")), "vec_id")
    return x.select("vec_id", F.round(arrays.softmax_kl(F.col("embedding"), F.col("o")), 4).alias("kl"))


@query("scl21_schedule", "SELECT i, round(sum(CASE WHEN i < 10 THEN (i + 1) / 10.0 ELSE 0.5 * (1 + cos(pi() * (i - 10) / 90.0)) END::DOUBLE) OVER (ORDER BY i), 6) AS spent FROM range(100) t(i)")
def scl21(spark, d):
    """SCL-21: warm-up and cosine rates summed to each step (a schedule of a hundred steps)."""
    i = F.col("id")
    rate = F.when(i < 10, (i + 1) / 10.0).otherwise(0.5 * (1 + F.cos(F.pi() * (i - 10) / 90.0)))
    return spark.range(100).select(i.alias("i"), F.round(F.sum(rate).over(Window.orderBy("id")), 6).alias("spent"))


@query("scl22_log_depth", "SELECT event_id, round(CASE WHEN c = 0 THEN 0 ELSE exp(ln(0.1) + (c - 1) / 65534.0::DOUBLE * (ln(1000.0) - ln(0.1))) END, 5) AS depth FROM (SELECT event_id, user_id * 400 % 65536 AS c FROM events)")
def scl22(spark, d):
    """SCL-22."""
    return read(spark, d, "events").select("event_id", F.round(arrays.decode_log_depth(F.col("user_id") * 400 % 65536, 0.1, 1000.0), 5).alias("depth"))


@query("udf03_registry", "SELECT unnest(['text.length', 'text.lines', 'media.rate']) AS metric, unnest(['text', 'text', 'media']) AS prefix")
def udf03(spark, d):
    """UDF-03: the registered metrics and their groups."""
    return spark.createDataFrame([(m.name, m.name.partition(".")[0]) for m in ev.resolve("all")], "metric string, prefix string")


@query("udf04_selection", "SELECT doc_id, 'text.lines' AS metric, len(string_split(text, chr(10)))::DOUBLE AS score FROM documents UNION ALL SELECT doc_id, 'text.length', length(text)::DOUBLE FROM documents")
def udf04(spark, d):
    """UDF-04: a name, its group and an unknown one: each metric once, the unknown one skipped."""
    chosen = ev.resolve(["text.lines", "text", "nothing"], strict=False)
    return ev.evaluate_rows(read(spark, d, "documents"), ["doc_id"], chosen).select("doc_id", "metric", "score")


@query("udf05_subset", "SELECT source, avg(length(text)) AS text_length FROM documents WHERE lang = 'de' GROUP BY 1")
def udf05(spark, d):
    """UDF-05: one metric over the rows of a subset, reduced by group."""
    return ev.evaluate_corpus(read(spark, d, "documents").where("lang = 'de'"), ["source"], ev.resolve("text.length"))


@query("udf10_requests", "SELECT conv_id, i::INT AS i, prompt FROM (SELECT conv_id, list(text ORDER BY turn) AS p FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1), LATERAL (SELECT unnest(p) AS prompt, unnest(range(len(p))) AS i)")
def udf10(spark, d):
    """UDF-10: a request with a list of prompts becomes a request for each."""
    turns = read(spark, d, "conversations").where("role = 'user' and text is not null")
    lists = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("p"))  # the turns of one conversation
    return lists.select("conv_id", F.posexplode("p").alias("i", "prompt"))
