"""Joins, set operations, aggregations and windows on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import cohorts, joins, scans
from tessera.plans.registry import query, read


# ------------------------------------------------------------------ joins


@query("join01_lookup", "SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality END, d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def join01(spark, d):
    """JOIN-01: matched documents take the label's text, the others keep their own."""
    new = read(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("lang"))
    return joins.lookup(read(spark, d, "documents").select("doc_id", "lang"), new, ["doc_id"], "lang")


@query("join02_orphans", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey IS NULL THEN 'no customer' WHEN o_custkey IS NULL THEN 'no order' ELSE 'both' END AS status FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 5 <> 0) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey) GROUP BY 1")
def join02(spark, d):
    """JOIN-02: matches and the orphans of both sides."""
    c = read(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"))
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return joins.reconcile(c, o, ["k"], ("both", "no order", "no customer")).groupBy("status").agg(F.count("*").alias("n"))


@query("join03_take_pairs", "SELECT a.conv_id, a.turn, length(a.text) AS asked, length(b.text) AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def join03(spark, d):
    """JOIN-03: a table with itself, a turn with the next one."""
    c = read(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("bigint").alias("asked"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("bigint").alias("answered"))
    return a.join(b, ["conv_id", "turn"])


@query("join04_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def join04(spark, d):
    """JOIN-04: rows without a match."""
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("join05_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join05(spark, d):
    """JOIN-05: customers with a large order."""
    o = read(spark, d, "orders").where("o_totalprice > 400000")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join06_zip", "SELECT pos, item_id, s_suppkey FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark) FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_name) - 1 AS pos FROM supplier) USING (pos)")
def join06(spark, d):
    """JOIN-06: two tables by position; the longer one's surplus stays."""
    return joins.zip_rows(read(spark, d, "benchmark").select("item_id"), read(spark, d, "supplier").select("s_suppkey", "s_name"), ["item_id"], ["s_name"]).select("pos", "item_id", "s_suppkey")


@query("join07_reconcile", "SELECT doc_id, CASE WHEN l.id IS NULL THEN 'missing' WHEN d.id IS NULL THEN 'extra' ELSE 'both' END AS status FROM (SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0) d FULL JOIN (SELECT doc_id AS id FROM labels) l USING (id), LATERAL (SELECT id AS doc_id)")
def join07(spark, d):
    """JOIN-07: manifest against cache."""
    return joins.reconcile(read(spark, d, "documents").where("doc_id % 7 <> 0"), read(spark, d, "labels"), ["doc_id"])


@query("join08_n_way", "SELECT n_name, r_name, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join08(spark, d):
    """JOIN-08: chained inner joins with small dimensions."""
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"))
    return s.join(read(spark, d, "nation"), "n_nationkey").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "n_suppliers")


@query("join09_cohort_baseline", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT l.o_custkey, l.o_orderkey, b.n AS baseline_n, round(b.m, 4) AS baseline FROM r l LEFT JOIN (SELECT o_custkey, count(*) AS n, median(o_totalprice) AS m FROM r WHERE rn BETWEEN 2 AND 6 GROUP BY 1) b USING (o_custkey) WHERE rn = 1")
def join09(spark, d):
    """JOIN-09: the current row joined with the median of the five before it."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = read(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 6")
    b = r.where("rn > 1").groupBy("o_custkey").agg(F.count("*").alias("baseline_n"), F.round(F.median("o_totalprice"), 4).alias("baseline"))
    return r.where("rn = 1").select("o_custkey", "o_orderkey").join(b, "o_custkey", "left")


@query("join10_fallback", """WITH f AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2), c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, coalesce(f.n, c.n) AS n, CASE WHEN f.n IS NOT NULL THEN 'fine' ELSE 'coarse' END AS source FROM orders LEFT JOIN f USING (o_orderpriority, o_orderstatus) LEFT JOIN c USING (o_orderpriority)""")
def join10(spark, d):
    """JOIN-10: six keys first, three keys where those have no baseline (here two and one)."""
    o = read(spark, d, "orders")
    fine = o.where("o_orderstatus <> 'P'").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    coarse = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return joins.with_fallback(o, fine, coarse, ["o_orderpriority", "o_orderstatus"], ["o_orderpriority"], "n").select("o_orderkey", "n", "source")


@query("join11_compare_runs", "SELECT CASE WHEN sha256(a.text) = sha256(b.text) THEN 'identical' ELSE 'differs' END AS verdict, count(*) AS n FROM documents a JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END AS text FROM documents) b USING (doc_id) GROUP BY 1")
def join11(spark, d):
    """JOIN-11: two runs by key, content by digest."""
    a = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("x"))
    b = read(spark, d, "documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("y"))
    return a.join(b, "doc_id").groupBy(F.when(F.col("x") == F.col("y"), "identical").otherwise("differs").alias("verdict")).agg(F.count("*").alias("n"))


@query("join13_pairs", "SELECT a.l_orderkey, max(abs(a.l_extendedprice - b.l_extendedprice)) AS widest, count(*) AS n_pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_orderkey % 3 = 0 GROUP BY 1".replace("max(abs(a.l_extendedprice - b.l_extendedprice))", "round(max(abs(a.l_extendedprice - b.l_extendedprice)), 4)").replace(" WHERE a.l_orderkey % 3 = 0", ""))
def join13(spark, d):
    """JOIN-13: pairs i < j of the lines of an order, the widest one of each."""
    p = joins.pairs(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_extendedprice"])
    return p.groupBy("l_orderkey").agg(F.round(F.max(F.abs(F.col("l_extendedprice_a") - F.col("l_extendedprice_b"))), 4).alias("widest"), F.count("*").alias("n_pairs"))


@query("join15_substring_key", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 30 WHEN contains(p_name, 'small') THEN 20 ELSE 120 END AS cap FROM part")
def join15(spark, d):
    """JOIN-15: the first key that the name contains, else the default."""
    p = read(spark, d, "part")
    return p.select("p_partkey", joins.substring_lookup(p, "p_name", [("red", 30), ("small", 20)], 120).alias("cap"))


@query("join16_blocked", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = o.o_custkey AND b.o_orderpriority <> o.o_orderpriority AND b.o_orderstatus = 'F')")
def join16(spark, d):
    """JOIN-16: rows that another recipe of the same identity blocks."""
    o = read(spark, d, "orders")
    b = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderpriority").alias("lo"), F.max("o_orderpriority").alias("hi"))
    return o.join(b, F.col("o_custkey") == F.col("c")).where("lo <> o_orderpriority or hi <> o_orderpriority").select("o_orderkey")


@query("join19_strict_mapping", "SELECT n_regionkey, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join19(spark, d):
    """JOIN-19: every class id must map; an unknown one fails the query."""
    m = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit("x").alias("name"))
    return joins.lookup(read(spark, d, "nation").withColumn("name", F.lit(None).cast("string")), m, ["n_regionkey"], "name", strict=True).where("name = 'x'").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("join20_ratio", "SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) AS ratio FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def join20(spark, d):
    """JOIN-20: the ten largest ratios to the base."""
    r = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_extendedprice"), 6).alias("ratio"))
    return r.orderBy(F.desc("ratio"), "l_suppkey").limit(10)


# ------------------------------------------------------------------ sets


@query("set01_leak", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM labels")
def set01(spark, d):
    """SET-01: ids in both splits."""
    return read(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id").intersect(read(spark, d, "labels").select("doc_id"))


@query("set02_difference", "SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def set02(spark, d):
    """SET-02."""
    return read(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(read(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey"))


@query("set03_union_all", "SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def set03(spark, d):
    """SET-03: labelled tables of one schema, one after the other."""
    c = read(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(read(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")))


@query("set04_distinct_union", "SELECT lang AS v FROM documents UNION SELECT role FROM conversations")
def set04(spark, d):
    """SET-04: distinct values of two tables."""
    return read(spark, d, "documents").select(F.col("lang").alias("v")).union(read(spark, d, "conversations").select("role")).distinct()


@query("set05_keep_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def set05(spark, d):
    """SET-05: the first of equal rows stays; a partial minimum, no window."""
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("x")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("set06_complement", "SELECT s, v FROM (SELECT DISTINCT c_mktsegment AS s FROM customer), (SELECT unnest(range(25))::INT AS v) EXCEPT SELECT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 9000")
def set06(spark, d):
    """SET-06: the variants that no row has chosen (a fixed list of variants, exploded)."""
    c = read(spark, d, "customer")
    every = c.select(F.col("c_mktsegment").alias("s")).distinct().select("s", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("v"))
    return every.subtract(c.where("c_acctbal > 9000").select("c_mktsegment", "c_nationkey"))


@query("set08_keyed_merge", "SELECT k, first_pos, v FROM (SELECT lower(trim(source)) AS k, min(doc_id) AS first_pos, arg_max(lang, doc_id) AS v FROM documents WHERE trim(source) <> '' GROUP BY 1)")
def set08(spark, d):
    """SET-08: groups merged by key: the last value wins, the first position stays."""
    s = F.lower(F.trim("source"))
    return read(spark, d, "documents").where(s != "").groupBy(s.alias("k")).agg(F.min("doc_id").alias("first_pos"), F.max_by("lang", "doc_id").alias("v"))


# ------------------------------------------------------------------ aggregations


@query("agg07_serving_summary", """SELECT event_type, count(*) FILTER (WHERE value < 100) AS completed, count(*) FILTER (WHERE NOT value < 100) AS failed, round(count(*) FILTER (WHERE value < 100) / 3600.0::DOUBLE, 6) AS qps, round(coalesce(avg(value) FILTER (WHERE value < 100), 0), 4) AS mean,
round(coalesce(quantile_cont(value, 0.5) FILTER (WHERE value < 100), 0), 4) AS median, round(coalesce(quantile_cont(value, 0.99) FILTER (WHERE value < 100), 0), 4) AS p99, round(coalesce(max(user_id) FILTER (WHERE user_id > 0), 0)::DOUBLE, 4) AS max_memory FROM events GROUP BY 1""")
def agg07(spark, d):
    """AGG-07: percentiles of successes by counts of values, so a group may have any size."""
    e, ok = read(spark, d, "events"), F.col("value") < 100
    rest = e.groupBy("event_type").agg(*stats.serving_summary(F.col("value"), F.col("user_id").cast("double"), ok, 3600.0))
    q = cohorts.group_quantiles(e.where(ok).select("event_type", "value"), ["event_type"], "value", {"median": cohorts.linear(0.5), "p99": cohorts.linear(0.99)}).drop("n")
    return rest.join(q, "event_type", "left").withColumns({c: stats.or_zero(F.col(c)) for c in ("median", "p99")})


@query("agg08_series_summary", "SELECT user_id, count(value) AS n, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def agg08(spark, d):
    """AGG-08."""
    return cohorts.summarised(read(spark, d, "events").select("user_id", "value"), ["user_id"], "value")


@query("agg09_nearest_rank", "SELECT user_id, list_extract(l, round_even(0.95 * (len(l) - 1), 0)::INT + 1) AS p95 FROM (SELECT user_id, list_sort(list(value)) AS l FROM events GROUP BY 1)")
def agg09(spark, d):
    """AGG-09: the nearest rank, halves to even."""
    e = read(spark, d, "events").select("user_id", "value")
    return cohorts.group_quantiles(e, ["user_id"], "value", {"p95": cohorts.nearest(0.95)}).drop("n")


@query("agg10_benchmark_record", "SELECT l_suppkey, round(avg(l_quantity), 3) AS mean_time, max(l_extendedprice) AS max_memory, round(121 / avg(l_quantity), 3) AS fps FROM lineitem GROUP BY 1")
def agg10(spark, d):
    """AGG-10: mean time, peak memory and frames per second of a benchmark."""
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 3).alias("mean_time"), F.max("l_extendedprice").alias("max_memory"), F.round(121 / F.avg("l_quantity"), 3).alias("fps"))


@query("agg11_bucket_stats", "SELECT user_id, count(*) AS n_buckets, round(quantile_cont(s, 0.95), 4) AS p95, round(max(s), 4) AS top FROM (SELECT user_id, epoch_us(ts) // 3600000000 AS b, sum(round(value * 100)::BIGINT)::BIGINT / 100 AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def agg11(spark, d):
    """AGG-11, STR-08: sums of time buckets, then statistics of the buckets."""
    e = read(spark, d, "events").withColumn("b", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000)))
    b = e.groupBy("user_id", "b").agg((F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100).alias("s"))
    return b.groupBy("user_id").agg(F.count("*").alias("n_buckets"), F.round(F.percentile("s", F.lit(0.95)), 4).alias("p95"), F.round(F.max("s"), 4).alias("top"))


@query("agg12_counter", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg12(spark, d):
    """AGG-12: the most common values."""
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("agg13_skipped_metrics", "SELECT event_type, 'value' AS metric, count(CASE WHEN user_id % 2 = 0 THEN value END) AS n_values FROM events GROUP BY 1 UNION ALL SELECT event_type, 'never', 0 FROM events GROUP BY 1")
def agg13(spark, d):
    """AGG-13: values of each metric; one without any is reported as skipped."""
    e = read(spark, d, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("value"), F.lit(None).cast("double").alias("never"))
    return e.unpivot(["event_type"], ["value", "never"], "metric", "x").groupBy("event_type", "metric").agg(F.count("x").alias("n_values"))


@query("agg14_shard_coverage", "SELECT count(*) AS shards, min(n) AS least, list_extract(list_sort(list(n)), len(list(n)) // 2 + 1) AS upper_median, max(n) AS most FROM (SELECT substr(sha1(doc_id::VARCHAR), 1, 2) AS shard, count(*) AS n FROM documents GROUP BY 1)")
def agg14(spark, d):
    """AGG-14: rows per shard (256 shards at most)."""
    c = read(spark, d, "documents").groupBy(F.substring(F.sha1(F.col("doc_id").cast("string").cast("binary")), 1, 2).alias("shard")).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("shards"), F.min("n").alias("least"), stats.upper_median("n").alias("upper_median"), F.max("n").alias("most"))


@query("agg15_crosstab", "SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY 1")
def agg15(spark, d):
    """AGG-15."""
    langs = ["de", "en", "es", "fr"]
    return read(spark, d, "documents").groupBy("source").pivot("lang", langs).count().na.fill(0, langs)


@query("agg16_win_rate", "SELECT coalesce(event_type, 'all') AS label, round(count(*) FILTER (WHERE value > 60)::DOUBLE / nullif(count(*) FILTER (WHERE value > 60 OR value < 40), 0), 6) AS win_rate FROM events GROUP BY GROUPING SETS ((), (event_type))")
def agg16(spark, d):
    """AGG-16: wins over wins and losses, overall and by label; ties do not count."""
    e = read(spark, d, "events")
    rolled = e.rollup("event_type").agg(F.count_if(F.col("value") > 60).alias("w"), F.count_if((F.col("value") > 60) | (F.col("value") < 40)).alias("n"))
    return rolled.select(F.coalesce("event_type", F.lit("all")).alias("label"), F.round(F.try_divide(F.col("w"), F.nullif(F.col("n"), F.lit(0))), 6).alias("win_rate"))


@query("agg18_advantages", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-4), 4) AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def agg18(spark, d):
    """AGG-18: rewards by group mean and population deviation."""
    w = Window.partitionBy("l_orderkey")
    adv = (F.col("l_quantity") - F.avg("l_quantity").over(w)) / (F.stddev_pop("l_quantity").over(w) + 1e-4)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(adv, 4).alias("advantage"))


@query("agg19_reward_groups", "SELECT round(avg(n), 4) AS mean_size, round(avg((s = 0)::INT), 4) AS zero_std_ratio, round(avg(s), 4) AS mean_std FROM (SELECT l_orderkey, count(*) AS n, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1)")
def agg19(spark, d):
    """AGG-19."""
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.stddev_pop("l_quantity").alias("s"))
    return g.agg(F.round(F.avg("n"), 4).alias("mean_size"), F.round(F.avg((F.col("s") == 0).cast("int")), 4).alias("zero_std_ratio"), F.round(F.avg("s"), 4).alias("mean_std"))


@query("agg20_top_share", "SELECT round(avg(m), 4) AS top_mean FROM (SELECT l_suppkey, avg(x) AS m FROM (SELECT l_suppkey, l_extendedprice AS x, quantile_cont(l_extendedprice, 0.9) OVER (PARTITION BY l_suppkey) AS t FROM lineitem) WHERE x >= t GROUP BY 1)")
def agg20(spark, d):
    """AGG-20: mean of each group's top tenth, then the mean of the groups."""
    li = read(spark, d, "lineitem")
    t = cohorts.group_quantiles(li.select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", {"t": cohorts.linear(0.9)}).drop("n")
    return li.join(t, "l_suppkey").where("l_extendedprice >= t").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("m")).agg(F.round(F.avg("m"), 4).alias("top_mean"))


@query("agg21_distributed_mean", "SELECT round(sum(l_quantity) / (count(*) * 8), 6) AS mean_over_workers FROM lineitem")
def agg21(spark, d):
    """AGG-21: a sum over divisor times workers."""
    return read(spark, d, "lineitem").agg(F.round(F.sum("l_quantity") / (F.count("*") * 8), 6).alias("mean_over_workers"))


@query("agg26_filter_stats", "SELECT count(*) AS n_before, count(*) FILTER (WHERE n_chars >= 200) AS n_after, count(*) FILTER (WHERE n_chars >= 200 AND n_chars < 1000) AS n_short FROM documents")
def agg26(spark, d):
    """AGG-26: counts before and after a filter, and a part of the histogram."""
    n = F.col("n_chars")
    return read(spark, d, "documents").agg(F.count("*").alias("n_before"), F.count_if(n >= 200).alias("n_after"), F.count_if((n >= 200) & (n < 1000)).alias("n_short"))


@query("agg27_media_stats", "SELECT split_part(url, '/', 3) AS host, count(*) AS files, sum(strlen(html))::BIGINT AS bytes FROM pages WHERE url LIKE 'http%' GROUP BY 1")
def agg27(spark, d):
    """AGG-27: files and bytes of each dataset (here of each host)."""
    return read(spark, d, "pages").where("url like 'http%'").groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).agg(F.count("*").alias("files"), F.sum(F.octet_length("html").cast("bigint")).alias("bytes"))


@query("agg28_duplicates", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg28(spark, d):
    """AGG-28: contents that occur more than once."""
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("agg30_argmin", "SELECT lang, arg_min(doc_id, (n_chars, doc_id)) AS shortest, arg_max(doc_id, (n_chars, -doc_id)) AS longest FROM documents GROUP BY 1")
def agg30(spark, d):
    """AGG-30: the row with the least and the most, ties by id."""
    return read(spark, d, "documents").groupBy("lang").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("shortest"), F.max_by("doc_id", F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("longest"))


@query("agg31_components", "SELECT user_id, round(sum(value) FILTER (WHERE event_type IN ('click', 'view')), 4) AS encoder, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS dit FROM events GROUP BY 1")
def agg31(spark, d):
    """AGG-31: stages mapped to components and summed; a component without stages is null."""
    part = F.when(F.col("event_type").isin("click", "view"), "encoder").when(F.col("event_type") == "purchase", "dit").otherwise("other")
    p = read(spark, d, "events").groupBy("user_id", part.alias("part")).agg(F.sum("value").alias("s"))
    return p.groupBy("user_id").pivot("part", ["encoder", "dit"]).agg(F.round(F.first("s"), 4))


@query("agg32_batch_consistency", "SELECT event_type, arg_max(event_id, (dev, -event_id)) AS worst, round(max(dev), 4) AS deviation FROM (SELECT event_type, event_id, abs(value - m) / m AS dev FROM events JOIN (SELECT event_type, median(value) AS m FROM events GROUP BY 1) USING (event_type)) GROUP BY 1")
def agg32(spark, d):
    """AGG-32: the member farthest from its batch's median."""
    e = read(spark, d, "events")
    m = cohorts.group_quantiles(e.select("event_type", "value"), ["event_type"], "value", {"m": cohorts.linear(0.5)})
    dev = F.abs(F.col("value") - F.col("m")) / F.col("m")
    return e.join(m, "event_type").withColumn("dev", dev).groupBy("event_type").agg(F.max_by("event_id", F.struct(F.col("dev"), -F.col("event_id"))).alias("worst"), F.round(F.max("dev"), 4).alias("deviation"))


# ------------------------------------------------------------------ windows and top-k


@query("win12_runs", "SELECT user_id, max(n) AS longest_failure_run FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events) WHERE event_type = 'error' GROUP BY 1, 2) GROUP BY 1")
def win12(spark, d):
    """WIN-12: consecutive failures, counted over ranges of (user, time)."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    runs = scans.run_lengths(e, ["user_id"], ["ts", "event_id"], "bad").rows
    return runs.where("bad").groupBy("user_id").agg(F.max("run").alias("longest_failure_run"))


@query("win13_rotation", "SELECT doc_id, (2 + row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS style_turn FROM documents")
def win13(spark, d):
    """WIN-13: a rotating index within each group."""
    at = joins.group_positions(read(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    return at.select("doc_id", ((F.col("pos") + 2) % 4).alias("style_turn"))


@query("win11_downsample", "SELECT user_id, b, avg(round(value * 100)::BIGINT) / 100 AS mean FROM (SELECT user_id, value, ntile(10) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1, 2")
def win11(spark, d):
    """WIN-11: ten buckets of a curve, the first ones larger by one."""
    e = scans.numbered(read(spark, d, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("c")), ["user_id"], ["ts", "event_id"])
    return e.groupBy("user_id", (cohorts.bucket("pos", "n", 10) + 1).alias("b")).agg((F.avg("c") / 100).alias("mean"))


@query("win11_curve", """WITH b AS (SELECT user_id, b, avg(round(value * 100)::BIGINT) AS m FROM (SELECT user_id, value, ntile(48) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1, 2), t AS (SELECT user_id, max(m) AS top FROM b GROUP BY 1)
SELECT user_id, string_agg(least(9, round_even(m / (CASE WHEN top = 0 THEN 1 ELSE top END) * 9, 0)::INT)::VARCHAR, '' ORDER BY b) AS curve FROM b JOIN t USING (user_id) GROUP BY 1""")
def win11_curve(spark, d):
    """WIN-11: up to 48 buckets of a curve as digits 0 to 9 of its own largest bucket."""
    e = scans.numbered(read(spark, d, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("c")), ["user_id"], ["ts", "event_id"])
    b = e.groupBy("user_id", cohorts.bucket("pos", "n", 48).alias("b")).agg(F.avg("c").alias("m"))  # 48 rows a user
    top = b.groupBy("user_id").agg(F.max("m").alias("top"))
    digit = F.least(F.lit(9), F.bround(F.col("m") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top")) * 9).cast("int")).cast("string")
    digits = b.join(top, "user_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("b", digit.alias("x")))).alias("l"))
    return digits.select("user_id", F.array_join("l.x", "").alias("curve"))


@query("srt06_top_mean", "SELECT user_id, round(avg(value), 4) AS top_mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= greatest(1, floor(n * 0.05)) GROUP BY 1")
def srt06(spark, d):
    """SRT-06: mean of the top twentieth, one at least."""
    e = read(spark, d, "events").select("user_id", "event_id", (-F.col("value")).alias("low"))
    r = scans.numbered(e, ["user_id"], ["low", "event_id"])
    return r.where(F.col("pos") < F.greatest(F.lit(1), F.floor(F.col("n") * 0.05))).groupBy("user_id").agg(F.round(-F.avg("low"), 4).alias("top_mean"))


@query("srt07_numeric_suffix", "SELECT c_custkey, row_number() OVER (ORDER BY coalesce(try_cast(regexp_extract(c_name, '(\\d+)$', 1) AS INT), -1), c_custkey) AS pos FROM customer")
def srt07(spark, d):
    """SRT-07: by the number at the end of the name, over the whole table."""
    n = F.coalesce(F.regexp_extract("c_name", r"(\d+)$", 1).try_cast("int"), F.lit(-1))
    return joins.positions(read(spark, d, "customer").select("c_custkey", n.alias("n")), ["n", "c_custkey"]).select("c_custkey", (F.col("pos") + 1).alias("pos"))


@query("srt09_first_healthy", "SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal < 5000, s_suppkey)) AS chosen FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def srt09(spark, d):
    """SRT-09: the first healthy primary, else the first healthy one."""
    return read(spark, d, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct(F.col("s_acctbal") < 5000, "s_suppkey")).alias("chosen"))


@query("srt10_first_blocked", "SELECT conv_id, arg_min(turn, turn) AS turn, arg_min(length(text), turn) AS n_chars FROM conversations WHERE contains(lower(text), 'secret') OR length(text) > 900 GROUP BY 1")
def srt10(spark, d):
    """SRT-10: the first blocked prompt of each request, in order."""
    blocked = F.contains(F.lower("text"), F.lit("secret")) | (F.length("text") > 900)
    return read(spark, d, "conversations").where(blocked).groupBy("conv_id").agg(F.min_by("turn", "turn").alias("turn"), F.min_by(F.length("text").cast("bigint"), "turn").alias("n_chars"))


@query("srt11_page", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS back FROM events) WHERE back <= 2000 ORDER BY event_id OFFSET 500")
def srt11(spark, d):
    """SRT-11: a ring buffer of the last two thousand lines, from an offset on."""
    return read(spark, d, "events").select("event_id").orderBy(F.desc("event_id")).limit(2000).orderBy("event_id").offset(500)


@query("join12_dimension", "SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'basic' ELSE 'gold' END AS tier, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join12(spark, d):
    """JOIN-12: small keyed dimensions: a literal table of tiers and the nations."""
    tiers = spark.createDataFrame([(-1, "debt"), (0, "basic"), (1, "gold")], "band int, tier string")
    band = F.when(F.col("c_acctbal") < 0, -1).when(F.col("c_acctbal") < 5000, 0).otherwise(1)
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", band.alias("band"))
    return c.join(F.broadcast(tiers), "band").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "tier", "n_name")


@query("join14_zip_arguments", "SELECT p_partkey, i::INT AS i, prompt, seeds[i + 1] AS seed, 24 AS fps FROM (SELECT p_partkey, string_split(p_name, ' ') AS prompts, list_transform(string_split(p_name, ' '), lambda x: length(x)) AS seeds FROM part), LATERAL (SELECT unnest(prompts) AS prompt, unnest(range(len(prompts))) AS i)")
def join14(spark, d):
    """JOIN-14, UDF-10: list arguments go one to a sample, scalars to all; lists of other lengths fail."""
    prompts = F.split("p_name", " ")
    p = read(spark, d, "part").select("p_partkey", prompts.alias("prompt"), F.transform(prompts, lambda x: F.length(x).cast("bigint")).alias("seed"), F.lit(24).alias("fps"))
    return joins.zip_arguments(p, ["p_partkey"], ["prompt", "seed"], ["fps"])


@query("join17_listing", "SELECT url AS name, CASE WHEN page_id % 3 = 0 THEN 'caption ' || page_id END AS caption FROM pages")
def join17(spark, d):
    """JOIN-17: files with their captions where there is one; files without stay."""
    p = read(spark, d, "pages")
    captions = p.where("page_id % 3 = 0").select("page_id", F.concat(F.lit("caption "), F.col("page_id").cast("string")).alias("caption"))
    return p.select("page_id", F.col("url").alias("name")).join(captions, "page_id", "left").select("name", "caption")


@query("join18_incremental", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL)")
def join18(spark, d):
    """JOIN-18: inputs whose output is there already are left out."""
    return joins.to_do(read(spark, d, "documents"), read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id").select("doc_id")


@query("set07_labelled_splits", "SELECT 'train' AS split, o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 'heldout', o_orderkey FROM orders WHERE o_orderkey % 10 = 0")
def set07(spark, d):
    """SET-07: disjoint splits, one after the other, with their names."""
    o = read(spark, d, "orders").select("o_orderkey")
    parts = {"train": o.where("o_orderkey % 10 <> 0"), "heldout": o.where("o_orderkey % 10 = 0")}
    return joins.labelled_union(parts, "split")


@query("agg29_filter_values", "SELECT 'lang' AS field, lang AS v FROM documents WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT 'source', source FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def agg29(spark, d):
    """AGG-29: the distinct values that filters offer, field by field."""
    return read(spark, d, "documents").select("lang", "source").unpivot([], ["lang", "source"], "field", "v").where("v is not null").distinct()


@query("agg33_chunk_intervals", "SELECT user_id, count(gap) AS n, min(gap) AS min, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.95), 6) AS p95, max(gap) AS max FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000::DOUBLE AS gap FROM events) GROUP BY 1")
def agg33(spark, d):
    """AGG-33: intervals between a session's chunks, in milliseconds."""
    e = read(spark, d, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = scans.previous(e, ["user_id"], ["ts", "event_id"], b=F.col("t")).select("user_id", ((F.col("t") - F.col("b")) / 1000).alias("gap"))
    return cohorts.summarised(g, ["user_id"], "gap").drop("p99", "mean")


@query("hsh05_content_digest", "SELECT page_id, sha256(html) AS digest FROM pages WHERE html IS NOT NULL")
def hsh05(spark, d):
    """HSH-05: the digest of each file's content."""
    return read(spark, d, "pages").where("html is not null").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


@query("strf09_longest_offender", "SELECT source, count(*) AS n, arg_max(doc_id, (n_chars, -doc_id)) AS longest FROM documents WHERE regexp_matches(lower(text), '\\b(password|http|license)\\b') GROUP BY 1")
def strf09(spark, d):
    """STRF-09: texts with a marker word, and the longest of each group."""
    hit = F.lower("text").rlike(r"\b(password|http|license)\b")
    return read(spark, d, "documents").where(hit).groupBy("source").agg(F.count("*").alias("n"), F.max_by("doc_id", F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("longest"))
