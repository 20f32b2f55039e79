"""Sources, sinks, table updates and sessions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.registry import query, read
from tessera.sources import readers, sinks
from tessera.streaming import sessions


@query("src01_file_counts", "SELECT 1 AS files, count(*) AS n FROM lineitem")
def src01(spark, d):
    """SRC-01: files and their rows."""
    counts = readers.file_counts(readers.parquet_tree(spark, f"{d}/lineitem.parquet"))
    return counts.agg(F.count("*").cast("int").alias("files"), F.sum("n").alias("n"))


@query("src02_mixed", "SELECT c_nationkey AS nation, repeat::INT AS repeat, count(*) AS n FROM customer, range(2) t(repeat) GROUP BY 1, 2 UNION ALL SELECT s_nationkey + 100, 0, count(*) FROM supplier GROUP BY 1")
def src02(spark, d):
    """SRC-02: one table twice, another once."""
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    b = read(spark, d, "supplier").select((F.col("s_nationkey") + 100).alias("nation"))
    times = dict(readers.parse_path_specs("a:2,b"))
    return readers.mixed([(a, times["a"]), (b, times["b"])]).groupBy("nation", "repeat").agg(F.count("*").alias("n"))


@query("src03_point_lookup", "SELECT pos, o_orderkey FROM (SELECT o_orderkey, row_number() OVER () - 1 AS pos FROM orders) WHERE pos IN (0, 17, 1499)")
def src03(spark, d):
    """SRC-03: rows by their number over all files, from the footers' counts."""
    return readers.point_lookup(read(spark, d, "orders").select("o_orderkey"), [0, 17, 1499]).select("pos", "o_orderkey")


@query("src15_common", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT conv_id FROM conversations)")
def src15(spark, d):
    """SRC-15."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return readers.common_samples({"a": read(spark, d, "documents"), "b": read(spark, d, "labels"), "c": c}, "doc_id")


@query("src19_synthetic", "SELECT i AS request_id, 'Random prompt ' || i || ' for benchmarking' AS prompt, 832 AS width, 480 AS height FROM range(100) t(i)")
def src19(spark, d):
    """SRC-19."""
    return readers.synthetic_requests(spark, 100)


@query("src20_tree", "SELECT url, trim(split_part(html, '<title>', 2)[1:0] || split_part(split_part(html, '<title>', 2), '</title>', 1)) AS title FROM pages WHERE contains(html, '<title>')")
def src20(spark, d):
    """SRC-20: candidate records from raw files."""
    t = F.split_part(F.split_part("html", F.lit("<title>"), F.lit(2)), F.lit("</title>"), F.lit(1))
    return read(spark, d, "pages").where(F.contains("html", F.lit("<title>"))).select("url", F.trim(t).alias("title"))


@query("src21_store_select", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def src21(spark, d):
    """SRC-21: the newest jobs of a status."""
    o = read(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("src22_tail_slice", "SELECT vec_id, list_sum(list_transform(embedding[-8:], lambda x: (x > 0)::INT))::INT AS n_positive FROM embeddings")
def src22(spark, d):
    """SRC-22: the last eight steps."""
    return read(spark, d, "embeddings").select("vec_id", F.aggregate(F.slice("embedding", -8, 8), F.lit(0), lambda s, x: s + (x > 0).cast("int")).alias("n_positive"))


@query("src23_catalogue", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def src23(spark, d):
    """SRC-23."""
    return read(spark, d, "part").where(F.array_contains(F.split("p_name", " "), "ring")).select("p_partkey")


@query("snk02_file_numbers", "SELECT (pos // 1000) AS file_id, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY 1")
def snk02(spark, d):
    """SNK-02: numbers of files of exactly a thousand rows."""
    f = sinks.file_numbers(read(spark, d, "documents").select("doc_id"), ["doc_id"], 1000)
    return f.groupBy("file_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("snk05_records", "SELECT doc_id::VARCHAR AS id, 'text' AS media_type, 0::BIGINT AS width, 0.0::DOUBLE AS fps, text AS caption, 0 AS n_bytes, '' AS dtype FROM documents")
def snk05(spark, d):
    """SNK-05: a record of every column of the schema, empty where nothing fills it."""
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("text").alias("media_type"), F.col("text").alias("caption"))
    r = sinks.conform(rows, sinks.record_schema(["vae_latent", "text_embedding"]))
    return r.select("id", "media_type", "width", "fps", "caption", F.octet_length("vae_latent_bytes").alias("n_bytes"), F.col("text_embedding_dtype").alias("dtype"))


@query("snk08_document", "SELECT '{\"data\":[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']}' AS value FROM nation")
def snk08(spark, d):
    """SNK-08."""
    return sinks.json_document(read(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("snk14_seed_digests", "SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS digest FROM orders WHERE o_orderstatus = 'P'")
def snk14(spark, d):
    """SNK-14: digests of the staged records."""
    o = read(spark, d, "orders").where("o_orderstatus = 'P'")
    return o.select("o_orderkey", F.sha2(F.to_json(F.struct("o_orderkey", "o_orderstatus")), 256).alias("digest"))


@query("snk15_upsert", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'NEW', 0 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 10000000, 'NEW', 0 FROM customer WHERE c_custkey % 100 = 0")
def snk15(spark, d):
    """SNK-15: rows replaced and added by key."""
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    fresh = c.where("c_custkey % 10 = 0").unionByName(c.where("c_custkey % 100 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000))
    return sinks.upsert(c, fresh.withColumn("c_mktsegment", F.lit("NEW")).withColumn("c_nationkey", F.lit(0)), ["c_custkey"])


@query("snk15_patch", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 7 <> 0")
def snk15_patch(spark, d):
    """SNK-15: allowed columns changed, rows deleted."""
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment"))
    return sinks.delete(sinks.patch(c, new, ["c_custkey"], ["c_mktsegment"]), c.where("c_custkey % 7 = 0").select("c_custkey"), ["c_custkey"])


@query("snk16_migrate", "SELECT s_suppkey, s_nationkey, 0::INT AS priority, 'active' AS status FROM supplier")
def snk16(spark, d):
    """SNK-16: columns added with defaults, one removed."""
    return sinks.migrate(read(spark, d, "supplier").drop("s_name"), {"priority": 0, "status": "active"}, ["s_acctbal"])


_LEGAL = "((b = 'signup' AND event_type IN ('view','click','purchase')) OR (b IN ('view','click') AND event_type IN ('view','click','purchase','error')) OR (b = 'purchase' AND event_type IN ('view','click')) OR (b = 'error' AND event_type IN ('signup','view')))"


@query("str01_illegal_steps", f"SELECT event_id, b AS before FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND NOT {_LEGAL}")
def str01(spark, d):
    """STR-01."""
    return sessions.illegal_steps(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "before")


@query("str02_idle", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING arg_max(event_type, ts) <> 'purchase' AND epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)) > 43200000000")
def str02(spark, d):
    """STR-02: sessions idle for over twelve hours."""
    return sessions.idle_sessions(read(spark, d, "events"), "user_id", "ts", "2024-02-01", 43200, F.col("event_type") == "purchase")


@query("str02_session_report", f"""WITH e AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER w AS b, lag(ts) OVER w AS since, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, 'illegal' AS kind, event_id AS id, b AS before, event_type AS state, epoch_us(ts) AS at FROM e WHERE b IS NOT NULL AND epoch_us(ts) - epoch_us(since) <= 21600000000 AND b <> event_type AND NOT {_LEGAL}
UNION ALL SELECT user_id, 'idle', NULL, NULL, event_type, epoch_us(ts) FROM e WHERE event_type <> 'purchase' AND epoch_us(coalesce(next, TIMESTAMP '2024-02-01')) - epoch_us(ts) > 21600000000""")
def str02_report(spark, d):
    """STR-01, STR-02: illegal steps and sessions idle for over six hours; a later step begins anew."""
    r = sessions.session_report(read(spark, d, "events"), "user_id", "ts", "event_id", "event_type", sessions.TRANSITIONS, ("purchase",), 21600, "2024-02-01")
    return r.withColumn("at", F.unix_micros("at"))


@query("str03_health", """WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, ok ORDER BY ts, event_id) AS g FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ok, g ORDER BY ts, event_id) AS run FROM g), s AS (SELECT *, max(CASE WHEN NOT ok AND run >= 3 THEN 1 ELSE 0 END) OVER w AS failed, count(*) FILTER (WHERE ok) OVER w AS good FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, coalesce(arg_max(CASE WHEN ok THEN 'HEALTHY' ELSE 'UNHEALTHY' END, (ts, event_id)) FILTER (WHERE (ok AND run >= 2) OR (NOT ok AND run >= 3) OR (ok AND good = 1 AND failed = 0)), 'UNKNOWN') AS health FROM s GROUP BY 1""")
def str03(spark, d):
    """STR-03: the health of each user as a replica, from the runs of its outcomes; no list of a key's events."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return sessions.health(e, "user_id", ["ts", "event_id"], "ok", 2, 3)


@query("str04_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def str04(spark, d):
    """STR-04."""
    return sessions.latest_state(read(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("str05_admission", """WITH s AS (SELECT event_id AS id, user_id % 10 AS g, epoch_us(ts) AS a, epoch_us(ts) + round(value * 60000000)::BIGINT AS z FROM events),
e AS (SELECT g, a AS t, 1 AS d, id FROM s UNION ALL SELECT g, z, -1, id FROM s) SELECT g, id, open, open <= 12 AS admitted FROM (SELECT *, (sum(d) OVER (PARTITION BY g ORDER BY t, d, id))::BIGINT AS open FROM e) WHERE d = 1""")
def str05(spark, d):
    """STR-05: open spans at each start."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    s = read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("g"), t.alias("a"), (t + F.round(F.col("value") * 60000000).cast("bigint")).alias("z"))
    return sessions.concurrency(s, "g", "a", "z", 12)


@query("str08_buckets", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def str08(spark, d):
    """STR-08: tumbling windows."""
    t = sessions.tumbling(read(spark, d, "events"), "ts", "1 hour", F.count("*").alias("n"))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("str07_event_log", "SELECT 'u' || user_id AS session_id, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2")
def str07(spark, d):
    """STR-07: log lines as JSON and parsed again."""
    line = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("session_id"), F.col("event_type").alias("event"), F.col("ts").cast("string").alias("ts")))
    rows = read(spark, d, "events").select(F.from_json(line, T.StructType.fromDDL("session_id string, event string, ts string")).alias("r"))
    return rows.groupBy("r.session_id", "r.event").agg(F.count("*").alias("n"))
