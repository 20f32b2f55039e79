"""Validation, filtering, sampling and sharding of datasets; ``documents`` stands for media samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import filters, joins, sampling, scans
from tessera.plans.registry import query, read

SEED = 42


def _media(spark, d):
    """Samples made of documents: a path by id, a caption, a rate and a duration, some of them missing."""
    i = F.col("doc_id")
    return read(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("s"), i, F.when(i % 3 == 0, ".jpg").when(i % 3 == 1, ".mp4").otherwise(".txt")).alias("path"),
        F.when(i % 7 != 0, F.col("text")).alias("cap"), F.when(i % 5 != 0, 24.0).alias("fps"), (F.col("n_chars") / 100.0).alias("duration"), (F.col("n_chars") % 90).alias("num_frames"))


_MEDIA = """(SELECT doc_id, 's' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.mp4' ELSE '.txt' END AS path, CASE WHEN doc_id % 7 <> 0 THEN text END AS cap, CASE WHEN doc_id % 5 <> 0 THEN 24.0::DOUBLE END AS fps, n_chars / 100.0::DOUBLE AS duration, n_chars % 90 AS num_frames FROM documents)"""


@query("flt01_valid_media", f"SELECT doc_id FROM {_MEDIA} WHERE cap IS NOT NULL AND (path LIKE '%.jpg' OR (path LIKE '%.mp4' AND fps IS NOT NULL))")
def flt01(spark, d):
    """FLT-01."""
    return _media(spark, d).where(filters.valid_media("path", "cap", "duration", "fps")).select("doc_id")


_UNIT = "('0x' || substr(sha1('42/' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("flt02_length", f"SELECT doc_id FROM {_MEDIA} WHERE fps IS NOT NULL AND ceil(fps * duration) / fps <= 2.0 * (81 / 16.0) AND (duration >= 3 OR {_UNIT} >= 0.5)")
def flt02(spark, d):
    """FLT-02, SMP-08: too long goes; of the short ones the half with the lower hashes goes."""
    m = _media(spark, d).where("fps is not null")
    short = F.col("duration") < 3
    return m.where(filters.fits_length(F.col("fps"), F.col("duration"), 81, 16, 2.0) & (~short | filters.kept_by_hash(F.col("doc_id"), SEED, 0.5))).select("doc_id")


@query("flt03_reject_counts", f"SELECT rule, count(*) AS n FROM (SELECT CASE WHEN cap IS NULL OR length(cap) = 0 THEN 'caption' WHEN fps IS NULL OR fps <= 0 THEN 'fps' WHEN num_frames <= 10 THEN 'frames' WHEN duration > 40 THEN 'duration' ELSE 'kept' END AS rule FROM {_MEDIA}) GROUP BY 1")
def flt03(spark, d):
    """FLT-03: rows by the first rule that they fail."""
    c = filters.ValidatorChain({"caption": F.length("cap") > 0, "fps": F.col("fps") > 0}).add_validator("frames", F.col("num_frames") > 10).add_validator("duration", F.col("duration") <= 40)
    return c.counts(_media(spark, d))


@query("flt11_metric_filter", "SELECT d.doc_id, concat_ws('; ', CASE WHEN quality IS NULL THEN 'quality missing' WHEN quality < 1 THEN 'quality below 1' END, CASE WHEN n_chars < 500 THEN 'length below 500' END) AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def flt11(spark, d):
    """FLT-11: why a row fails, empty for rows that pass."""
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return x.select("doc_id", filters.metric_verdict({"quality": (F.col("quality").cast("double"), 1.0), "length": (F.col("n_chars").cast("double"), 500.0)}).alias("reason"))


@query("flt12_report_reason", f"SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN path LIKE '%.txt' THEN 'not deliverable' WHEN num_frames < 17 THEN 'too few frames' WHEN abs(coalesce(fps, 0) - 24) > 1e-6 THEN 'wrong rate' END AS reason FROM {_MEDIA}) GROUP BY 1")
def flt12(spark, d):
    """FLT-12: the first reason, or none."""
    reason = F.coalesce(F.when(F.col("path").endswith(".txt"), "not deliverable"), F.when(F.col("num_frames") < 17, "too few frames"), F.when(F.abs(F.coalesce("fps", F.lit(0.0)) - 24) > 1e-6, "wrong rate"), F.lit("ok"))
    return _media(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("flt13_nonzero_vectors", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0")
def flt13(spark, d):
    """FLT-13: vectors of zeros go."""
    return read(spark, d, "embeddings").where(F.exists("embedding", lambda x: x != 0)).select("vec_id")


@query("flt14_roles", "SELECT role, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY 1")
def flt14(spark, d):
    """FLT-14: reference rows feed set metrics only."""
    return read(spark, d, "conversations").where("role <> 'system'").groupBy("role").agg(F.count("*").alias("n"))


@query("flt15_dimensions", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x IN ('red', 'ring', 'widget')), ',') AS kept FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x IN ('red', 'ring', 'widget'))) > 0")
def flt15(spark, d):
    """FLT-15: rows with a wanted dimension, narrowed to those."""
    kept = F.filter(F.split("p_name", " "), lambda x: x.isin("red", "ring", "widget"))
    return read(spark, d, "part").where(F.size(kept) > 0).select("p_partkey", F.array_join(kept, ",").alias("kept"))


@query("flt16_uniform", "SELECT lang, count(DISTINCT source) = 1 AS uniform FROM documents GROUP BY 1")
def flt16(spark, d):
    """FLT-16: whether all rows of a group follow one convention."""
    return read(spark, d, "documents").groupBy("lang").agg((F.countDistinct("source") == 1).alias("uniform"))


_ORD = "SELECT *, row_number() OVER (ORDER BY sha1('42/' || {k}), {k}) - 1 AS pos FROM {t}"


@query("smp01_batches", f"WITH p AS ({_ORD.format(k='doc_id', t='documents')}), n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, pos % 4 AS shard, (pos // 4) // 8 AS batch FROM p, n WHERE pos < n // 32 * 32")
def smp01(spark, d):
    """SMP-01: seeded permutation, strided shards, full batches."""
    docs = read(spark, d, "documents").select("doc_id")
    return sampling.batches(docs, "doc_id", 8, 4, SEED, docs.count()).select("doc_id", "shard", "batch")


@query("smp04_padded", f"WITH p AS ({_ORD.format(k='c_custkey', t='customer')}), n AS (SELECT count(*) AS n FROM customer), q AS (SELECT c_custkey, pos FROM p UNION ALL SELECT c_custkey, pos + n FROM p, n WHERE pos + n < (n + 47) // 48 * 48) SELECT c_custkey, pos % 6 AS shard, (pos // 6) // 8 AS batch FROM q")
def smp04(spark, d):
    """SMP-04: as many rows of the front again as fill the last batch."""
    s = read(spark, d, "customer").select("c_custkey")
    return sampling.batches(s, "c_custkey", 8, 6, SEED, s.count(), drop_last=False).select("c_custkey", "shard", "batch")


@query("smp05_ranges", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, pos // ((n + 6) // 7) AS worker FROM p")
def smp05(spark, d):
    """SMP-05: contiguous ranges."""
    docs = read(spark, d, "documents").select("doc_id")
    return joins.positions(docs, ["doc_id"]).select("doc_id", sampling.contiguous(F.col("pos"), docs.count(), 7).alias("worker"))


@query("smp08_dropout", f"SELECT doc_id, {_UNIT} < 0.1 AS dropped FROM documents")
def smp08(spark, d):
    """SMP-08: a caption is dropped by seed and index alone, so a resumed run drops the same."""
    return read(spark, d, "documents").select("doc_id", (filters.unit_hash(F.col("doc_id"), SEED) < 0.1).alias("dropped"))


@query("smp09_k_repeat", "SELECT doc_id, copy::INT AS copy FROM (SELECT doc_id FROM documents ORDER BY sha1('42/' || doc_id), doc_id LIMIT 16), range(4) t(copy)")
def smp09(spark, d):
    """SMP-09: sixteen prompts, four copies of each."""
    top = read(spark, d, "documents").orderBy(sampling.order_key(SEED, F.col("doc_id")), "doc_id").limit(16).select("doc_id")
    return sampling.repeat_rows(top, 4)


@query("smp09_rank_batch", "WITH t AS (SELECT doc_id FROM documents ORDER BY sha1('42/' || doc_id), doc_id LIMIT 48), c AS (SELECT doc_id, copy::INT AS copy, row_number() OVER (ORDER BY sha1('43/' || doc_id || '/' || copy), doc_id, copy) - 1 AS pos FROM t, range(4) t(copy)) SELECT doc_id, copy, pos FROM c WHERE pos // 24 = 5")
def smp09_rank(spark, d):
    """SMP-09: the batch of the sixth of eight workers: 48 prompts, four copies each, shuffled and cut."""
    return sampling.k_repeat(read(spark, d, "documents").select("doc_id"), "doc_id", 24, 4, 8, 5, SEED).select("doc_id", "copy", "pos")


@query("smp10_spread", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id FROM p WHERE pos IN (SELECT least(round_even(i * (SELECT max(n) FROM p) / 64.0, 0), (SELECT max(n) FROM p) - 1)::BIGINT FROM range(64) t(i))")
def smp10(spark, d):
    """SMP-10: sixty-four rows, evenly spaced."""
    docs = read(spark, d, "documents").select("doc_id")
    return sampling.take_positions(docs, ["doc_id"], sampling.spread_indices(docs.count(), 64)).select("doc_id")


@query("smp12_midpoints", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id FROM p WHERE pos IN (SELECT floor((i + 0.5) * (SELECT max(n) FROM p) / 30)::BIGINT FROM range(30) t(i))")
def smp12(spark, d):
    """SMP-12: the middles of thirty equal parts."""
    docs = read(spark, d, "documents").select("doc_id")
    return sampling.take_positions(docs, ["doc_id"], sampling.spread_indices(docs.count(), 30, "middle")).select("doc_id")


@query("smp13_round_robin", "SELECT doc_id, depth::INT AS depth FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('42/' || doc_id), doc_id) AS depth FROM documents) ORDER BY depth, source LIMIT 70")
def smp13(spark, d):
    """SMP-13."""
    return sampling.round_robin(read(spark, d, "documents"), "source", "doc_id", SEED, 70).select("doc_id", "depth")


@query("smp14_balanced", "SELECT doc_id, (('0x' || substr(sha1('42/' || lang || '/' || source), 1, 8))::BIGINT + row_number() OVER (PARTITION BY lang, source ORDER BY sha1('42/' || doc_id), doc_id) - 1) % 5 AS variant FROM documents")
def smp14(spark, d):
    """SMP-14: variants rotate within a stratum from an offset by its hash."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", sampling.order_key(SEED, F.col("doc_id")).alias("o"))
    at = joins.group_positions(docs, ["lang", "source"], ["o", "doc_id"])
    return at.select("doc_id", ((sampling.hash_remainder(SEED, 1 << 32, F.col("lang"), F.col("source")) + F.col("pos")) % 5).alias("variant"))


@query("smp14_feasible", """WITH r AS (SELECT doc_id, text LIKE '%http%' AS has_style, n_chars > 60 AS long, ('0x' || substr(sha1('42/' || lang || '/' || source), 1, 8))::BIGINT + row_number() OVER (PARTITION BY lang, source ORDER BY sha1('42/' || doc_id), doc_id) - 1 AS turn FROM documents),
c AS (SELECT doc_id, j, ['depth', 'edges', 'style'][((turn + j) % 3 + 1)::INT] AS v, has_style, long FROM r, range(3) t(j)) SELECT doc_id, arg_min(v, j) FILTER (WHERE (v = 'style' AND has_style) OR (v <> 'style' AND long)) AS variant FROM c GROUP BY 1""")
def smp14_feasible(spark, d):
    """SMP-14: variants rotate within a stratum; one that a row has no source for is passed over."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", sampling.order_key(SEED, F.col("doc_id")).alias("o"), F.contains("text", F.lit("http")).alias("has_style"), (F.col("n_chars") > 60).alias("long"))
    at = joins.group_positions(docs, ["lang", "source"], ["o", "doc_id"])
    feasible = F.array_compact(F.array(F.when(F.col("long"), "depth"), F.when(F.col("long"), "edges"), F.when(F.col("has_style"), "style")))
    turn = sampling.hash_remainder(SEED, 1 << 32, F.col("lang"), F.col("source")) + F.col("pos")
    return at.select("doc_id", sampling.rotated_variant(["depth", "edges", "style"], turn, feasible).alias("variant"))


@query("smp16_stride", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) WHERE pos % greatest(1, n // 50) = 0 ORDER BY pos LIMIT 50")
def smp16(spark, d):
    """SMP-16: every n-th row, fifty at most; the table is not sorted for them."""
    docs = read(spark, d, "documents").select("doc_id")
    return sampling.take_positions(docs, ["doc_id"], sampling.stride_indices(docs.count(), 50)).select("doc_id")


@query("smp17_group_split", "SELECT doc_id, source IN (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS pos FROM (SELECT DISTINCT source FROM documents)) WHERE pos % 5 = 0) AS held_out FROM documents")
def smp17(spark, d):
    """SMP-17: whole groups are held out (the list of groups is a dimension)."""
    docs = read(spark, d, "documents").select("doc_id", "source")
    held = joins.positions(docs.select("source").distinct(), ["source"], blocks=4).where("pos % 5 = 0").select("source", F.lit(True).alias("h"))
    return docs.join(held, "source", "left").select("doc_id", F.coalesce("h", F.lit(False)).alias("held_out"))


@query("smp18_sample", "SELECT doc_id FROM documents ORDER BY sha1('7/' || doc_id), doc_id LIMIT 64")
def smp18(spark, d):
    """SMP-18: sixty-four rows, seeded."""
    return read(spark, d, "documents").orderBy(sampling.order_key(7, F.col("doc_id")), "doc_id").limit(64).select("doc_id")


@query("smp19_resample", "SELECT doc_id, array_to_string(list_slice(list_transform(range(0, ceil(n_chars % 90 / 1.5)::BIGINT), lambda i: floor(i * 1.5)::BIGINT), 1, 17), ',') AS frames FROM documents WHERE n_chars % 90 > 0")
def smp19(spark, d):
    """SMP-19: frames at the training rate, the first seventeen."""
    n = F.col("n_chars") % 90
    places = F.transform(F.sequence(F.lit(0), F.ceil(n / 1.5) - 1), lambda i: F.floor(i * 1.5))
    return read(spark, d, "documents").where(n > 0).select("doc_id", F.array_join(F.slice(places, 1, 17), ",").alias("frames"))


@query("smp20_crop", "SELECT doc_id, substr(text, 1 + (('0x' || substr(sha1('42/' || doc_id), 1, 8))::BIGINT % greatest(length(text) - 50, 1))::INT, 50) AS crop FROM documents")
def smp20(spark, d):
    """SMP-20: a crop of fifty at a place by hash."""
    start = F.lit(1) + sampling.hash_remainder(SEED, F.greatest(F.length("text") - 50, F.lit(1)), F.col("doc_id")).cast("int")
    return read(spark, d, "documents").select("doc_id", F.col("text").substr(start, F.lit(50)).alias("crop"))


@query("smp23_choice", "SELECT p_partkey, list_extract(string_split(p_name, ' '), 1 + (('0x' || substr(sha1('42/' || p_partkey), 1, 8))::BIGINT % len(string_split(p_name, ' '))))  AS word FROM part")
def smp23(spark, d):
    """SMP-23: one caption of a list, by hash."""
    words = F.split("p_name", " ")
    return read(spark, d, "part").select("p_partkey", F.element_at(words, (F.lit(1) + sampling.hash_remainder(SEED, F.size(words), F.col("p_partkey"))).cast("int")).alias("word"))


@query("smp24_frame_subset", "SELECT p_partkey, array_to_string(list_transform(range(0, 5), lambda i: floor(i * (p_size + 7) / 4.0)::BIGINT), ',') AS frames FROM part")
def smp24(spark, d):
    """SMP-24: five frames from the first to the last."""
    n = F.col("p_size") + 8
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (n - 1) / 4.0)), ",").alias("frames"))


@query("smp22_arrivals", "SELECT event_id, round(sum(round(-ln(1 - ('0x' || substr(sha1('42/' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / 2.0 * 1000000)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) / 1000000, 3) AS arrival FROM events")
def smp22(spark, d):
    """SMP-22: arrival times with exponential gaps, by hash."""
    gap = F.round(-F.log(1 - filters.unit_hash(F.col("event_id"), SEED)) / 2.0 * 1000000).cast("bigint")
    e = read(spark, d, "events").select("user_id", "event_id", gap.alias("gap"))
    return scans.scan(e, ["user_id"], ["event_id"]).add(t=("sum", F.col("gap"))).rows.select("event_id", F.round(F.col("t") / 1000000, 3).alias("arrival"))


@query("smp02_packing")
def smp02(spark, d):
    """SMP-02: suppliers as files, their lines as rows, packed on eight shards."""
    files = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return sampling.pack_longest_first(files, "l_suppkey", "n", 8)


@query("smp02_shard_order")
def smp02_order(spark, d):
    """SMP-02: the packed plan, kept and read again, with each shard's own seeded order."""
    files = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    at = joins.scratch(spark, "plans")
    sampling.packing_plan(files, "l_suppkey", "n", 8, SEED, at)
    return sampling.packing_plan(files, "l_suppkey", "n", 8, SEED, at)


@query("smp15_quota_lines", """WITH RECURSIVE p AS (SELECT l_shipdate::DATE - DATE '1900-01-01' AS c, l_suppkey AS u, sha1('42/' || l_suppkey) AS o FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber >= 7 GROUP BY ALL),
d AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT c FROM p)), w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, 0 AS c, []::BIGINT[] AS got UNION ALL
SELECT k, list_concat(used, got), c, got FROM (SELECT w.k + 1 AS k, w.used, d.c, (SELECT coalesce(list(u ORDER BY o, u)[1:2], []) FROM p WHERE p.c = d.c AND NOT list_contains(w.used, p.u)) AS got FROM w JOIN d ON d.k = w.k + 1))
SELECT c AS cell, unnest(got) AS unit FROM w""")
def smp15_lines(spark, d):
    """SMP-15: two suppliers for each day of returned last lines, no supplier on two days; all days ask at once."""
    li = read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber >= 7").select(F.datediff("l_shipdate", F.lit("1900-01-01")).alias("cell"), F.col("l_suppkey").alias("unit")).distinct()
    return sampling.quota_cells(li.withColumn("o", sampling.order_key(SEED, F.col("unit"))), "cell", "unit", "o", 2)


@query("smp15_quota")
def smp15(spark, d):
    """SMP-15: three suppliers of each region's nations, none twice."""
    cells = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("cell"), F.col("s_suppkey").alias("unit"), sampling.order_key(SEED, F.col("s_suppkey")).alias("o"))
    return sampling.quota_cells(cells, "cell", "unit", "o", 3)


@query("smp25_least_used", """WITH RECURSIVE r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 1 END AS own, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier),
w AS (SELECT -1::BIGINT AS i, NULL::BIGINT AS s_suppkey, 0 AS got, [0, 0, 0]::INT[] AS n UNION ALL
SELECT i, s_suppkey, got, list_transform([0, 1, 2], lambda v: n[v + 1] + (v = got)::INT) FROM (SELECT r.i, r.s_suppkey, w.n, coalesce(own, (list_sort(list_transform([0, 1, 2], lambda j: {'c': w.n[((r.i + j) % 3 + 1)::INT], 'j': j}))[1].j + r.i) % 3)::INT AS got FROM w JOIN r ON r.i = w.i + 1))
SELECT s_suppkey AS key, ['oil', 'ink', 'clay'][got + 1] AS variant FROM w WHERE i >= 0""")
def smp25(spark, d):
    """SMP-25: styles of suppliers, balanced in row order; labels that are no style count as none."""
    rows = read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, "ink").when(F.col("s_suppkey") % 5 == 0, "lead").alias("own"))
    return sampling.least_used(rows, "s_suppkey", "own", ["oil", "ink", "clay"])


@query("smp03_equal_shards", f"WITH p AS ({_ORD.format(k='doc_id', t='documents')}), n AS (SELECT min(n) // 8 * 8 AS n FROM (SELECT pos % 7 AS shard, count(*) AS n FROM p GROUP BY 1)) SELECT doc_id, pos % 7 AS shard, pos // 7 AS place FROM p, n WHERE pos // 7 < n.n")
def smp03(spark, d):
    """SMP-03: shards cut to the least one's number of whole batches."""
    docs = read(spark, d, "documents").select("doc_id")
    return sampling.equal_shards(docs, "doc_id", 7, 8, SEED, docs.count())


@query("smp06_strided", "SELECT item_id, (pos % 3)::INT AS shard, pos // 3 AS place FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark)")
def smp06(spark, d):
    """SMP-06: every third entry is one shard's."""
    at = joins.positions(read(spark, d, "benchmark").select("item_id"), ["item_id"])
    return at.select("item_id", (F.col("pos") % 3).cast("int").alias("shard"), F.floor(F.col("pos") / 3).alias("place"))


@query("smp07_one_shard", "WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM p WHERE pos // ((n + 4) // 5) = 2")
def smp07(spark, d):
    """SMP-07: the third of five contiguous shards, by number of shards and index."""
    c = read(spark, d, "customer").select("c_custkey")
    return sampling.one_shard(c, ["c_custkey"], 5, 2, c.count())


@query("smp11_floor_spread", "WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM p WHERE pos IN (SELECT floor(i * ((SELECT max(n) FROM p) / 40::DOUBLE))::BIGINT FROM range(40) t(i))")
def smp11(spark, d):
    """SMP-11: forty rows at whole steps, rounded down."""
    c = read(spark, d, "customer").select("c_custkey")
    return sampling.take_positions(c, ["c_custkey"], sampling.spread_indices(c.count(), 40, "floor")).select("c_custkey")


@query("smp21_epochs", "SELECT epoch, s_suppkey, row_number() OVER (PARTITION BY epoch ORDER BY sha1((42 + epoch) || '/' || s_suppkey), s_suppkey) - 1 AS pos FROM supplier, (SELECT unnest(range(3))::INT AS epoch)")
def smp21(spark, d):
    """SMP-21: three epochs of an endless reader, each with a permutation by its own seed."""
    return sampling.epochs(read(spark, d, "supplier").select("s_suppkey"), "s_suppkey", SEED, range(3))


@query("flt04_data_type", f"SELECT doc_id, cap IS NOT NULL AND length(cap) > 0 AND fps IS NOT NULL AND fps > 0 AND num_frames > 0 AS valid_type, doc_id % 3 <> 2 AND num_frames IS NOT NULL AS valid_size FROM {_MEDIA}")
def flt04(spark, d):
    """FLT-04: whether a sample has a caption, a rate and frames, and both sides of its size."""
    width, height = F.when(F.col("doc_id") % 3 != 2, 832), F.col("num_frames")
    m = _media(spark, d)
    return m.select("doc_id", filters.valid_data_type("cap", "fps", "num_frames").alias("valid_type"), filters.valid_size(width, height).alias("valid_size"))


@query("udf06_added_validators", f"SELECT doc_id FROM {_MEDIA} WHERE cap IS NOT NULL AND length(cap) > 0 AND num_frames > 10 AND duration <= 40")
def udf06(spark, d):
    """UDF-06: rules that the user adds to a chain by name; rows that pass them all."""
    chain = filters.ValidatorChain({"caption": F.length("cap") > 0})
    chain = chain.add_validator("frames", F.col("num_frames") > 10).add_validator("duration", F.col("duration") <= 40)
    return chain.keep(_media(spark, d)).select("doc_id")


@query("udf08_safety", "SELECT doc_id, CASE WHEN l.doc_id IS NULL OR toxic IS NULL THEN 'UNAVAILABLE' WHEN toxic = 1 THEN 'BLOCK' ELSE 'ALLOW' END AS decision FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)")
def udf08(spark, d):
    """UDF-08: a safety score against its threshold; without a score there is no decision."""
    scores = read(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("score"))
    return read(spark, d, "documents").join(scores, "doc_id", "left").select("doc_id", filters.safety_decision(F.col("score"), 0.5).alias("decision"))
