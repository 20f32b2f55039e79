"""Sources and sinks on real files: each query writes its tables to a new folder of the shared one, then reads
them as the operator does."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays
from tessera.operators import evaluation as ev
from tessera.operators import joins
from tessera.plans.registry import query, read
from tessera.sources import arrow_files, readers, sinks
from tessera.sources.versioned import VersionedTable
from tessera.streaming import sessions


LIST_ROWS = 500
FOLDER_FILES = 1000
ROUND_FOLDERS = 300
FILE_LISTS = 50


def _folder(spark, name: str) -> str:
    """A new folder; it is removed when the driver ends."""
    return joins.scratch(spark, f"files-{name}")


def _json_lists(df, key: str, item, path: str) -> None:
    """JSON lists of about ``LIST_ROWS`` rows, a file each: as many lists as the table needs."""
    cells = -(-df.count() // LIST_ROWS) or 1
    lists = df.groupBy(F.pmod(F.xxhash64(key), F.lit(cells))).agg(F.to_json(F.collect_list(item)).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)


def _lines(df, column, path: str) -> None:
    """One text file of a small table's lines."""
    df.select(column.alias("value")).coalesce(1).write.text(path)


@query("src05_by_suffix", "SELECT 'csv' AS kind, s_suppkey::BIGINT AS k, s_name AS name FROM supplier UNION ALL SELECT 'json', n_nationkey, n_name FROM nation UNION ALL SELECT 'jsonl', c_custkey, c_name FROM customer UNION ALL SELECT 'parquet', p_partkey, p_name FROM part UNION ALL SELECT 'arrow', o_orderkey, o_orderpriority FROM orders")
def src05(spark, d):
    """SRC-05: one reader by suffix."""
    at = _folder(spark, "suffix")
    read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).write.option("header", True).csv(f"{at}.csv")
    sinks.json_document(read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "k").write.text(f"{at}.json")
    read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).write.json(f"{at}.jsonl")
    read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")).write.parquet(f"{at}.parquet")
    arrow_files.register(spark)
    read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("name")).write.format("arrow_ipc").mode("append").save(f"{at}.arrow")
    parts = {s: readers.by_suffix(spark, f"{at}.{s}").select(F.col("k").cast("bigint").alias("k"), "name") for s in ("csv", "json", "jsonl", "parquet", "arrow")}
    return joins.labelled_union(parts, "kind")


@query("src06_annotations", "SELECT 'videos/clip' || p_partkey || '.mp4' AS path, p_name AS cap FROM part")
def src06(spark, d):
    """SRC-06: the list that merge.txt names, paths below its folder."""
    at = _folder(spark, "merge")
    _json_lists(read(spark, d, "part"), "p_partkey", F.struct(F.format_string("clip%d.mp4", "p_partkey").alias("path"), F.col("p_name").alias("cap")), f"{at}/list")
    _lines(spark.range(1), F.lit(f" videos , {at}/list "), f"{at}/merge.txt")
    return readers.annotations(spark, f"{at}/merge.txt", "path string, cap string")


@query("src07_prompt_lines", "SELECT c_name AS prompt FROM customer WHERE c_custkey % 5 <> 0")
def src07(spark, d):
    """SRC-07: one prompt a line, trimmed, blank lines dropped."""
    at = _folder(spark, "prompts")
    c = read(spark, d, "customer")
    c.select(F.when(F.col("c_custkey") % 5 == 0, "   ").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("value")).write.text(at)
    return readers.prompts(spark, at)


@query("src08_built_dataset", "SELECT name, caption, 'data/videos/' || name AS video FROM (SELECT name, caption, row_number() OVER (ORDER BY name) - 1 AS pos FROM (SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS caption FROM part) WHERE caption IS NOT NULL) WHERE pos % 3 = 1")
def src08(spark, d):
    """SRC-08: merged records renamed, filtered, one of three shards, with the place of the video."""
    at = _folder(spark, "merged")
    p = read(spark, d, "part")
    p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("cap")).write.json(at)
    rows = spark.read.schema("path string, cap string").json(at)
    return readers.built_dataset(rows, "data/videos", F.col("caption").isNotNull(), 3, 1)


def _record_files(spark, d, name: str, broken: int | None) -> str:
    """A file of one JSON record for each nation; every ``broken``-th is cut off."""
    at = _folder(spark, name)
    n = read(spark, d, "nation")
    doc = F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    n.select("n_nationkey", (F.when(F.col("n_nationkey") % broken == 0, F.substring(doc, 1, 9)).otherwise(doc) if broken else doc).alias("value")).write.partitionBy("n_nationkey").text(at)
    return at


@query("src09_tolerant_tree", "SELECT n_nationkey::INT AS k, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0")
def src09(spark, d):
    """SRC-09: a record a file, unreadable files left out."""
    return readers.tolerant_json_tree(spark, _record_files(spark, d, "tree", 5), "k int, name string")


@query("src11_strict_scan", "SELECT n_nationkey::INT AS k, n_name AS name FROM nation")
def src11(spark, d):
    """SRC-11: the same without broken files, of which one would fail the query."""
    return readers.strict_json(spark, f"{_record_files(spark, d, 'strict', None)}/*", "k int, name string")


@query("src12_commented_lines", "SELECT p_partkey::INT AS a, p_name AS b FROM part WHERE p_partkey % 7 > 1")
def src12(spark, d):
    """SRC-12: JSON lines between blank ones and comments."""
    at = _folder(spark, "commented")
    k = F.col("p_partkey") % 7
    doc = F.to_json(F.struct(F.col("p_partkey").alias("a"), F.col("p_name").alias("b")))
    read(spark, d, "part").select(F.when(k == 0, " # note").when(k == 1, "").otherwise(doc).alias("value")).write.text(at)
    return readers.commented_jsonl(spark, at, "a int, b string")


@query("src13_csv_records", "SELECT c_custkey::BIGINT AS c_custkey, c_name || ', \"the\" ' || c_mktsegment AS scenario FROM customer")
def src13(spark, d):
    """SRC-13: rows of CSV by column name, quotes and commas inside."""
    at = _folder(spark, "csv")
    read(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "the" '), "c_mktsegment").alias("scenario")).write.option("header", True).option("escape", '"').csv(at)
    return readers.csv_records(spark, at, "c_custkey bigint, scenario string")


@query("src14_zipped_files", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_name AS prompt, 'v' || c_custkey || '.mp4' AS video FROM customer")
def src14(spark, d):
    """SRC-14: prompts and videos by line; files of other lengths fail."""
    at = _folder(spark, "zip")
    c = read(spark, d, "customer").orderBy("c_custkey")
    c.select(F.col("c_name").alias("value")).write.text(f"{at}/prompts")
    c.select(F.format_string("v%d.mp4", "c_custkey").alias("value")).write.text(f"{at}/videos")
    return readers.zipped_files(spark, f"{at}/prompts", f"{at}/videos")


@query("src16_media", "SELECT n_nationkey::INT AS k, CASE WHEN n_nationkey = 7 THEN 0 WHEN n_nationkey BETWEEN 10 AND 19 THEN 1 ELSE 2 END AS spec FROM nation")
def src16(spark, d):
    """SRC-16: a path, a pattern and a folder that holds both: each file once, where it comes first."""
    at = _folder(spark, "media")
    n = read(spark, d, "nation")
    n.select(F.format_string("%02d", F.col("n_nationkey").cast("int")).alias("k"), F.col("n_name").alias("value")).write.partitionBy("k").text(at)
    files = readers.expanded_media(spark, [f"{at}/k=07", f"{at}/k=1*", at], ("txt",))
    return files.select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("int").alias("k"), "spec")


@query("src17_prompt_file", "SELECT 'jsonl' AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'text ' || p_name ELSE p_name END AS prompt FROM part WHERE p_partkey % 4 <> 3 UNION ALL SELECT 'json', CASE WHEN n_nationkey % 3 = 2 THEN 'two ' || n_name ELSE n_name END FROM nation")
def src17(spark, d):
    """SRC-17: entries that are texts, records with prompt or text_prompt, or neither."""
    at = _folder(spark, "entries")
    p, k = read(spark, d, "part"), F.col("p_partkey") % 4
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    entry = F.when(k == 0, quoted(F.concat(F.lit("text "), "p_name"))).when(k == 1, F.to_json(F.struct(F.col("p_name").alias("prompt"), F.lit("x").alias("text_prompt")))).when(k == 2, F.to_json(F.struct(F.col("p_name").alias("text_prompt")))).otherwise('{"other": 1}')
    p.select(entry.alias("value")).write.text(f"{at}.jsonl")
    n, m = read(spark, d, "nation"), F.col("n_nationkey") % 3
    item = F.when(m == 0, quoted(F.col("n_name"))).when(m == 1, F.to_json(F.struct(F.col("n_name").alias("prompt")))).otherwise(F.to_json(F.struct(F.concat(F.lit("two "), "n_name").alias("text_prompt"))))
    _lines(n.agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ",\n"), F.lit("]")).alias("v")), F.col("v"), f"{at}.json")
    return joins.labelled_union({"jsonl": readers.prompt_file(spark, f"{at}.jsonl"), "json": readers.prompt_file(spark, f"{at}.json")}, "kind")


@query("src18_corpora", "SELECT 'benchmark' AS corpus, text AS prompt FROM benchmark UNION ALL SELECT 'parts', p_name FROM part")
def src18(spark, d):
    """SRC-18: corpora of prompts by name."""
    readers.register_corpus("parts", lambda s: read(s, d, "part").select(F.col("p_name").alias("prompt")))
    readers.register_corpus("benchmark", lambda s: read(s, d, "benchmark").select(F.col("text").alias("prompt")))
    return joins.labelled_union({n: readers.corpus(spark, n) for n in readers.corpora()}, "corpus")


@query("src20_segment_tree", "SELECT o_orderpriority[1:1] AS segment, o_orderstatus AS source, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1, 2")
def src20_tree(spark, d):
    """SRC-20: metadata files of segments, each a JSON list of at most ``FILE_LISTS`` records a source, exploded to
    candidates by node, with their provenance."""
    at = _folder(spark, "segments")
    o = read(spark, d, "orders").select(F.concat(F.lit("seg_"), F.substring("o_orderpriority", 1, 1)).alias("seg"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("k"))
    n = o.groupBy("seg", "source").agg(F.ceil(F.count("*") / LIST_ROWS).alias("lists"))  # five priorities, three states
    part = F.pmod(F.xxhash64("k"), "lists")
    met = o.join(F.broadcast(n.toDF("_seg", "_source", "lists")), F.col("seg").eqNullSafe(F.col("_seg")) & F.col("source").eqNullSafe(F.col("_source")))
    nodes = met.groupBy("seg", "source", part.alias("p")).agg(F.collect_list("k").alias("nodes"))
    file = F.floor(F.col("p") / FILE_LISTS).alias("file")
    files = joins.settled(nodes.groupBy("seg", file).agg(F.to_json(F.collect_list(F.struct("source", "nodes"))).alias("value")))
    for r in n.select("seg").distinct().collect():
        files.where(F.col("seg") == r["seg"]).select("value").write.option("maxRecordsPerFile", 1).text(f"{at}/{r['seg']}")
    rows = readers.segment_tree(spark, at, "source string, nodes array<bigint>")
    return rows.groupBy("segment", "source").agg(F.count("*").alias("n"), F.sum("node").alias("keys"))


@query("src15_listing", "SELECT p_partkey AS k, 'condition_' || p_partkey || '.bin' AS condition FROM part WHERE p_size % 3 <> 0 AND p_size % 5 <> 0")
def src15_listing(spark, d):
    """SRC-15: files of three folders, a sample where all have it; latent_X goes with condition_X. Part by size.

    A file system holds only so many files, so samples are written, listed and removed in rounds of about
    ``ROUND_FOLDERS`` folders, each a tree of its own; what a round lists is kept."""
    p = read(spark, d, "part")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = -(-p.count() // FOLDER_FILES) or 1
    rounds = -(-cells // ROUND_FOLDERS)
    cell = F.pmod(F.xxhash64("p_partkey"), F.lit(cells))
    p = p.select("p_partkey", "p_name", "p_size", cell.cast("string").alias("cell"), F.pmod(cell, F.lit(rounds)).cast("int").alias("round"))
    dealt, listed, kinds = _folder(spark, "dealt"), _folder(spark, "listed"), ("latents", "conditions", "audio")
    p.repartition(tasks, "round").write.partitionBy("round").parquet(dealt)
    p = spark.read.schema(p.schema).parquet(dealt)

    def file(folder, prefix):
        return F.concat(F.lit(folder), F.format_string(f"{prefix}%d.bin", "p_partkey"))

    # the file of a renamed sample lies in its source's folder itself; a part's files share their text
    condition = F.when(F.col("p_size") % 3 != 0, file("conditions/", "condition_"))
    audio = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("audio/"), "cell", file("/", "latent_")))
    p = p.withColumns({"name": F.concat(F.lit("latents/"), "cell", file("/", "latent_")), "links": F.array_compact(F.array(condition, audio)), "value": F.col("p_name")})
    for r in range(rounds):
        at, rows = _folder(spark, "sources"), p.where(F.col("round") == r).repartition(tasks, "cell")
        for kind in kinds:
            arrow_files.make_folder(f"{at}/{kind}")
        sinks.write_named(rows, at)
        got = readers.co_listed(spark, at, {"conditions": "c", "audio": "a", "latents": "l"}, ".bin", lists=f"{at}/lists")
        name = F.substring_index("sample", "/", -1)
        got.select(F.regexp_extract(name, r"(\d+)", 1).cast("bigint").alias("k"), F.substring_index("c", "/", -1).alias("condition")).write.mode("append").parquet(listed)
        sinks.remove_named(rows, at)
        joins.remove(spark, at)
    return spark.read.schema("k bigint, condition string").parquet(listed)


@query("snk15_table", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' WHEN c_custkey % 10 = 3 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 100 = 1 THEN 'late' ELSE 'active' END AS status
FROM (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer UNION ALL SELECT c_custkey + 10000000, 'NEW', 0 FROM customer WHERE c_custkey % 100 = 0) WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey + 20000001, 'APPENDED', 1, 'late' FROM customer WHERE c_custkey % 100 = 0""")
def snk15_table(spark, d):
    """SNK-09, SNK-15, SNK-16: a table by commits: upsert, delete, a column with a default, a patch, an append."""
    t = VersionedTable(spark, _folder(spark, "table"))
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    key = ["c_custkey"]
    t.create(c.repartitionByRange(8, "c_custkey"))
    fresh = c.where("c_custkey % 10 = 0").unionByName(c.where("c_custkey % 100 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000))
    t.upsert(fresh.select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(0).cast(c.schema["c_nationkey"].dataType).alias("c_nationkey")), key)
    t.delete(t.read().where("c_custkey % 7 = 0"), key)
    t.add_columns({"status": ("string", "active")})
    t.patch(c.where("c_custkey % 10 = 3").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment")), key, ["c_mktsegment", "status"])
    t.patch(c.where("c_custkey % 100 = 1").select("c_custkey", F.lit("late").alias("status")), key, ["c_mktsegment", "status"])
    t.append(c.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 20000001).alias("c_custkey"), F.lit("APPENDED").alias("c_mktsegment"), F.lit(1).cast(c.schema["c_nationkey"].dataType).alias("c_nationkey"), F.lit("late").alias("status")))
    return t.read()


@query("src21_store", "SELECT o_orderstatus AS status, c_mktsegment AS dataset, count(*) AS n, max(o_orderdate) AS newest FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY 1, 2")
def src21_store(spark, d):
    """SRC-21: tables of a store, selected by SQL."""
    at = _folder(spark, "store")
    for t in ("orders", "customer"):
        read(spark, d, t).write.parquet(f"{at}/{t}")
        spark.read.parquet(f"{at}/{t}").createOrReplaceTempView(f"store_{t}")
    return spark.sql("SELECT o_orderstatus AS status, c_mktsegment AS dataset, count(*) AS n, max(o_orderdate) AS newest FROM store_orders JOIN store_customer ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY 1, 2")


@query("src22_annotated_latents", "SELECT 'v' || vec_id AS name, list_sum(list_transform(embedding[-8:], lambda x: (x > 0)::INT))::INT AS n_positive, ('0x' || substr(sha1('42/v' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 AS dropped FROM embeddings WHERE vec_id % 3 = 0")
def src22_latents(spark, d):
    """SRC-22: a JSON list of names picks latents; their last eight steps, a tenth without condition."""
    at = _folder(spark, "latents")
    e = read(spark, d, "embeddings").select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("latent"))
    _json_lists(e.where("vec_id % 3 = 0"), "name", F.col("name"), at)
    rows = readers.latent_annotations(spark, at, e.drop("vec_id"), 8, 42, 0.1)
    return rows.select("name", F.aggregate("latent", F.lit(0), lambda s, x: s + (x > 0).cast("int")).alias("n_positive"), "dropped")


@query("src23_workloads", "SELECT model, unnest(string_split(loads, ',')) AS workload FROM (VALUES ('small', 't2v,i2v'), ('large', 't2v'), ('fast', 'i2v,v2v')) t(model, loads) WHERE list_contains(string_split(loads, ','), 'i2v')")
def src23_workloads(spark, d):
    """SRC-23: the models of a catalogue that serve a workload, with all that they serve."""
    catalogue = spark.createDataFrame([("small", ["t2v", "i2v"]), ("large", ["t2v"]), ("fast", ["i2v", "v2v"])], "model string, loads array<string>")
    return catalogue.where(F.array_contains("loads", "i2v")).select("model", F.explode("loads").alias("workload"))


# ------------------------------------------------------------------ sinks


def _sizes(files):
    return files.groupBy(F.col("n").alias("rows")).agg(F.count("*").alias("files"))


@query("snk02_fixed_files", "SELECT n AS rows, count(*) AS files FROM (SELECT count(*) AS n FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY pos // 1000) GROUP BY 1")
def snk02_files(spark, d):
    """SNK-02: files of exactly a thousand rows, zstd, read back by file."""
    at = _folder(spark, "fixed")
    sinks.write_fixed(read(spark, d, "documents"), at, ["doc_id"], 1000)
    return _sizes(readers.file_counts(spark.read.parquet(at)))


@query("snk03_worker_chunks", "WITH p AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 40 AS file, (count(*) OVER () + 39) // 40 AS files FROM customer) SELECT (file // ((files + 2) // 3))::INT AS worker, (file % ((files + 2) // 3))::INT AS chunk, count(*) AS n, min(c_custkey) AS first FROM p GROUP BY 1, 2")
def snk03(spark, d):
    """SNK-03: chunks of forty rows, dealt in ranges to three workers' folders."""
    at = _folder(spark, "workers")
    c = read(spark, d, "customer")
    sinks.write_worker_chunks(c, at, ["c_custkey"], 40, 3)
    return readers.worker_chunks(spark, at, c.schema).groupBy("worker", "chunk").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("snk04_flushed", "SELECT count(*) AS n, true AS bounded FROM orders")
def snk04(spark, d):
    """SNK-04: no file has over five hundred rows, and none is lost."""
    at = _folder(spark, "flushed")
    sinks.write_flushed(read(spark, d, "orders"), at, 500)
    return readers.file_counts(spark.read.parquet(at)).agg(F.sum("n").alias("n"), (F.max("n") <= 500).alias("bounded"))


@query("snk06_unfilled", "SELECT unnest(['vae_latent_bytes', 'vae_latent_shape', 'vae_latent_dtype', 'file_name', 'width', 'height', 'num_frames', 'duration_sec', 'fps']) AS field")
def snk06(spark, d):
    """SNK-06: what a record's schema asks for and documents do not fill; a strict call refuses it."""
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("caption"), F.lit("text").alias("media_type"))
    missing = sinks.unfilled(rows, sinks.record_schema(["vae_latent"]))
    return spark.createDataFrame([(m,) for m in missing], "field string")


@query("snk01_empty_table", "SELECT 0 AS n, 'id,caption' AS columns")
def snk01(spark, d):
    """SNK-01: no rows make a table of the full schema."""
    at = _folder(spark, "empty")
    schema = "id string, caption string"
    sinks.conform(spark.createDataFrame([], "id string"), spark.createDataFrame([], schema).schema).write.parquet(at)
    back = spark.read.parquet(at)
    return back.agg(F.count("*").cast("int").alias("n")).withColumn("columns", F.lit(",".join(back.columns)))


@query("snk07_record_files", "SELECT event_type AS model_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def snk07(spark, d):
    """SNK-07: records as JSON below a folder for each model, read back."""
    at = _folder(spark, "records")
    sinks.write_records(read(spark, d, "events").withColumnRenamed("event_type", "model_id"), at, "model_id")
    return spark.read.schema("event_id bigint, model_id string").json(at).groupBy("model_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("snk08_document_lines", "SELECT 0 AS pos, '{\"data\":[' AS line UNION ALL SELECT pos, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' || CASE WHEN pos < n THEN ',' ELSE '' END FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS pos, count(*) OVER () AS n FROM customer) UNION ALL SELECT count(*) + 1, ']}' FROM customer")
def snk08_lines(spark, d):
    """SNK-08 for tables of any size: a document's lines in order."""
    return sinks.json_document_lines(read(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("snk09_manifest", "SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages")
def snk09(spark, d):
    """SNK-09: a manifest of JSON lines, committed as a whole, read back."""
    at = _folder(spark, "manifest")
    html = F.coalesce("html", F.lit(""))
    read(spark, d, "pages").select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("bigint").alias("bytes")).write.json(at)
    return spark.read.schema("page_id bigint, digest string, bytes bigint").json(at)


@query("snk12_tensor_trees", "SELECT vec_id, len(embedding)::INT AS n, embedding[1] AS first, label::INT AS condition FROM embeddings WHERE vec_id % 5 <> 0 AND label IS NOT NULL")
def snk12(spark, d):
    """SNK-12: latents and conditions in tables of their own, joined by key; rows that lack one are left out."""
    at = _folder(spark, "tensors")
    trees = {"latents": "latent", "conditions": "condition"}
    rows = read(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 != 0, arrays.encode_tensor("embedding")).alias("latent"), F.col("label").alias("condition"))
    sinks.write_tensor_trees(rows, at, "vec_id", trees)
    back = sinks.read_tensor_trees(spark, at, "vec_id", trees).withColumn("v", arrays.decode_tensor("latent", F.lit("float32")))
    return back.select("vec_id", F.size("v").alias("n"), F.col("v")[0].alias("first"), F.col("condition").cast("int").alias("condition"))


@query("snk13_results", "SELECT doc_id, 'text.length' AS metric, length(text)::DOUBLE AS score, false AS skipped FROM documents UNION ALL SELECT doc_id, 'media.rate', CASE WHEN n_chars > 1000 THEN n_chars / 24.0::DOUBLE END, n_chars <= 1000 FROM documents")
def snk13(spark, d):
    """SNK-13: scores written as JSON, null ones too, and read back."""
    at = _folder(spark, "results")
    ev.evaluate_rows(read(spark, d, "documents"), ["doc_id"], ev.resolve(["text.length", "media.rate"])).write.option("ignoreNullFields", False).json(at)
    return spark.read.schema("doc_id bigint, metric string, score double, skipped boolean").json(at)


# ------------------------------------------------------------------ logs and resumed readers


@query("str07_log_files", "SELECT 'u' || user_id AS session_id, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2")
def str07_log(spark, d):
    """STR-07: a log of JSON lines that is appended to twice, then read."""
    at = _folder(spark, "log")
    e = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("event"), "event_id")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).drop("event_id").write.mode("append").json(at)
    return spark.read.schema("session_id string, event string").json(at).groupBy("session_id", "event").agg(F.count("*").alias("n"))


@query("str09_incremental_poll", "SELECT event_id, (event_id % 2)::INT AS poll FROM events")
def str09(spark, d):
    """STR-09, STR-11: a streaming reader that stops and goes on from its checkpoint: each poll takes what has come
    since the one before, and nothing twice."""
    at = _folder(spark, "poll")
    e = read(spark, d, "events").select("event_id")
    for poll in (0, 1):
        e.where(F.col("event_id") % 2 == poll).write.mode("append").parquet(f"{at}/in")
        rows = spark.readStream.schema(e.schema).parquet(f"{at}/in").withColumn("poll", F.lit(poll))
        sessions.append_available(rows, f"{at}/out", f"{at}/offsets")
    return spark.read.parquet(f"{at}/out")
