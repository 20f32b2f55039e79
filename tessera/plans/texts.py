"""Text, hash and JSON functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans.registry import query, read


@query("strf01_path_safe", "SELECT page_id, CASE WHEN s = '' OR starts_with(s, '.') THEN '_' || s ELSE s END AS safe FROM (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS s FROM pages)")
def strf01(spark, d):
    """STRF-01."""
    return read(spark, d, "pages").select("page_id", text.path_safe(F.col("url")).alias("safe"))


@query("strf02_file_name", r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(substr(text, 1, 100), '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '\s+', ' ', 'g')), ''), 'output') AS name FROM documents""")
def strf02(spark, d):
    """STRF-02."""
    return read(spark, d, "documents").select("doc_id", text.file_name(F.col("text")).alias("name"))


@query("strf03_normalised")
def strf03(spark, d):
    """STRF-03 over every document (DuckDB has no NFKC)."""
    return read(spark, d, "documents").select("doc_id", text.normalised(F.col("text")).alias("norm"))


@query("strf04_cjk", "SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '[぀-ヿ㐀-䶿一-鿿가-힯]')) AS n_cjk, count(*) AS n FROM documents GROUP BY 1")
def strf04(spark, d):
    """STRF-04."""
    return read(spark, d, "documents").groupBy("lang").agg(F.count_if(text.has_cjk(F.col("text"))).alias("n_cjk"), F.count("*").alias("n"))


@query("strf05_wer")
def strf05(spark, d):
    """STRF-05: each answer against the question before it."""
    c = read(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.word_error_rate("ref", "hyp"), 6).alias("wer"))


@query("strf05_char_error_rate")
def strf05_char(spark, d):
    """STRF-05 by characters: the rate of every pair, whole texts in any script (DuckDB's levenshtein counts bytes)."""
    c = read(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.char_error_rate(F.col("ref"), F.col("hyp")), 6).alias("cer"))


@query("strf06_parse", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/(\\d+)', 1) AS lang, try_cast(regexp_extract(url, '/([a-z]{2})/(\\d+)', 2) AS BIGINT) AS number FROM pages")
def strf06(spark, d):
    """STRF-06: parts of a name."""
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(u, r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract(u, r"/([a-z]{2})/(\d+)", 1).alias("lang"), F.regexp_extract(u, r"/([a-z]{2})/(\d+)", 2).try_cast("bigint").alias("number"))


@query("strf07_findall", "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1, 2")
def strf07(spark, d):
    """STRF-07: every id in a raw line."""
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("strf08_sections", "SELECT c_custkey, c_name AS subject, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || ' style' END AS style FROM customer")
def strf08(spark, d):
    """STRF-08: sections by heading; a missing one is null."""
    doc = F.concat(F.lit("Subject: "), F.col("c_name"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("\nStyle:\n"), F.col("c_mktsegment"), F.lit(" style\n"))).otherwise("\n"))
    s = text.sections(F.col("doc"), ["Subject", "Style"])
    return read(spark, d, "customer").withColumn("doc", doc).select("c_custkey", s["Subject"].alias("subject"), s["Style"].alias("style"))


@query("strf10_markers", "SELECT p_partkey, len(list_intersect(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), ['red', 'bolt'])) > 0 AND lower(p_name) <> 'red ring' AS blocked FROM part")
def strf10(spark, d):
    """STRF-10."""
    return read(spark, d, "part").select("p_partkey", text.blocked_by_markers(F.col("p_name"), ["red", "bolt"], ["red ring"]).alias("blocked"))


@query("strf11_markdown", "SELECT p_partkey, replace(p_name, ' ', '\\|') || ' ' || printf('%.2f', p_retailprice) AS cell FROM part")
def strf11(spark, d):
    """STRF-11, SNK-10: escaped cells and fixed precision."""
    return read(spark, d, "part").select("p_partkey", F.concat(text.markdown_cell(F.replace("p_name", F.lit(" "), F.lit("|"))), F.lit(" "), F.format_string("%.2f", "p_retailprice")).alias("cell"))


@query("strf12_progress", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (user_id % 101)::INT ELSE floor((user_id % 20) * 100 / 20.0)::INT END AS percent FROM events")
def strf12(spark, d):
    """STRF-12: a percentage before a bar, or a fraction."""
    line = F.when(F.col("event_id") % 2 == 0, F.format_string("step %d%%|###", F.col("user_id") % 101)).otherwise(F.format_string("at %d/20", F.col("user_id") % 20))
    return read(spark, d, "events").select("event_id", text.percent_of(line).alias("percent"))


@query("strf13_short", "SELECT page_id, CASE WHEN trim(url) = '' THEN 'legacy' WHEN length(trim(url)) <= 14 THEN trim(url) ELSE substr(trim(url), 1, 12) END AS short FROM pages")
def strf13(spark, d):
    """STRF-13."""
    return read(spark, d, "pages").select("page_id", text.short_value(F.col("url")).alias("short"))


@query("strf15_slashes", "SELECT page_id, regexp_replace(replace(url, '/', '//'), '/+', '/', 'g') AS path FROM pages")
def strf15(spark, d):
    """STRF-15."""
    return read(spark, d, "pages").select("page_id", F.regexp_replace(F.replace("url", F.lit("/"), F.lit("//")), r"/+", "/").alias("path"))


@query("strf16_scores", "SELECT event_id, (user_id % 5)::INT AS visual, (user_id % 4)::INT AS temporal, (user_id % 3)::INT AS factual FROM events")
def strf16(spark, d):
    """STRF-16: three scores from an answer in free text."""
    doc = F.format_string("VISUAL quality: %d\n temporal: %d,\nFactual = %d", F.col("user_id") % 5, F.col("user_id") % 4, F.col("user_id") % 3)
    rule = r"(?is)visual.*?(\d+).*?temporal.*?(\d+).*?factual.*?(\d+)"
    return read(spark, d, "events").select("event_id", *[F.regexp_extract(doc, rule, i).cast("int").alias(n) for i, n in enumerate(("visual", "temporal", "factual"), 1)])


@query("strf17_revision", "SELECT doc_id, sha1(doc_id::VARCHAR) AS revision FROM documents")
def strf17(spark, d):
    """STRF-17: a forty-digit revision after the @ of an address."""
    uri = F.concat(F.lit("hub://models/x@"), F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lit("/config.json"))
    return read(spark, d, "documents").select("doc_id", F.regexp_extract(uri, r"@([0-9a-f]{40})(?:/|$)", 1).alias("revision"))


@query("strf18_slug", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_brand || ' - ' || p_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'preset') AS slug FROM part")
def strf18(spark, d):
    """STRF-18."""
    return read(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" - ", "p_brand", "p_name")).alias("slug"))


@query("hsh01_canonical", "SELECT event_id, '{\"a\":\"' || user_id || '\",\"k\":\"' || event_type || '\"}' AS doc FROM events")
def hsh01(spark, d):
    """HSH-01: keys in order, whatever order they came in."""
    m = F.create_map(F.lit("k"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string"))
    return read(spark, d, "events").select("event_id", text.canonical_json(m).alias("doc"))


@query("hsh01_canonical_nested", "SELECT event_id, '{\"a\":[1,{\"b\":2,\"c\":' || user_id || '}],\"z\":null}' AS doc FROM events")
def hsh01_nested(spark, d):
    """HSH-01 for nested documents."""
    doc = F.concat(F.lit('{"z": null, "a": [1, {"c": '), F.col("user_id").cast("string"), F.lit(', "b": 2}]}'))
    return read(spark, d, "events").select("event_id", text.canonical_json_text(doc).alias("doc"))


@query("hsh02_fingerprint", "SELECT fp, count(*) AS n FROM (SELECT sha256('{\"t\":\"' || event_type || '\",\"u\":\"' || (user_id % 10) || '\"}') AS fp FROM events) GROUP BY 1")
def hsh02(spark, d):
    """HSH-02: what changes from run to run is left out of the digest."""
    m = F.create_map(F.lit("u"), (F.col("user_id") % 10).cast("string"), F.lit("t"), F.col("event_type"), F.lit("ts"), F.col("ts").cast("string"))
    return read(spark, d, "events").groupBy(text.fingerprint(m, ["ts"]).alias("fp")).agg(F.count("*").alias("n"))


@query("hsh03_profile", "SELECT DISTINCT s_nationkey, 'hw-' || substr(sha256('{\"n\":\"' || s_nationkey || '\"}'), 1, 16) AS id FROM supplier")
def hsh03(spark, d):
    """HSH-03."""
    m = F.create_map(F.lit("n"), F.col("s_nationkey").cast("string"))
    return read(spark, d, "supplier").select("s_nationkey", text.profile_id("hw", m).alias("id")).distinct()


@query("hsh04_order_key", "SELECT doc_id, sha1(source || '/' || doc_id) AS key FROM documents")
def hsh04(spark, d):
    """HSH-04."""
    return read(spark, d, "documents").select("doc_id", F.sha1(F.concat_ws("/", "source", F.col("doc_id").cast("string")).cast("binary")).alias("key"))


@query("prj05_flatten", "SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events")
def prj05(spark, d):
    """PRJ-05: one level of a nested document becomes columns."""
    return read(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query("prj06_candidates", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_name END), ''), p_brand) AS name FROM part")
def prj06(spark, d):
    """PRJ-06: the first field that is not blank."""
    return read(spark, d, "part").select("p_partkey", text.candidate(F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_name")), F.col("p_brand")).alias("name"))


@query("prj07_pruned_nulls", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '{\"a\":' || p_partkey || '}' ELSE '{\"a\":' || p_partkey || ',\"b\":' || p_size || '}' END AS doc FROM part")
def prj07(spark, d):
    """PRJ-07: null fields are left out of a row's JSON."""
    row = F.struct(F.col("p_partkey").alias("a"), F.when(F.col("p_partkey") % 2 != 0, F.col("p_size")).alias("b"))
    return read(spark, d, "part").select("p_partkey", F.to_json(row).alias("doc"))


@query("prj09_override", "SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 7 ELSE json_extract_string(props, '$.k')::INT END) AS k FROM events")
def prj09(spark, d):
    """PRJ-09: a nested field set by its dotted path."""
    s = F.struct(F.from_json("props", "k int").alias("sampling"))
    e = read(spark, d, "events").select("event_id", s.alias("config"))
    return e.withColumn("config", F.when(F.col("event_id") % 2 == 0, F.col("config").withField("sampling.k", F.lit(7))).otherwise(F.col("config"))).select("event_id", F.col("config.sampling.k").alias("k"))


@query("prj08_prompt_alias", "SELECT doc_id, coalesce(text, '') AS prompt, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents")
def prj08(spark, d):
    """PRJ-08: the caption under the name of a prompt, with the details a record has, empty for the others."""
    return read(spark, d, "documents").select("doc_id", *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (("text", "prompt"), ("lang", "lang"), ("source", "source"))])


@query("hsh06_json_paths", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')::INT ELSE -1 END AS k, 'none' AS missing FROM events")
def hsh06(spark, d):
    """HSH-06: nested fields by path, with a default."""
    doc = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit("}}"))).otherwise('{"a": []}')
    return read(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(doc, "$.a.b.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object(doc, "$.a.c"), F.lit("none")).alias("missing"))


@query("strf14_captions", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'first part, ' || source ELSE 'a much longer text ' || doc_id END AS caption FROM documents")
def strf14(spark, d):
    """STRF-14: captions of records of unknown shape: a known key, lists joined, else the longest string."""
    i = F.col("doc_id")
    record = F.when(i % 3 == 0, F.to_json(F.struct(F.col("text").alias("caption"), F.lit("x").alias("other")))).when(i % 3 == 1, F.to_json(F.struct(F.array(F.lit("first part"), F.col("source")).alias("captions")))).otherwise(F.to_json(F.struct(F.lit("short").alias("a"), F.concat(F.lit("a much longer text "), i.cast("string")).alias("b"))))
    return read(spark, d, "documents").select("doc_id", text.caption_of(record).alias("caption"))
