"""The thin queries of the numbered operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, divergence, embedding_dedup, jaccard, langid, merkle, quality, secret_scan, suffix_dedup, token_orc, toxicity, warc
from tessera.llm.common import read


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(_read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_report(_read(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(_read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, _read(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``path`` and ``pattern`` default to the public 50k byte-level vocabulary and its split pattern."""
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents")
    shared = bpe.vocabulary(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    return bpe.round_trip(docs, shared)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_token_orc(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """``path`` defaults to the public 49k vocabulary with word ends."""
    import public_tokenizers

    shared = token_orc.tokenizer(spark, path or public_tokenizers.path("word_bpe_49k.json"))
    return token_orc.token_report(_read(spark, sf_dir, "documents"), shared)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_read(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_token_orc": op11_token_orc,
    "op12_divergence": op12_divergence,
    "op13_merkle": op13_merkle,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
_TAMPERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The classifiers, the tokenizer, the positions of regular expressions and 400-byte strings have no SQL form
#: that ends in time; tests hold those queries against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id FROM s LEFT JOIN c ON c.a = s.doc_id""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND first_id < page_id THEN first_id END AS refers_to FROM p LEFT JOIN f ON f.d = p.d""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
h AS (SELECT doc_id, o.k, o.n, item FROM o JOIN i ON i.n = o.n AND i.g = o.g),
x AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY 1),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op12_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, t, count(*)::HUGEINT AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
k AS (SELECT lang, t, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2 HAVING sum(docs) >= 3),
l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
y AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM z GROUP BY 1, 2),
p AS (SELECT z.lang, z.source, t, n, 1 + 1000000000 * (n + 1) // (y.total + l.v) AS p FROM z JOIN y ON y.lang = z.lang AND y.source = z.source JOIN l ON l.lang = z.lang),
q AS (SELECT k.lang, t, 1 + 1000000000 * (n + 1) // (total + v) AS q FROM k JOIN l ON l.lang = k.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT p.lang, source, 'term', p.t, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.t = p.t WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM e QUALIFY part = 'pair' OR rank <= 200""",
    "op13_merkle": rf"""
WITH RECURSIVE b AS (SELECT i, 0 AS k, i AS c FROM range(256) x(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM b WHERE k < 8),
x AS (SELECT list(c ORDER BY i) AS x FROM b WHERE k = 8),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(a // 256, x.x[xor(a % 256, c) + 1])), 4294967295) % 5 = 0 AS bad FROM documents, x),
l AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || source, '') AS g, {_LEAF.format(_FIELD.format("text"))} AS leaf, CASE WHEN bad THEN {_LEAF.format(_FIELD.format("(" + _TAMPERED + ")"))} END AS altered FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT g, 0 AS lev, pos, n AS m, leaf AS h FROM n UNION ALL SELECT g, lev + 1, pos // 16, (any_value(m) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE m > 1 GROUP BY g, lev, pos // 16),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m FROM t WHERE m = 1),
u AS (SELECT 0 AS lev, pos, m, subroot AS h FROM s UNION ALL SELECT lev + 1, pos // 16, (any_value(m) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE m > 1 GROUP BY lev, pos // 16),
p AS (SELECT r, string_agg(t.h, '' ORDER BY t.lev, t.pos) AS p FROM n JOIN t ON t.g = n.g AND t.m > 1 AND t.pos // 16 = n.pos // (16 ** (t.lev + 1))::BIGINT AND t.pos <> n.pos // (16 ** t.lev)::BIGINT GROUP BY 1),
w AS (SELECT s.g, string_agg(u.h, '' ORDER BY u.lev, u.pos) AS p FROM s JOIN u ON u.m > 1 AND u.pos // 16 = s.pos // (16 ** (u.lev + 1))::BIGINT AND u.pos <> s.pos // (16 ** u.lev)::BIGINT GROUP BY 1),
f AS (SELECT r, g, 0 AS lev, pos, coalesce(altered, leaf) AS h, n AS m FROM n UNION ALL SELECT r, f.g, f.lev + 1, f.pos // 16, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.h END, '' ORDER BY t.pos)), (any_value(f.m) + 15) // 16 FROM f JOIN t ON t.g = f.g AND t.lev = f.lev AND t.pos // 16 = f.pos // 16 WHERE f.m > 1 GROUP BY r, f.g, f.lev, f.pos),
v AS (SELECT r, 0 AS lev, s.pos, f.h, s.m FROM f JOIN s ON s.g = f.g WHERE f.m = 1 UNION ALL SELECT r, v.lev + 1, v.pos // 16, sha256(string_agg(CASE WHEN u.pos = v.pos THEN v.h ELSE u.h END, '' ORDER BY u.pos)), (any_value(v.m) + 15) // 16 FROM v JOIN u ON u.lev = v.lev AND u.pos // 16 = v.pos // 16 WHERE v.m > 1 GROUP BY r, v.lev, v.pos)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(coalesce(p.p, '') || coalesce(w.p, '')) AS proof_sha256, v.h AS folded_root, v.h = u.h AS verified FROM n JOIN s ON s.g = n.g JOIN u ON u.m = 1 JOIN v ON v.r = n.r AND v.m = 1 LEFT JOIN p ON p.r = n.r LEFT JOIN w ON w.g = n.g""",
}
