"""Queries without SQL, and orders, over their whole tables."""

import re
import unicodedata

from tessera import plans
from tessera.functions import text


def norm(s):
    s = unicodedata.normalize("NFKC", s).lower()
    return re.sub(r"\s+", " ", "".join(c for c in s if c.isspace() or unicodedata.category(c)[0] in "LN")).strip(" ")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
    return row[-1]


def test_character_rate_of_whole_texts(spark, data):
    pairs = [("a" * 70 + "bcd", "a" * 70 + "xyz"), ("Où est-il ?", "ou est il"), ("日本語 です", "日本語でした"), ("", "x"), ("", ""), (None, "é"), ("ﬁn", "fin")]
    got = spark.createDataFrame(pairs, "r string, h string").select("r", "h", text.char_error_rate(text.F.col("r"), text.F.col("h")).alias("x")).collect()
    for r in got:
        a, b = (norm(s or "").replace(" ", "") for s in (r.r, r.h))
        assert r.x == (edits(a, b) / len(a) if a else float(bool(b)))
    turns = {(r.conv_id, r.turn, r.role) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    assert plans.QUERIES["strf05_char_error_rate"](spark, data).count() == sum(r == "user" and (c, t + 1, "assistant") in turns for c, t, r in turns)


def test_normalised_covers_every_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.norm for r in plans.QUERIES["strf03_normalised"](spark, data).collect()}
    want = {r.doc_id: r.text and norm(r.text) for r in docs.collect()}
    assert got == want and any(not r.isascii() for r in want.values() if r)
    odd = spark.createDataFrame([("ＡＢＣ ﬁ ①",), (None,)], "t string").select(text.normalised(text.F.col("t")).alias("n")).collect()
    assert [r.n for r in odd] == ["abc fi 1", None]


def test_orders_and_trends_cover_their_tables(spark, data):
    for name, table, times in (("agg05_trends", "events", 1), ("srt08_undated_last", "events", 1), ("srt07_numeric_suffix", "customer", 1)):
        assert plans.QUERIES[name](spark, data).count() == times * spark.read.parquet(f"{data}/{table}.parquet").count()
    ids = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()}
    assert plans.QUERIES["win09_lagged"](spark, data).count() == 3 * sum(i + 1 in ids for i in ids)
