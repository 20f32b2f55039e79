import zlib
from pathlib import Path

import common_rows
import numpy as np
import public_tokenizers
import pytest
from pyarrow import orc
from tokenizers import Tokenizer

from tessera.llm import token_orc as t

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't  STOP now\n\n x", "naïve CAFÉ é 你好 🙂🙂 ‍", "ΣΑΣ ΟΔΟΣ", "İstanbul ŉ ﬁ", "\x1c\x1d a\x85b c", "a" * 5000, "́ ̸= x", "I'll've 12345six", "<|endoftext|> and <|startoftext|>x", "\xa0　end", "  ", "x\x00y"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(rows, library):
    """Of each row in order of its id: doc_id, n_tokens, ids_crc32; whole texts through the library."""
    out = []
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[2]))


def check(docs, shared, library):
    at, want = 0, []
    for doc_id, n, crc in brute(docs.collect(), library):
        want.append((doc_id, at, n, crc))
        at += n
    got = [tuple(r) for r in t.token_report(docs, shared).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("tokens_a_file", [1 << 18, 300])
def test_against_the_library(spark, library, tokens_a_file, monkeypatch):
    monkeypatch.setattr(t, "LEAST_TOKENS", tokens_a_file)
    docs = common_rows.frame(spark, [(200 + i, x, "en", "s", 1, None) for i, x in enumerate(ODD)]).selectExpr("*", "1 AS place", "2 AS start", "3 AS crc")
    check(docs, t.tokenizer(spark, PATH), library)


def test_empty_and_long(spark, library, monkeypatch):
    shared = t.tokenizer(spark, PATH)
    assert t.token_report(common_rows.empty(spark), shared).collect() == []
    docs = spark.createDataFrame([(2, "Über den Wolken, 12 times don't  stop " * 40_000), (1, "é" * 300_000), (3, None)], "doc_id long, text string")
    check(docs, shared, library)


def test_one_id_in_a_third_of_all_rows(spark, library, monkeypatch):
    monkeypatch.setattr(t, "LEAST_TOKENS", 500)
    docs = spark.createDataFrame([(7 if i % 3 == 0 else i, "same text" if i % 2 else f"other {i}") for i in range(900)], "doc_id long, text string").repartition(5)
    check(docs, t.tokenizer(spark, PATH), library)


def test_files(spark, tmp_path, monkeypatch):
    """Stripes, run lengths and Bloom filters are in the files; manifest, lookups and ranges of tokens are whole."""
    monkeypatch.setattr(t, "LEAST_TOKENS", 20_000)
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(map(str, rng.integers(0, 10**6, int(rng.integers(0, 60)))))) for i in range(4000)], "doc_id long, text string").repartition(4)
    path = f"{tmp_path}/ids"
    manifest = t.write(t.encode(docs, t.tokenizer(spark, PATH)), path)
    files = sorted(Path(path).glob("*.orc"))
    rows = {r.doc_id: r.input_ids for r in t.read(spark, path).collect()}
    assert len(files) == manifest.count() > 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stripes = [s for f in files for s in jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf)).getStripes()]
    assert sum(s.getIndexLength() for s in stripes) > 4000  # a filter takes over a byte a row, statistics alone far less
    read = [orc.ORCFile(str(f)) for f in files]
    assert sum(f.nrows for f in read) == 4000 and all(f.nstripes >= 1 and f.row_index_stride == t.ROW_GROUP and f.compression == "ZSTD" for f in read)
    assert [x for f in read for x in f.read(["doc_id"]).column(0).to_pylist()] == list(range(4000))  # files in order of names
    flat = [x for i in range(4000) for x in rows[i]]
    assert sum(f.stat().st_size for f in files) < 4 * len(flat)
    for lo, hi in ((0, 1), (10, 5000), (len(flat) // 2, len(flat) // 2 + 30_000), (len(flat) - 3, len(flat) + 9), (len(flat), len(flat) + 5)):
        got = t.token_range(spark, manifest, lo, hi).orderBy("place").collect()
        assert [x for r in got for x in r.input_ids] == flat[lo:hi] and (not got or got[0].start == lo)
    found = t.lookup(spark, path, [17, 3999, 10**9])
    assert {r.doc_id: r.input_ids for r in found.collect()} == {i: rows[i] for i in (17, 3999)}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    m = manifest.orderBy("range").collect()
    assert m[0].start == 0 and all(a.start + a.tokens == b.start and a.last_key < b.first_key for a, b in zip(m, m[1:], strict=False))


def test_stripes_are_read_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "STRIPE_BYTES", 1 << 16)
    rng = np.random.default_rng(3)
    tokens = spark.createDataFrame([(i, 200, i, rng.integers(0, 49_000, 200).tolist()) for i in range(6000)], "doc_id long, n_tokens long, crc long, input_ids array<int>")
    path = f"{tmp_path}/ids"
    t.write(tokens, path)
    assert max(orc.ORCFile(str(f)).nstripes for f in Path(path).glob("*.orc")) > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        parts = t.read(spark, path)
        assert parts.rdd.getNumPartitions() > 2 and parts.count() == 6000
        assert sorted(r.doc_id for r in parts.select("doc_id").collect()) == list(range(6000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_random_texts_against_the_library(library):
    """Where pieces are cut, with contractions, marks, digits, composed letters and special strings side by side."""
    rng = np.random.default_rng(5)
    bits = ["a", "s", "'", "'s", "'re", "ll", "D", "É", "é", "e", "́", "̸", "×", "÷", "=", "(", ")", ".", ",", "-", "7", "42", " ", "\n", "\xa0", " ", "…", "“", "中", "🙂", "ß", "İ", "ŉ", "ſ", "Σ", "ȡ", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", "\x1c", "\x85", "_", "`", "K", "ɐ"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(6000)] + ["", None]
    encoder = t.Encoder(open(PATH, encoding="utf-8").read())
    for lo in range(0, len(texts), 500):
        part = [x or "" for x in texts[lo : lo + 500]]
        raw = [x.encode() for x in part]
        rows = np.cumsum([0] + [len(x) for x in raw])
        ids, at = encoder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), rows, 1, np.array(["<|" in x for x in part]))
        for i, x in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(x, add_special_tokens=False).ids, 1], x
