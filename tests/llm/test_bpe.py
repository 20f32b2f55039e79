import base64
import functools
import hashlib

import common_rows
import public_tokenizers
import tiktoken

from tessera.llm import bpe

ODD = ["don't  stop   now\n\n x", "naïve café 你好 🙂🙂 ‍", "  lead and trail  ", "a" * 5000, "\t\r\n \x0b\x0c", "I'll've 12345six", "x = {'a': [1, 2]}; // ok", "é" * 100, "  \xa0　end", "Don'T"]


@functools.cache
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frames(spark):
    docs = common_rows.frame(spark, [(200 + i, t, "en", "s", 1, None) for i, t in enumerate(ODD)])
    return docs, bpe.vocabulary(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_ids_and_round_trip(spark):
    docs, shared = frames(spark)
    enc, want = reference(), []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe.round_trip(docs, shared, with_ids=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert all(len(r.input_ids) == r.n_tokens for r in got)
    assert bpe.round_trip(common_rows.empty(spark), shared).count() == 0


def test_offsets_and_decoding(spark):
    docs, shared = frames(spark)
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    rows = bpe.encode(docs.where("doc_id >= 200"), shared)
    for r in rows.collect():
        t = ODD[r.doc_id - 200]
        ids = reference().encode_ordinary(t)
        raw, at = t.encode(), 0
        for i, a, z in zip(r.input_ids, r.starts, r.ends, strict=True):  # the characters that the token's bytes touch
            token = reference().decode_single_token_bytes(i)
            assert raw[at : at + len(token)] == token and len(t[:a].encode()) <= at and len(t[:z].encode()) >= at + len(token)
            at += len(token)
        assert r.input_ids == ids and at == len(raw)
        assert r.starts[0] == 0 and r.ends[-1] == len(t) and all(a < b for a, b in zip(r.starts, r.ends, strict=True))
    assert {(r.doc_id, r.text) for r in bpe.decode(rows, shared).collect()} <= texts


def test_long_text_is_cut_where_the_pattern_splits(spark):
    docs = spark.createDataFrame([(1, "Über den Wolken, 12 times don't  stop " * 40_000), (2, "é" * 1_200_000), (3, None)], "doc_id long, text string")
    shared = bpe.vocabulary(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(text[1]) > bpe.PIECE
    for r in bpe.round_trip(docs, shared).collect():
        ids = reference().encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    ends = {r.doc_id: r.ends for r in bpe.encode(docs.where("doc_id = 1"), shared).collect()}
    assert ends[1][-1] == len(text[1]) and ends[1] == sorted(ends[1])
