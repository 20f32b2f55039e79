"""Each stage against brute force on its own input."""

import base64
import hashlib
import re

import corpus_pipeline as p
import public_tokenizers
import test_decontaminate as dec
import test_jaccard as jac
import test_secret_scan as sec
import tiktoken

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(90001, None, None, None, None), (90002, "!! 12", "en", "s", 5), (None, "the text of no one", "en", "s", 18)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    seen = [docs.collect()]
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
    raw, lang, near, clean, safe, tokens = seen

    ids = lambda rows: sorted((r.doc_id for r in rows), key=str)
    dropped = set(ids(raw)) - set(ids(lang))
    assert {90001, 90002} <= dropped and len(dropped) <= 0.15 * len(raw)

    groups = {}
    for i, _, low in jac.brute(lang, 5, 80):
        groups.setdefault(("id", low) if low is not None else ("none", i), []).append(i)
    assert ids(near) == sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert ids(clean) == sorted((x[0] for x in dec.brute(near, items) if not x[5]), key=str)

    text = {r.doc_id: r.text for r in clean}
    extra = [(re.compile(r.pattern), r.least) for r in sec.s.MORE_RULES]
    for r in safe:
        t = text[r.doc_id]
        spans = sorted([s for v in sec.spans(t).values() for s in v] + [m.span() for rx, n in extra for m in rx.finditer(t) if len(m.group()) >= n])
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        assert r.text == out + t[at:] and r.n_chars == len(r.text)
    assert ids(safe) == ids(clean)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = {r.doc_id: r for r in tokens}
    for r in safe:
        assert by_id[r.doc_id].input_ids == enc.encode_ordinary(r.text)
        assert by_id[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
