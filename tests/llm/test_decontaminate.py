import hashlib
import re

import common_rows
import pytest

from tessera.llm import decontaminate as d

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for name, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("null" if name is None else str(name))
    out = []
    for r in docs:
        w, hit, found = words(r.text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [d.SHARD_BYTES, 200])
def test_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(d, "SHARD_BYTES", shard)
    texts = {r[0]: r[1] for r in common_rows.rows()}
    long_ = " ".join(texts[100].split()[40:70])
    items = [(1, long_.upper()), (2, "One, OTHER: text"), (2, "repeat"), (3, None), (4, ""), (None, texts[5]), (6, " ".join(texts[8].split()[:10]))]
    docs = common_rows.frame(spark, [(600, "repeat Repeat-repeat", "en", "s", 1, None)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_contamination(docs, bench, shard_bytes=shard)
    got = sorted((tuple(r) for r in (d.contamination_report(docs, bench) if shard > 1000 else found.selectExpr("doc_id", "n_words", "cast(size(hit) as bigint)", "cast(size(items) as bigint)", "sha2(concat_ws(',', array_sort(items)), 256)", "size(hit) > 0")).collect()), key=repr)
    assert got == brute(docs.collect(), items)


def test_removal(spark):
    docs = common_rows.frame(spark, [(600, "keep this: a b c d e f g h i j, and that", "en", "s", 1, None)])
    bench = spark.createDataFrame([(1, "A b c d e f g h i J")], "item_id long, text string")
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and 600 not in [r.doc_id for r in kept.collect()] and kept.count() == docs.count() - 1
    cut = {r.doc_id: r.text for r in d.decontaminate(docs, bench, "spans").collect()}
    assert cut[600] == "keep this: , and that"
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination_report(docs, none).where("contaminated").count() == 0 and d.contamination_report(common_rows.empty(spark), bench).count() == 0
