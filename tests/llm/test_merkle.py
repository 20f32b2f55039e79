import hashlib
import zlib

import common_rows
import pytest

from tessera.llm import merkle as m

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def proof(tree, i):
    """Of each level: the run and the place in it."""
    return [(nodes[(j := i // 16**k) // 16 * 16 : j // 16 * 16 + 16], j % 16) for k, nodes in enumerate(tree[:-1])]


def brute(rows):
    by = {}
    for r in rows:
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        a, b = leaf(r, r.text), leaf(r, r.text.translate(LOW) if tampered and r.text is not None else r.text)
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, a, b, r.doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s])]) for s in sources}
    top, out = levels([trees[s][-1][0] for s in sources]), []
    for n, s in enumerate(sources):
        for i, (_, _, a, b, doc_id) in enumerate(sorted(by[s])):
            path, fold = proof(trees[s], i) + proof(top, n), b
            for run, at in path:
                fold = h(*run[:at], fold, *run[at + 1 :])
            sib = "".join("".join(run[:at] + run[at + 1 :]) for run, at in path)
            out.append((doc_id, a, trees[s][-1][0], top[-1][0], h(sib), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def check(docs):
    got = sorted((tuple(r) for r in m.manifest_report(docs).collect()), key=repr)
    want = brute(docs.collect())
    assert got == want
    return want


def test_nulls_ties_and_sizes(spark):
    more = [(1000 + i, f"Text Ünd {i}", "de", f"s{i % 3}" if i % 2 else "hot", i, None) for i in range(700)]
    more += [(2000 + i, f"T{i}", "en", s, 1, None) for s, n in (("one", 1), ("run", 16), ("over", 17), ("", 2), ("ü", 257)) for i in range(n)]
    want = check(common_rows.frame(spark, more))
    assert {w[6] for w in want} == {True, False} and len({w[2] for w in want}) > 8


@pytest.mark.parametrize("sources", [1, 16, 17, 300])
def test_number_of_sources(spark, sources):
    rows = [(i, f"Text {i}", "en", f"s{i % sources}", 1, None) for i in range(sources + 20)]
    check(spark.createDataFrame(rows, common_rows.SCHEMA).repartition(3))


def test_single_row_empty_table_and_clashing_columns(spark):
    one = spark.createDataFrame([(5, "A", None, None, 1, None)], common_rows.SCHEMA)
    assert check(one)[0][1] == check(one)[0][3]
    assert m.manifest_report(common_rows.empty(spark)).collect() == []
    clash = common_rows.frame(spark).selectExpr("*", "1 AS g", "'x' AS leaf", "2 AS pos", "3 AS at", "4 AS n", "5 AS path", "6 AS root")
    check(clash)
    assert [f.name for f in m.manifest_report(common_rows.empty(spark)).schema] == [f.name for f in m.manifest_report(one).schema]


def test_very_long_text(spark):
    check(spark.createDataFrame([(5, "Ab é" * 1_500_000, "en", "s", 1, None), (6, "B", "en", "s", 1, None)], common_rows.SCHEMA))
