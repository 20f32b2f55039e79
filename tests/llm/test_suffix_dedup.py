import hashlib
import random
from collections import Counter

import common_rows
import numpy as np
import pytest

from tessera.llm import suffix_dedup as d


def brute(rows, match):
    counts = Counter(b[i : i + match] for _, b in rows for i in range(len(b) - match + 1))
    out = []
    for key, b in rows:
        cut = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - match + 1):
            if counts[b[i : i + match]] > 1:
                cut[i : i + match] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cut[:-1]])
        out.append((key, len(b), int(cut.sum()), int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [d.HOT, 1])
def test_against_brute_force(spark, hot):
    docs = common_rows.frame(spark, [(400, "ab" * 600, "en", "s", 1, None), (401, "q" * 20 + "ab" * 250, "en", "s", 1, None)])
    rows = d.dedup_report(docs, hot=hot).collect()
    got = sorted((tuple(r)[:5] for r in rows), key=repr)
    assert all(r.repeated == (r.n_removed > 0) for r in rows)
    assert got == brute([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], d.MATCH)


def test_long_texts(spark):
    """Texts past the size at which they are cut: prose with a passage far apart, and repeated bytes and lines."""
    rng = random.Random(4)
    prose = common_rows.words(rng, 110_000)
    passage = common_rows.words(rng, 150)
    texts = [prose + passage + prose[:1000].upper() + passage, passage + "x", "a" * 700_000, "b" + "a" * 401, "line of a list\n" * 50_000, None]
    assert len(texts[0].encode()) > d._CHUNK
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r)[:5] for r in d.dedup_report(docs).collect()), key=repr)
    assert got == brute([(i, (t or "").encode()) for i, t in enumerate(texts)], d.MATCH)


def test_repeats_side_by_side_are_one_row():
    for text in (b"a" * 300_000, b"line of a list\n" * 20_000):
        row, a, n, off, anchor, digest, reps = d.cut_pieces(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert len(row) <= 3 and int((n * reps).sum()) == len(text) - d.MATCH + 1


def test_empty_table_and_text_output(spark):
    assert d.dedup_report(common_rows.empty(spark)).count() == 0
    base = common_rows.words(random.Random(1), 120)
    docs = spark.createDataFrame([(1, "head " + base), (2, base + " tail"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in d.remove_repeats(docs).collect()}
    assert "head " in got[1] and got[2].endswith(" tail") and len(got[1]) < 20 and got[3] == ""


def test_column_sort_finds_repeats():
    rng = random.Random(2)
    for _ in range(20):
        match, gram = 40, 8
        pool = ["".join(rng.choice("ab cd") for _ in range(rng.randint(30, 120))) for _ in range(4)]
        texts = [b"a" * 90]
        for _ in range(15):
            t = "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 60)))
            for _ in range(rng.randint(0, 3)):
                t += rng.choice(pool)[: rng.randint(10, 120)] + rng.choice("xyz")
            texts.append(t.encode())
        counts = Counter(t[i : i + match] for t in texts for i in range(len(t) - match + 1))
        bounds = np.cumsum([0] + [len(t) for t in texts])
        row, a, n, off, anchor, _, reps = d.cut_pieces(np.frombuffer(b"".join(texts), np.uint8), bounds, match, gram)
        step = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        row, a, n, off, anchor = (np.repeat(c, reps) for c in (row, a, n, off, anchor))
        a = a + step * n
        assert int(n.sum()) == sum(max(0, len(t) - match + 1) for t in texts)
        o = np.argsort(anchor, kind="stable")
        row, a, n, off, anchor = row[o], a[o], n[o], off[o], anchor[o]
        group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
        starts = d.repeated_starts(group, n, off, [texts[r][x : x + k + match - 1] for r, x, k in zip(row, a, n, strict=True)], match, gram)
        got = sorted((int(r), int(x + s)) for r, x, ss in zip(row, a, starts, strict=True) for s in ss)
        assert got == sorted((r, i) for r, t in enumerate(texts) for i in range(len(t) - match + 1) if counts[t[i : i + match]] > 1)
