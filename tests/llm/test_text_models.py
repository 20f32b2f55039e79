"""Operators 5, 6 and 9: held-out accuracy on the small tables, and rows at the edges."""

import math
import random

import common_rows
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import langid, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_language_accuracy(spark, docs):
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out and r.lang]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_language_edges(spark, docs):
    odd = [(9001, None, None, None, None), (9002, "", None, None, None), (9003, "123 !?", "en", None, None), (None, "the", None, None, None), (9004, "x" * 300_000, None, None, None)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(both).where("doc_id > 9000 or doc_id is null").collect()}
    assert got[9001] == got[9002] == got[9003] == ("und", 0.0) and got[9004][0] != "und" and None in got
    assert langid.language_id(common_rows.empty(spark)).count() == 0
    unlabelled = common_rows.frame(spark).withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}
    kept = langid.keep_identified(both, langid.learn(both))
    assert kept.columns == both.columns and not {9001, 9002, 9003} & {r.doc_id for r in kept.collect()}


def brute_bayes(learned, texts):
    """Naive Bayes over the same buckets, character by character."""
    letter = lambda c: (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
    mask = 0xFFFFFFFF

    def buckets(text):
        codes = [ord(letter(c)) for c in text]
        for order in range(1, 5):
            for i in range(len(codes) - order + 1):
                acc = order * 0x51ED270B & mask
                for k in range(order):
                    acc = (acc ^ codes[i + k]) * int(langid._MULTIPLIERS[k]) & mask
                    acc ^= acc >> 15
                yield acc >> 16

    counts = {}
    for text, lang in learned:
        own = counts.setdefault(lang, {})
        for b in buckets(text):
            own[b] = own.get(b, 0) + 1
    out = []
    for text in texts:
        sums = {}
        for lang, own in sorted(counts.items()):
            total = sum(own.values()) + 0.5 * 65536
            sums[lang] = sum(round(math.log((own.get(b, 0) + 0.5) / total) * (1 << 20)) for b in buckets(text)) / (1 << 20)
        best = max(sums, key=sums.get)
        out.append((best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())) if any(c.isalpha() for c in text) else ("und", 0.0))
    return out


def test_language_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    text = lambda letters: " ".join(word(letters) for _ in range(rng.randint(1, 12)))
    learned = [(text(x), lang) for lang, x in (("aa", "abcde"), ("bb", "bcdéf"), ("cc", "cdeXyz")) for _ in range(20)]
    texts = ["", "a", "12", "bé"] + [text("abcdefXyz") for _ in range(150)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(learned)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 7, 200):
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(rows.repartition(parts), model).collect()}
        for i, (lang, score) in enumerate(brute_bayes(learned, texts)):
            assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9), texts[i]


def test_language_parts_of_long_texts(spark, monkeypatch):
    """A text that is cut scores as one that is not, alone or among others."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abé d") for _ in range(5)) for _ in range(n)) for n in (1, 3, 60, 200)]
    model = langid.learn(spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    whole = [langid.score_column(pa.array([t]), *model) for t in texts]
    for piece in (1, 3, 7, 64):
        monkeypatch.setattr(langid, "PIECE", piece)
        names, scores = langid.score_column(pa.array(texts), *model)
        assert names == [w[0][0] for w in whole] and list(scores) == [w[1][0] for w in whole]


def test_toxicity_accuracy(spark, docs, labels):
    y = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(y[r.doc_id], r.predicted) for r in toxicity.toxicity(docs, labels).collect() if r.held_out and r.doc_id in y]
    hits, found, real = sum(a and b for a, b in rows), sum(b for _, b in rows), sum(a for a, _ in rows)
    assert hits >= 0.5 * real and hits >= 0.8 * found


def test_toxicity_locates_sentences(spark):
    good, bad = ["The sun is up", "We walk home", "Tea is warm"], "You vile zork"
    rows = [(i, ". ".join(good[i % 3 :] + ([bad] if i % 2 else []) + good[: i % 3]) + ".") for i in range(200)]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(None, 1, 1), (5, 1, None)], LABELS)
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].score > 0.5 for i in range(1, 200, 2)) and all(got[i].score < 0.3 for i in range(0, 200, 2))
    text = dict(rows)[1].encode()
    assert [text[s.start : s.end].decode() for s in got[1].offending] == [bad]
    assert got[900].score == got[901].score == 0.0 and got[None].score > 0.5


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.toxicity(common_rows.frame(spark), none).collect()
    assert len(rows) == len(common_rows.rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(common_rows.empty(spark), none).count() == 0


def test_quality_separates(spark, docs, labels):
    q = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert np.mean([r.kept for r in rows if q.get(r.doc_id) == 1]) > 0.97
    assert np.mean([r.kept for r in rows if q.get(r.doc_id) == 0]) < 0.3


def test_quality_without_labels(spark):
    rows = quality.quality(common_rows.frame(spark), spark.createDataFrame([], LABELS)).collect()
    assert all(r.kept == (r.perplexity is not None) for r in rows) and len(rows) == len(common_rows.rows())
    assert quality.quality(common_rows.empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_noisy_or_against_brute_force(spark):
    """A document's score is 1 - prod(1 - p) over its sentences, each p from its own distinct features."""
    rng = np.random.default_rng(3)
    w, bias = rng.random(1 << toxicity.BITS).astype(np.float32), -2.0
    parts = [["One two, three"], ["Ab cd ef", "Gh ij kl", "abcdefgh"], ["x"] * 5, ["Straße größer", "no"]]
    docs = spark.createDataFrame([(i, ". ".join(p) + ".") for i, p in enumerate(parts)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, (w, bias)).collect()}
    for i, sentences in enumerate(parts):
        clean = 1.0
        for one in sentences:
            data = np.frombuffer(one.encode(), dtype=np.uint8)
            _, features, *_ = toxicity.sentences(data, np.array([0, len(data)]))
            clean *= 1 - 1 / (1 + math.exp(-(bias + sum(float(w[f]) for f in set(features.tolist())))))
        assert got[i].score == pytest.approx(1 - clean, abs=1e-6) and got[i].n_sentences == len(sentences)
