"""Operator 9's word model against brute force, and word order of trusted words."""

import math
import random
import re
import time
from collections import Counter
from pathlib import Path

import common_rows
import pytest

from tessera.llm import quality, word_model

LABELS = "doc_id long, quality int, toxic int"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\x20\x09-\x0D]+", (text or "").translate(LOW))


def brute(trusted, texts):
    c3 = Counter()
    for w in map(words, trusted):
        if w:
            s = ["<s>", "<s>", *w, "</s>"]
            c3.update(zip(s, s[1:], s[2:]))
    c2 = Counter(g[1:] for g in c3)
    c1 = Counter(g[1:] for g in c2)

    def level(c):
        n = Counter(c.values())
        d = (0.5, 0.75, 0.9)
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(x, 0.05), k) for k, x in ((0.95, 1 - 2 * y * n[2] / n[1]), (1.95, 2 - 3 * y * n[3] / n[2]), (2.95, 3 - 4 * y * n[4] / n[3]))]
        total, taken = Counter(), Counter()
        for g, k in c.items():
            total[g[:-1]] += k
            taken[g[:-1]] += d[min(k, 3) - 1]
        return c, d, total, taken

    levels = [level(c) for c in (c1, c2, c3)]

    def p(g):
        q = 1 / (len(c1) + 1)
        for n, (c, d, total, taken) in enumerate(levels, 1):
            h = g[3 - n : 2]
            if total[h]:
                k = c[g[3 - n :]]
                q = ((k - d[min(k, 3) - 1]) if k else 0) / total[h] + taken[h] / total[h] * q
        return q

    out = []
    for w in map(words, texts):
        s = ["<s>", "<s>", *w, "</s>"]
        out.append(math.exp(-sum(math.log(p(g)) for g in zip(s, s[1:], s[2:])) / (len(w) + 1)) if w else None)
    return out


@pytest.mark.parametrize("hot", [1, 40, word_model.HOT])
def test_perplexity_against_brute_force(spark, hot):
    """With no n-gram broadcast, the frequent ones, and all that are known."""
    rng = random.Random(3)
    trusted = [" ".join(rng.choice(["the", "a", "cat", "dog", "sat.", "Ran", "on", "é,", "mat"]) for _ in range(rng.randint(1, 12))) for _ in range(60)] + [None, ""]
    docs = common_rows.frame(spark, [(900 + i, t, "en", "s", 1, None) for i, t in enumerate(trusted)] + [(990, "The cat !! cat", "en", "s", 1, None)])
    model = word_model.train(spark.createDataFrame([(t,) for t in trusted], "text string"), hot)
    light, few = ({r.key for r in m.select("key").collect()} for m in model)
    assert not light & few and bool(few) == (hot > 1) and len(light) >= word_model.SALTS
    rows = word_model.perplexity(docs.select("doc_id", "text", word_model.F.col("text").alias("t")), model).collect()
    want = brute(trusted, [r.t for r in rows])
    assert len(rows) == docs.count()
    assert [r.perplexity for r in rows] == [w if w is None else pytest.approx(w, rel=1e-9) for w in want]


def test_rounds_share_the_n_grams_and_agree_with_brute_force(spark, monkeypatch):
    """Three rounds, so that signed and unsigned residues differ: every n-gram is in one, and the sums are whole."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "a", "cat", "dog", "sat.", "on", "mat", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(1, 15))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    none = word_model.np.zeros(0, word_model.np.int64), word_model.np.zeros(0)
    of = lambda *turn: {(r.key, r.id): r.n for r in word_model.document_grams(docs, none, *turn).where(f"key not between 0 and {word_model.SALTS - 1}").collect()}
    turns = [of(3, k) for k in range(3)]
    whole = of()
    assert all(turns) and sum(map(len, turns)) == len(whole) and turns[0] | turns[1] | turns[2] == whole
    monkeypatch.setattr(word_model, "ROUNDS", 3)
    monkeypatch.setattr(word_model, "ROUND_ROWS", 1)
    model = word_model.train(docs.where("id < 50").select("text"), 40)
    got = {r.doc_id: r.perplexity for r in word_model.perplexity(docs.withColumnRenamed("id", "doc_id"), model).collect()}
    assert [got[i] for i in range(80)] == [pytest.approx(w, rel=1e-9) for w in brute(texts[:50], texts)]


def test_shuffle_files_go_with_their_step(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(150))) for i in range(400)], "doc_id long, text string")
    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def held():
        return {p: p.stat().st_size for f in folders for p in Path(f).rglob("shuffle_*.data")}

    was = held()
    rows = word_model.perplexity(docs, word_model.train(docs.select("text"), 1))
    for _ in range(40):  # executors remove them by and by
        left = sum(n for p, n in held().items() if p not in was)
        if left < 300_000:
            break
        time.sleep(0.5)
    assert left < 300_000  # sums of a few rows; the n-grams alone shuffle several MB
    assert rows.where("perplexity > 0").count() == 400


def test_what_is_in_every_text_is_not_shuffled(spark):
    """The end of a text, its starts and a word of all texts have no rows that travel; the rest has."""
    texts = spark.createDataFrame([(i, f"same w{i} x{i} y{i}") for i in range(300)], "id long, text string")
    _, few = word_model.train(texts.where("id < 200"), 100)
    hot = {r.key: r.ln for r in few.groupBy("key").agg(word_model.F.sum("ln").alias("ln")).collect()}
    keys = word_model.np.array(sorted(hot))
    got = word_model.document_grams(texts, (keys, word_model.np.array([hot[k] for k in keys]))).groupBy("key").count()
    most = got.where(f"key not between 0 and {word_model.SALTS - 1}").agg(word_model.F.max("count")).first()[0]
    assert 4 <= len(hot) < 10 and most == 1


def test_keys_agree(spark):
    x = [(1, -5, 7), (2**62, -(2**63), -1)]
    cols = [word_model.np.array(c).astype(word_model.np.int64).view(word_model.np.uint64) for c in zip(*x)]
    got = spark.createDataFrame(x, "u long, v long, w long").select(*[word_model.key_column(*"uvw"[3 - n :]).alias(f"k{n}") for n in (1, 2, 3)]).collect()
    for n in (1, 2, 3):
        assert [r[f"k{n}"] for r in got] == word_model.keys(*cols[3 - n :]).view(word_model.np.int64).tolist()


def test_senseless_order_of_trusted_words_is_not_kept(spark):
    rng = random.Random(8)
    parts = [[f"tre{m}ation" for m in ms.split()] for ms in ("bul cor", "dam fel", "gim hov", "jun kal", "lop mir", "nas pev")]  # alike at both ends
    good = [" ".join(rng.choice(p) for _ in range(20) for p in parts) for _ in range(600)]
    salad = [" ".join(rng.sample(t.split(), 120)) for t in good[:40]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + salad)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.quality(docs, spark.createDataFrame([(i, 1, 0) for i in range(600)], LABELS)).collect()}
    assert sum(got[i] for i in range(600)) > 570 and not any(got[i] for i in range(600, 640))


def test_a_rare_language_has_its_own_threshold(spark):
    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(2)) for _ in range(30))
    rows = [(i, text("ab"), "en") for i in range(100)] + [(100 + i, text("äëïöüàèìòùâêîôûçñßøå"), "fr") for i in range(12)] + [(500, text("ab"), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.quality(docs, spark.createDataFrame([(i, 1, 0) for i in range(112)], LABELS)).withColumn("out", quality.remainder("doc_id", quality.FOLDS) == 0).collect()
    limits = {r.lang: r.threshold for r in got}
    out = [r for r in got if r.out and r.lang == "en"]
    assert 2 <= len(out) < 50 and any(r.out for r in got if r.lang == "fr")
    assert max(r.perplexity for r in out) * (1 + quality.STEP) >= limits["en"] and limits["fr"] > limits["de"] > limits["en"]


def test_a_text_at_the_threshold_is_kept(spark):
    """One left-out trusted text is its language's threshold: it stays, and so does an equal text."""
    rows = [(i, "the cat sat on the mat", "en") for i in range(30)] + [(100, "zig zag zog", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(docs, spark.createDataFrame([(i, 1, 0) for i in range(29)], LABELS)).collect()}
    assert all(got[i].kept and got[i].perplexity <= got[i].threshold for i in range(30)) and not got[100].kept
