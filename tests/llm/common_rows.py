"""Rows that every operator on documents must take: nulls, empty and long texts, ties, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit array<int>"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows(seed=5, n=30):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = words(rng, rng.randint(1, 80))
        out.append((i, t, "en", "s", len(t), None))
    base = words(rng, 200)
    near = base.split()
    near[50] = "zzz"
    out += [(100, base, "en", "s", 1, None), (101, base, "en", "t", 1, None), (102, " ".join(near), None, None, None, None)]
    out += [(103, None, None, None, None, None), (104, "", "en", "s", 0, None), (None, base, "en", "s", 1, None), (7, "one other text", "en", "s", 1, None), (100, base, "en", "s", 1, None)]
    out += [(105, words(rng, 9000) + " " + base, "en", "s", 1, None), (106, " \t\n", "en", "s", 3, None), (107, "…𝄞 é", "en", "s", 3, None), (108, "a" * 900, "en", "s", 3, None)]
    return out


def frame(spark, extra=()):
    return spark.createDataFrame(rows() + list(extra), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
