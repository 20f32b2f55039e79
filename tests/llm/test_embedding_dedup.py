import common_rows  # noqa: F401
import numpy as np
import pytest

from tessera.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int"


def table():
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 5)):
                rows.append((i, (base * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.uniform(0, 0.25)).tolist(), label))
                i += 1
    one = [1.0] * 16
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] + one[1:], 1), (904, [None] + one[1:], 1), (905, one, 1), (906, one, 1), (None, one, 1), (905, one, 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, one, None), (910, [float("inf")] + one[1:], 1)]
    return rows


def brute(rows, t):
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = {i: np.array(rows[i][1], dtype=np.float32).astype(float) for i in good}
    for i in good:
        for j in good:
            a, b = unit[i], unit[j]
            if i < j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], n[i], low.get(find(i)), r[0] == low.get(find(i))) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("t", "tile"), [(0.98, e.TILE), (0.9, 5)])
def test_against_brute_force(spark, t, tile):
    rows = table()
    got = sorted((tuple(r) for r in e.embedding_links(spark.createDataFrame(rows, SCHEMA).repartition(3), t, tile).collect()), key=repr)
    want = brute(rows, t)
    assert got == want and sum(r[1] for r in want) > 20


def test_empty_table(spark):
    assert e.embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_keys_and_clashing_columns(spark):
    """One vector in a third of all rows, another third that links with nothing, and one component of many."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(i, base.tolist(), 1) for i in range(150)] + [(200 + i, None if i % 2 else [0.0] * 16, 1) for i in range(150)]
    rows += [(400 + i, (base + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(100)] + [(600 + i, rng.normal(size=16).tolist(), 1) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS nid", "2 AS key", "3 AS w", "4 AS size", "5 AS root", "6 AS component")
    got = sorted((tuple(r) for r in e.embedding_links(df).collect()), key=repr)
    assert got == brute(rows, 0.98)
