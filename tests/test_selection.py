"""Selection without a sort, cells that ask at once, balanced labels in row order: against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling as s


@pytest.mark.parametrize("kind", ["plain", "ties", "nulls", "text"])
def test_places(spark, kind, monkeypatch):
    monkeypatch.setattr(s, "ACCURACY", 50)
    rng = random.Random(5)
    n = 2000
    value = {"plain": lambda i: i * 3, "ties": lambda i: 7 if rng.random() < 0.4 else rng.randint(0, 20), "nulls": lambda i: None if rng.random() < 0.3 else rng.randint(0, 999), "text": lambda i: f"{rng.randint(0, 99):03}"}[kind]
    rows = [(value(i), i) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"v {'string' if kind == 'text' else 'long'}, i int").repartition(7)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0 if kind != "text" else r[0], r[1]))
    for places in (s.spread_indices(n, 9), s.spread_indices(n, 7, "middle"), s.stride_indices(n, 11), [0, n - 1, n + 5]):
        got = {r.pos: r.i for r in s.take_positions(df, ["v", "i"], places).collect()}
        assert got == {p: want[p][1] for p in places if p < n}
    assert s.take_positions(df.where("false"), ["v", "i"], [0, 1]).count() == 0


def test_no_sort_of_the_whole_table(spark, monkeypatch):
    seen = []
    placed = s.group_positions
    monkeypatch.setattr(s, "positions", lambda *a: pytest.fail("the whole table is numbered"))
    monkeypatch.setattr(s, "group_positions", lambda df, *a: seen.append(df.count()) or placed(df, *a))
    df = spark.range(100_000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    assert s.take_positions(df, ["v"], s.spread_indices(100_000, 20)).count() == 20 and seen[0] < 5_000


def cells_walk(rows, quota):
    used, out = set(), set()
    for c in sorted({r[0] for r in rows}, key=lambda c: (c is not None, c or 0)):
        free = [u for o, u in sorted({(o, u) for k, u, o in rows if k == c}) if u not in used]
        used |= set(free[:quota])
        out |= {(c, u) for u in free[:quota]}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cells_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), u, rng.choice("abcd") if seed % 2 else f"{u:03}") for u in range(30) for _ in range(3)]
    order = {}
    rows = [(c, u, order.setdefault((c, u), o)) for c, u, o in rows]
    for quota in (1, 3):
        got = {(r.cell, r.unit) for r in s.quota_cells(spark.createDataFrame(rows, "c int, u int, o string"), "c", "u", "o", quota).collect()}
        assert got == cells_walk(rows, quota)
    with pytest.raises(ValueError, match="free units"):
        s.quota_cells(spark.createDataFrame(rows, "c int, u int, o string"), "c", "u", "o", 29, strict=True)


def labels_walk(labels, variants):
    used, out = dict.fromkeys(variants, 0), []
    for i, own in enumerate(labels):
        if own not in variants:
            around = [variants[(i + j) % len(variants)] for j in range(len(variants))]
            own = min(around, key=lambda v: used[v])
        used[own] += 1
        out.append(own)
    return out


@pytest.mark.parametrize(("share", "blocks"), [(0.1, 4), (0.9, 6), (0.5, 1), (0.0, 3)])
def test_labels_equal_the_walk(spark, share, blocks):
    rng = random.Random(1)
    labels = [rng.choices(["b", "c", "?"], [8, 1, 1])[0] if rng.random() < share else None for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, own string").repartition(5)
    got = {r.key: r.variant for r in s.least_used(df, "i", "own", ["a", "b", "c", "d"], blocks).collect()}
    assert [got[i] for i in range(500)] == labels_walk(labels, ["a", "b", "c", "d"])


def test_plans_are_kept(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", i % 5 + 1) for i in range(30)], "k string, n long")
    first = s.packing_plan(files, "k", "n", 3, 1, str(tmp_path)).collect()
    again = s.packing_plan(files.repartition(7), "k", "n", 3, 1, str(tmp_path)).collect()
    assert sorted(first) == sorted(again) and len(list(tmp_path.iterdir())) == 1
    s.packing_plan(files, "k", "n", 3, 2, str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2
    for shard in range(3):
        places = sorted(r.place for r in first if r.shard == shard)
        assert places == list(range(len(places)))


def test_cells_rank_only_near_units(spark, monkeypatch):
    """A round ranks the first units of each cell; cells that use theirs up get further ones; a null unit is none."""
    rng = random.Random(5)
    rows = [(c, u, f"{u:03}") for c in range(8) for u in rng.sample(range(60), 40)]
    df = spark.createDataFrame([*rows, (1, None, "000"), (2, None, "000")], "c int, u int, o string")
    settled, seen = s.settled, []
    monkeypatch.setattr(s, "settled", lambda f: (out := settled(f), seen.append(out.count()))[0])
    monkeypatch.setattr(s, "NEAR_UNITS", 4)
    for quota, near in ((1, 8), (2, 64)):
        seen.clear()
        assert {(r.cell, r.unit) for r in s.quota_cells(df, "c", "u", "o", quota).collect()} == cells_walk(rows, quota)
        assert seen[0] == 320 and max(seen[1:]) <= 8 * near
    assert len(seen) < 20
