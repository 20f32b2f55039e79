"""Scans over ranges against plain walks: one user with most rows, nulls, ties of ranges, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cohorts, scans
from tessera.streaming import sessions

SCHEMA = "k string, t int, i int, x double, ok boolean"


def rows(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.randint(0, 40), i, None if i % 11 == 0 else float(rng.randint(0, 99)), rng.random() < 0.6) for i in range(n)] + [("one", 1, 0, 5.0, False)]


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def same(df, column, want):
    got = {(r.k, r.i): r[column] for r in df.collect()}
    assert got == want


@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_against_walks(spark, blocks):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    s = scans.scan(df, ["k"], ["t", "i"], blocks).add(sum=("sum", F.col("x")), prior=("sum", F.col("i"), "before"), top=("max", F.col("x")), low=("min", F.col("i")), seen=("last", F.when(F.col("ok"), F.col("i"))), n=("total", F.lit(1)))
    want, prev, runs = {}, {}, {}
    for k, rs in by_key(data).items():
        total = prior = top = low = seen = before = None
        run, flag = 0, None
        for _, _, i, x, ok in rs:
            total = total if x is None else (total or 0) + x
            top = top if x is None else max(x, top or x)
            low, seen = min(i, i if low is None else low), i if ok else seen
            want[k, i] = (total, prior, top, low, seen, len(rs))
            prior = (prior or 0) + i
            prev[k, i], before = before, x
            run, flag = (run + 1 if ok == flag else 1), ok
            runs[k, i] = run
    got = {(r.k, r.i): (r.sum, r.prior, r.top, r.low, r.seen, r.n) for r in s.rows.collect()}
    assert got == want
    same(scans.previous(df, ["k"], ["t", "i"], blocks, b=F.col("x")), "b", prev)
    same(scans.run_lengths(df, ["k"], ["t", "i"], "ok", blocks).rows, "run", runs)


def test_no_task_has_a_hot_user(spark):
    df = spark.createDataFrame(rows(6000), SCHEMA).repartition(5)
    got = scans.scan(df, ["k"], ["t", "i"], 40)
    most = got.dealt.groupBy("_p").count().agg(F.max("count")).first()[0]
    assert most < 6000 / 10


@pytest.mark.parametrize(("up", "down"), [(2, 3), (1, 1), (4, 2)])
def test_health(spark, up, down):
    data = rows(900, up)
    want = {}
    for k, rs in by_key(data).items():
        state, good, bad = "UNKNOWN", 0, 0
        for *_, ok in rs:
            good, bad = (good + 1, 0) if ok else (0, bad + 1)
            if ok and (state == "UNKNOWN" or state == "UNHEALTHY" and good >= up):
                state = "HEALTHY"
            elif not ok and bad >= down:
                state = "UNHEALTHY"
        want[k] = state
    got = sessions.health(spark.createDataFrame(data, SCHEMA), "k", ["t", "i"], "ok", up, down)
    assert {r.k: r.health for r in got.collect()} == want


@pytest.mark.parametrize("alpha", [0.5, 0.1, 0.001, 0.999, 1.0])
def test_exponential_mean(spark, alpha, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 50)
    data = [(k, t, i, x or 1.5, ok) for k, t, i, x, ok in rows(3000)]
    want = {}
    for k, rs in by_key(data).items():
        a = None
        for _, _, i, x, _ in rs:
            a = x if a is None else (1 - alpha) * a + alpha * x
            want[k, i] = a
    got = {(r.k, r.i): r.background for r in scans.exponential_mean(spark.createDataFrame(data, SCHEMA), ["k"], ["t", "i"], "x", alpha).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-12 * max(1, abs(want[k])) for k in want)


def test_empty_and_buckets(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scans.numbered(empty, ["k"], ["t", "i"]).count() == 0 and scans.exponential_mean(empty, ["k"], ["t"], "x", 0.1).count() == 0
    import numpy as np

    for n in (1, 3, 9, 10, 11, 97):
        want = [b for b, part in enumerate(np.array_split(np.arange(n), min(10, n))) for _ in part]
        got = spark.range(n).withColumn("n", F.lit(n)).select("id", cohorts.bucket("id", "n", 10).alias("b"))
        assert [r.b for r in got.orderBy("id").collect()] == want
