"""Mergeable metrics: one result whatever the partitions; groups of null, skips, empty frames."""

import itertools
import random

import numpy as np
import pytest

from tessera.operators import corpus_metrics as c


def kendall(pairs):
    pairs = [p for p in pairs if None not in p]
    sign = lambda v: (v > 0) - (v < 0)
    s = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for a, b in itertools.combinations(pairs, 2)]
    return sum(x * y for x, y in s) / (sum(bool(x) for x, _ in s) * sum(bool(y) for _, y in s)) ** 0.5


def data():
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 6), rng.choice([None, 1, 2, 3, 4]), [rng.gauss(0, 1), rng.gauss(0, 3), 1.0]) for g in ["a", "b", None] for _ in range(120)]
    return rows + [("flat", 1, 1, [1.0, 2.0, 3.0]), ("flat", 1, 2, [1.0, 2.0, 3.0]), ("bad", None, 1, None), ("bad", None, 2, [float("nan"), 1.0, 2.0])]


def rank(vectors):
    x = np.array([v for v in vectors if v and np.isfinite(v).all()])
    e = np.linalg.eigvalsh(np.cov(x.T))
    p = np.clip(e, 0, None) / np.clip(e, 0, None).sum()
    return float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 64), (7, 2), (200, 5)])
def test_equal_on_any_partitions(spark, parts, fan_in):
    rows = data()
    df = spark.createDataFrame(rows, "g string, x int, y int, v array<double>").repartition(parts)
    got = {(r.g, r.metric): (r.score, r.skipped) for r in c.evaluate_states(df, ["g"], [c.RankCorrelation("x", "y"), c.EffectiveRank("v")], fan_in).collect()}
    assert len(got) == 10
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        assert got[g, "ratings.kendall"][0] == pytest.approx(kendall([r[1:3] for r in own]), abs=1e-12)
        assert got[g, "vectors.effective_rank"][0] == pytest.approx(rank([r[3] for r in own]), rel=1e-9)
    assert got["flat", "ratings.kendall"] == (None, "a column is constant") and got["flat", "vectors.effective_rank"] == (None, "all vectors are equal")
    assert got["bad", "vectors.effective_rank"] == (None, "fewer than two vectors")


def test_whole_frame_empty_frame_and_limits(spark):
    df = spark.createDataFrame(data(), "g string, x int, y int, v array<double>")
    m = [c.RankCorrelation("x", "y")]
    assert c.evaluate_states(df, [], m).collect()[0].score == pytest.approx(kendall([r[1:3] for r in data()]), abs=1e-12)
    assert [tuple(r) for r in c.evaluate_states(df.where("false"), [], m).collect()] == [("ratings.kendall", None, "a column is constant")]
    assert c.evaluate_states(df.where("false"), ["g"], m).count() == 0
    with pytest.raises(ValueError, match="one name"):
        c.evaluate_states(df, [], m + m)
