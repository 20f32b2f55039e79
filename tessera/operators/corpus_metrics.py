"""UDF-02: corpus metrics with states of their own: reset, accumulate, merge, finalize.

A metric is a small class. Each task accumulates its rows into one state a group, as Arrow batches stream by, and
emits it as bytes; states of a group are merged in rounds of ``FAN_IN``, so that no task sees more states of a group
than that, however many tasks there were; the last state becomes a score. Whatever a state holds must not grow with
the rows (a sketch, sums, a bounded sample): then the memory of a task is one state for each of its groups.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import settled

FAN_IN = 64
MOST_GROUPS = 10_000


class CorpusMetric(ABC):
    """``columns`` are read; a state is any picklable value."""

    name: str
    columns: tuple[str, ...]

    @abstractmethod
    def reset(self) -> Any:
        """The state of no rows."""

    @abstractmethod
    def accumulate(self, state: Any, rows: dict[str, pa.Array]) -> Any:
        """The state after a batch of rows (a column each)."""

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any:
        """One state of two; its order must not matter."""

    @abstractmethod
    def finalize(self, state: Any) -> tuple[float | None, str | None]:
        """The score, or null and the reason why there is none."""


def _states(df: DataFrame, by: list[str], metrics: list[CorpusMetric]) -> DataFrame:
    """_g (the group's values as one struct), metric, state: one row a task, group and metric. A task with more than
    ``MOST_GROUPS`` groups hands its states on and starts again."""
    columns = list(dict.fromkeys(c for m in metrics for c in m.columns))
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("{}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(g, m.name, pickle.dumps(s)) for g, states in held.items() for m, s in zip(metrics, states, strict=True)]
            g, names, states = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(names, pa.string()), pa.array(states, pa.binary())], names=["_g", "metric", "state"])

        for b in batches:
            keys = b.column(0).dictionary_encode()
            codes = keys.indices.to_numpy(zero_copy_only=False)
            for i, key in enumerate(keys.dictionary.to_pylist()):
                part = b if len(keys.dictionary) == 1 else b.take(pa.array(np.flatnonzero(codes == i)))
                rows = {c: part.column(1 + k) for k, c in enumerate(columns)}
                states = held.get(key) or [m.reset() for m in metrics]
                held[key] = [m.accumulate(s, rows) for m, s in zip(metrics, states, strict=True)]
            if len(held) > MOST_GROUPS:
                yield out()
                held.clear()
        yield out()

    return df.select(group.alias("_g"), *columns).mapInArrow(run, "_g string, metric string, state binary")


def _merged(states: DataFrame, metrics: list[CorpusMetric]) -> DataFrame:
    """States of one group, metric and ``_slot`` as one; batches stream by, and a task keeps a state a slot."""
    known = {m.name: m for m in metrics}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        done: list[tuple] = []
        for b in batches:  # sorted, so that a slot's states stand together
            for key in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                *at, blob = key
                if at != last:
                    if last is not None:
                        done.append((*last, pickle.dumps(state)))
                    last, state = at, pickle.loads(blob)
                else:
                    state = known[at[1]].merge(state, pickle.loads(blob))
            if done:
                yield _rows(done)
                done = []
        if last is not None:
            yield _rows([(*last, pickle.dumps(state))])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        g, names, slots, blobs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(names, pa.string()), pa.array(slots, pa.int64()), pa.array(blobs, pa.binary())], names=["_g", "metric", "_slot", "state"])

    keys = ["_g", "metric", "_slot"]
    dealt = states.select(*keys, "state").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "_g string, metric string, _slot bigint, state binary")


def evaluate_states(df: DataFrame, by: list[str], metrics: list[CorpusMetric], fan_in: int = FAN_IN) -> DataFrame:
    """``by``, metric, score, skipped (the reason): every metric over each group. Without ``by`` an empty frame gives
    the score of no rows; with it, groups are those that occur. Accumulated states are settled once.
    """
    known = {m.name: m for m in metrics}
    if len(known) != len(metrics):
        raise ValueError("metrics of one name")
    schema = df.select(*by).schema if by else None
    parts = settled(_states(df, by, metrics).withColumn("_slot", F.monotonically_increasing_id()))
    most = parts.groupBy("_g", "metric").count().agg(F.max("count")).first()[0] or 0  # one number
    slots = most
    while slots > 1:
        slots = -(-slots // fan_in)
        parts = _merged(parts.withColumn("_slot", F.pmod(F.xxhash64("_slot"), F.lit(slots)) if slots > 1 else F.lit(0).cast("bigint")), metrics)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [known[n].finalize(pickle.loads(s)) for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.float64()), pa.array([r for _, r in got], pa.string())], names=["_g", "metric", "score", "skipped"])

    out = parts.select("_g", "metric", "state").mapInArrow(finish, "_g string, metric string, score double, skipped string")
    if by:
        return out.withColumn("_g", F.from_json("_g", schema)).select(*[F.col("_g")[c].alias(c) for c in by], "metric", "score", "skipped")
    if most == 0:
        rows = [(m.name, *m.finalize(m.reset())) for m in metrics]
        return df.sparkSession.createDataFrame(rows, "metric string, score double, skipped string")
    return out.drop("_g")


# --------------------------------------------------------------------- metrics without a built-in form


class Covariance:
    """Sums of finite vectors: number, mean and scatter, merged pairwise."""

    @staticmethod
    def of(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
        if not len(x):
            return None
        mean = x.mean(axis=0)
        return len(x), mean, (x - mean).T @ (x - mean)

    @staticmethod
    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        n, shift = a[0] + b[0], b[1] - a[1]
        return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


class EffectiveRank(CorpusMetric):
    """exp of the entropy of the covariance's eigenvalue shares: in how many directions vectors spread."""

    def __init__(self, column: str, name: str = "vectors.effective_rank"):
        self.name, self.columns = name, (column,)

    def reset(self):
        return None

    def accumulate(self, state, rows):
        lists = [np.asarray(v, dtype=float) for v in rows[self.columns[0]].to_pylist() if v and None not in v]
        finite = [v for v in lists if np.isfinite(v).all()]
        return Covariance.merge(state, Covariance.of(np.array(finite)) if finite else None)

    def merge(self, a, b):
        return Covariance.merge(a, b)

    def finalize(self, state):
        if state is None or state[0] < 2:
            return None, "fewer than two vectors"
        values = np.clip(np.linalg.eigvalsh(state[2]), 0, None)
        if values.sum() <= 0:
            return None, "all vectors are equal"
        share = values[values > 0] / values.sum()
        return float(np.exp(-(share * np.log(share)).sum())), None


class RankCorrelation(CorpusMetric):
    """Kendall's tau-b of two columns of few distinct values (ratings): the state is their table of counts."""

    def __init__(self, x: str, y: str, name: str = "ratings.kendall", most: int = 256):
        self.name, self.columns, self.most = name, (x, y), most

    def reset(self):
        return {}

    def accumulate(self, state, rows):
        for pair in zip(rows[self.columns[0]].to_pylist(), rows[self.columns[1]].to_pylist(), strict=True):
            if None not in pair:
                state[pair] = state.get(pair, 0) + 1
        self._check(state)
        return state

    def merge(self, a, b):
        out = dict(a)
        for k, n in b.items():
            out[k] = out.get(k, 0) + n
        self._check(out)
        return out

    def _check(self, state):
        if len({x for x, _ in state}) > self.most or len({y for _, y in state}) > self.most:
            raise ValueError(f"{self.name}: more than {self.most} distinct ratings")

    def finalize(self, state):
        xs, ys = sorted({x for x, _ in state}), sorted({y for _, y in state})
        if len(xs) < 2 or len(ys) < 2:
            return None, "a column is constant"
        t = np.array([[state.get((x, y), 0) for y in ys] for x in xs], dtype=np.int64)
        below = np.zeros_like(t)
        below[:-1] = np.cumsum(t[::-1], axis=0)[::-1][1:]  # of each cell: its column in the rows after
        upto = np.cumsum(below, axis=1)
        order = (upto[:, -1:] - upto) - (upto - below)  # right of it, less left of it
        both = int((t.astype(object) * order.astype(object)).sum())
        pairs = lambda m: int(m) * (int(m) - 1) // 2
        n, tied_x, tied_y = pairs(t.sum()), sum(map(pairs, t.sum(axis=1))), sum(map(pairs, t.sum(axis=0)))
        return both / (float(n - tied_x) * float(n - tied_y)) ** 0.5, None
