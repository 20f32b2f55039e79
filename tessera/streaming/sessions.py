"""Stateful operators over session events: batch forms, and their Structured Streaming twins (STR-01 to STR-11)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.joins import cumulated
from tessera.operators.scans import previous, run_lengths

# The legal steps between the states of a served session, and those that end it.
SESSION_STEPS = {
    "initializing": ("queued", "gpu_binding", "rejected", "error"),
    "queued": ("gpu_binding", "error", "timeout", "rejected"),
    "gpu_binding": ("active", "error", "timeout"),
    "active": ("active", "complete", "error", "timeout"),
    "complete": (),
    "error": (),
    "timeout": (),
    "rejected": (),
}
SESSION_ENDS = ("complete", "error", "timeout", "rejected")

# The legal steps of the sessions of ``events``.
TRANSITIONS = {"signup": ("view", "click", "purchase"), "view": ("view", "click", "purchase", "error"), "click": ("view", "click", "purchase", "error"), "purchase": ("view", "click"), "error": ("signup", "view")}


def illegal_steps(df: DataFrame, key: str, order: list[str], state: str, legal: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """STR-01: steps of a session that its table of transitions does not allow."""
    table = F.create_map(*[x for a, bs in legal.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    return previous(df, [key], order, before=F.col(state)).where(F.col("before").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(table, F.col("before")), F.col(state)), F.lit(False)))


def idle_sessions(df: DataFrame, key: str, ts: str, now, timeout_s: float, terminal: Column) -> DataFrame:
    """STR-02: sessions whose last event is older than the timeout, terminal ones left out."""
    last = df.groupBy(key).agg(F.max(ts).alias("last"), F.max_by(terminal, ts).alias("over"))
    return last.where(~F.col("over") & (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) > timeout_s * 1e6)).select(key, "last")


REPORT = "kind string, id long, before string, state string, at timestamp"


def session_report(df: DataFrame, key: str, ts: str, id_: str, state: str, legal: dict[str, tuple[str, ...]], ends: tuple[str, ...], timeout_s: float, now) -> DataFrame:
    """STR-01, STR-02 together, for keys of any size: (key, kind, id, before, state, at).

    ``illegal``: a step that the table does not allow from the session's step before; staying is always legal.
    ``idle``: a session whose last step (at, state) ``timeout_s`` seconds have passed without another one, up to
    ``now``, unless that step ended it. After such a gap the key's next step begins a new session.
    """
    e = df.select(key, F.col(ts).cast("timestamp").alias("at"), F.col(id_).cast("long").alias("id"), F.col(state).alias("state"))
    steps = previous(e, [key], ["at", "id"], before=F.col("state"), since=F.col("at"))
    gap = lambda until, since: F.unix_micros(until) - F.unix_micros(since) > int(timeout_s * 1_000_000)
    table = F.create_map(*[x for a, bs in legal.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))])
    allowed = (F.col("before") == F.col("state")) | F.coalesce(F.array_contains(F.try_element_at(table, F.col("before")), F.col("state")), F.lit(False))
    illegal = steps.where(F.col("before").isNotNull() & ~gap(F.col("at"), F.col("since")) & ~allowed).select(key, F.lit("illegal").alias("kind"), "id", "before", "state", "at")
    broken = steps.where(F.col("before").isNotNull() & gap(F.col("at"), F.col("since"))).select(key, F.col("before").alias("state"), F.col("since").alias("at"))
    last = e.groupBy(key).agg(F.max_by(F.struct("state", "at"), F.struct("at", "id")).alias("r")).select(key, "r.state", "r.at")
    idle = broken.unionByName(last.where(gap(F.lit(now).cast("timestamp"), F.col("at")))).where(~F.col("state").isin(*ends))
    none = lambda kind: F.lit(None).cast(kind)
    return illegal.unionByName(idle.select(key, F.lit("idle").alias("kind"), none("long").alias("id"), none("string").alias("before"), "state", "at"))


class SessionProcessor(StatefulProcessor):
    """The state of one key: the steps that the watermark has not passed yet, and the last step that it has."""

    def __init__(self, key: str, legal: dict[str, tuple[str, ...]], ends: tuple[str, ...], timeout_s: float):
        self.key, self.legal, self.ends, self.timeout_us = key, legal, ends, int(timeout_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, id long, state string")
        self.last = handle.getValueState("last", "at long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            micros = part["at"].astype("int64") if part["at"].dtype.kind == "i" else part["at"].astype("datetime64[us]").astype("int64")
            self.pending.appendList(list(zip(micros.tolist(), part["id"].astype("int64").tolist(), part["state"].tolist(), strict=True)))
            self.handle.registerTimer(int(micros.min()) // 1000 + 1)
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Take the steps up to the watermark in order, then say whether the session is idle by now."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        steps = sorted(self.pending.get()) if self.pending.exists() else []
        due = [s for s in steps if s[0] < now]
        last = tuple(self.last.get()) if self.last.exists() else None
        out: list[tuple] = []
        for at, id_, state in due:
            if last and at - last[0] > self.timeout_us:
                last = self._idle(last, out)
            if last and state != last[1] and state not in self.legal.get(last[1], ()):
                out.append(("illegal", id_, last[1], state, at))
            last = (at, state)
        rest = steps[len(due) :]
        if last and now - last[0] > self.timeout_us and not (rest and rest[0][0] - last[0] <= self.timeout_us):
            last = self._idle(last, out)
        if due:
            self.pending.put(rest) if rest else self.pending.clear()
        if last:
            self.last.update(last)
            self.handle.registerTimer((last[0] + self.timeout_us) // 1000 + 1)
        else:
            self.last.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if out:
            kind, ids, before, state, at = zip(*out, strict=True)
            yield pd.DataFrame({self.key: [key[0]] * len(out), "kind": kind, "id": pd.array(ids, dtype="Int64"), "before": before, "state": state, "at": pd.to_datetime(at, unit="us")})

    def _idle(self, last: tuple, out: list) -> None:
        if last[1] not in self.ends:
            out.append(("idle", None, None, last[1], last[0]))

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, key: str, ts: str, id_: str, state: str, legal: dict[str, tuple[str, ...]], ends: tuple[str, ...], timeout_s: float, late: str) -> DataFrame:
    """STR-01, STR-02 on a stream: the rows of ``session_report`` for ``now`` = the watermark, each once.

    Typed state a key: the steps that may still be preceded (a list, until the watermark has passed them), and the last
    one (a value); timers take them up, and reap idle sessions without any new row. Whatever order steps come in
    within ``late``, the report is that of their order in time. State goes when a session is idle or over; a restart
    goes on from the checkpoint. Needs the RocksDB state store.
    """
    kind = events.schema[key].dataType.simpleString()
    e = events.select(key, F.col(ts).cast("timestamp").alias("at"), F.col(id_).cast("long").alias("id"), F.col(state).alias("state"))
    processor = SessionProcessor(key, legal, ends, timeout_s)
    return e.withWatermark("at", late).groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {REPORT}", "Append", "EventTime")


def health_fold(events: Column, up: int, down: int) -> Column:
    """STR-03: health after a key's ordered outcomes (array of booleans): the first success makes it
    healthy at once, ``down`` failures in a row unhealthy, ``up`` successes in a row healthy again."""
    start = F.struct(F.lit("UNKNOWN").alias("s"), F.lit(0).alias("ok"), F.lit(0).alias("bad"))

    def step(a: Column, ok: Column) -> Column:
        good, bad = F.when(ok, a["ok"] + 1).otherwise(0), F.when(ok, 0).otherwise(a["bad"] + 1)
        state = F.when(ok & (a["s"] == "UNKNOWN"), "HEALTHY").when(ok & (a["s"] == "UNHEALTHY") & (good >= up), "HEALTHY").when(~ok & (bad >= down), "UNHEALTHY").otherwise(a["s"])
        return F.struct(state.alias("s"), good.alias("ok"), bad.alias("bad"))

    return F.aggregate(events, start, step, lambda a: a["s"])


def health(df: DataFrame, key: str, order: list[str], ok: str, up: int, down: int) -> DataFrame:
    """STR-03 for keys with any number of events: the last decisive event says the health. Decisive are a failure
    that ends ``down`` in a row, a success that ends ``up`` in a row, and the first success of a key that has not
    failed so before. Runs are counted over ranges (``scans.run_lengths``), the rest are partial aggregates."""
    rows, good, place = run_lengths(df, [key], order, ok).rows, F.col(ok), F.col("pos")
    at = lambda is_, f: f(F.when(is_, place))
    up_run, down_run = good & (F.col("run") >= up), ~good & (F.col("run") >= down)
    ends = rows.groupBy(key).agg(at(good, F.min).alias("first_good"), at(down_run, F.min).alias("first_down"), at(up_run, F.max).alias("last_up"), at(down_run, F.max).alias("last_down"))
    started = F.when(F.col("first_good") < F.coalesce("first_down", F.col("first_good") + 1), F.col("first_good"))
    healthy = F.greatest(started, "last_up")
    health = F.when(healthy.isNull() & F.col("last_down").isNull(), "UNKNOWN").when(F.coalesce(healthy > F.col("last_down"), healthy.isNotNull()), "HEALTHY").otherwise("UNHEALTHY")
    return ends.select(key, health.alias("health"))


def health_stream(events: DataFrame, key: str, up: int = 2, down: int = 3, idle: str = "7 days", late: str = "1 hour") -> DataFrame:
    """STR-03 on a stream of (key, ts, ok): state per key, one row for each key and trigger. A key's state goes once
    the watermark is ``idle`` past its last event; it then begins anew as UNKNOWN."""
    kind = events.schema[key].dataType.simpleString()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s, ok, bad = state.get if state.exists else ("UNKNOWN", 0, 0)
        rows = pd.concat(list(parts)).sort_values("ts")
        for good in rows["ok"]:
            ok, bad = (ok + 1, 0) if good else (0, bad + 1)
            if good and (s == "UNKNOWN" or (s == "UNHEALTHY" and ok >= up)):
                s = "HEALTHY"
            elif not good and bad >= down:
                s = "UNHEALTHY"
        state.update((s, ok, bad))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: [k[0]], "health": [s]})

    return events.select(key, "ts", "ok").withWatermark("ts", late).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, health string", "s string, ok int, bad int", "update", GroupStateTimeout.EventTimeTimeout)


def latest_state(df: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """STR-04: a key's last state."""
    return df.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))


def concurrency(df: DataFrame, group: str, start: str, end: str, most: int) -> DataFrame:
    """STR-05: how many spans are open when each one starts, and whether it is admitted under ``most``; a running
    sum over ranges, so a group may have any size."""
    ups = df.select(group, F.col(start).alias("t"), F.lit(1).alias("d"), "id")
    downs = df.select(group, F.col(end).alias("t"), F.lit(-1).alias("d"), "id")
    return cumulated(ups.unionByName(downs), [group], ["t", "d", "id"], F.col("d"), "open").where("d = 1").select(group, "id", "open", (F.col("open") <= most).alias("admitted"))


def tumbling(df: DataFrame, ts: str, width: str, *aggs: Column, late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """STR-08: tumbling windows, on batches and streams; ``late`` is the watermark of a stream."""
    df = df.withWatermark(ts, late) if late and df.isStreaming else df
    return df.groupBy(F.window(ts, width).alias("w"), *by).agg(*aggs).withColumn("start", F.col("w.start")).drop("w")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Run what is there through a streaming query into a memory table; progress stays in ``checkpoint``
    (STR-09, STR-11: a run that starts again goes on from its offsets)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """STR-09, STR-11: append what has come since the last run to Parquet files below ``path``; offsets and the
    list of committed files stay in ``checkpoint`` and ``path``, so a run that broke off does not repeat rows."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
