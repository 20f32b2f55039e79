"""Sessions on a stream, restarted between files and out of order, against the batch form."""

import datetime as dt
import random

from tessera.streaming import sessions as s

START = dt.datetime(2024, 1, 1)


def steps(n=400, keys=9, seed=3):
    rng = random.Random(seed)
    states = list(s.SESSION_STEPS)
    return [(f"s{rng.randint(1, keys)}", START + dt.timedelta(seconds=60 * i + rng.randint(0, 50)), i, rng.choice(states)) for i in range(n)]


def rows(df):
    return sorted(tuple(str(x) for x in (r.k, r.kind, r.id, r.before, r.state, r.at)) for r in df.collect())


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    schema = "k string, ts timestamp, id long, state string"
    data = steps() + [("sleeper", START, 10_000, "active"), ("done", START, 10_001, "complete")]
    later = [("end", START + dt.timedelta(days=3), 20_000, "queued")]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        random.Random(4).shuffle(data)
        data.sort(key=lambda r: r[1].timestamp() // 1500)  # out of order within 25 minutes
        for lo, hi in ((0, 150), (150, 151), (151, len(data))):
            spark.createDataFrame(data[lo:hi], schema).coalesce(1).write.mode("append").parquet(source)
            run(spark, source, schema, out, checkpoint)
        spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, schema, out, checkpoint)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    now = later[0][1] - dt.timedelta(minutes=30)
    df = spark.createDataFrame(data, schema)
    want = rows(s.session_report(df, "k", "ts", "id", "state", s.SESSION_STEPS, s.SESSION_ENDS, 1200, now))
    got = rows(spark.read.parquet(out))
    assert got == want and {r[1] for r in got} == {"illegal", "idle"} and any(r[0] == "sleeper" for r in got)


def run(spark, source, schema, out, checkpoint):
    events = spark.readStream.schema(schema).parquet(source)
    stream = s.session_stream(events, "k", "ts", "id", "state", s.SESSION_STEPS, s.SESSION_ENDS, 1200, "30 minutes")
    s.append_available(stream, out, checkpoint)
