"""Edge cases that no table holds: nulls, blanks, ties, bad texts, empty frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays, policy, stats, text
from tessera.operators import cohorts, evaluation, filters, joins, sampling
from tessera.sources import readers, sinks
from tessera.streaming import sessions


def one(df):
    return df.first()[0]


def test_scalars(spark):
    df = spark.createDataFrame([("nan",), ("1e3",), ("True",), (None,), ("x",)], "s string")
    assert [r[0] for r in df.select(policy.tolerant_double(F.col("s"))).collect()] == [None, 1000.0, 1.0, None, None]
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": true}',), ('{"a": "1"}',), ("oops",)], "s string")
    assert [r[0] for r in df.select(policy.strict_double(F.col("s"), "$.a")).collect()][:2] == [1.0, None]
    df = spark.createDataFrame([(10.0, 0.0), (10.0, None), (11.0, 10.0), (10.1, 10.0)], "c double, b double")
    x = policy.delta(F.col("c"), F.col("b"), F.lit("lower"), F.lit(8.0), F.lit(0.5))
    assert [r[0] for r in df.select(x["exceeded"]).collect()] == [False, False, True, False]


def test_latest_and_baseline(spark):
    rows = [("a", 1, 10.0, True), ("a", 2, 12.0, False), ("a", 3, 11.0, True), ("b", 1, 5.0, True)]
    df = spark.createDataFrame(rows, "c string, at long, v double, ok boolean")
    base = cohorts.prior_eligible(df, ["c"], "at", F.col("ok"), 5)
    assert [(r.c, r.v) for r in base.collect()] == [("a", 10.0)]
    assert cohorts.latest(df.where("false"), ["c"], [F.desc("at")]).count() == 0


def test_record_filters(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, dt.datetime(2024, 1, 2)), (3, "x", dt.datetime(2020, 1, 1))], "i int, g string, ts timestamp")
    assert {r.i for r in cohorts.filter_records(df, g="x", i="").collect()} == {1, 3}
    assert {r.i for r in cohorts.recent(df, "ts", "2023-01-01").collect()} == {1, 2}


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double")
    assert one(df.agg(F.percentile("x", F.lit(0.95)))) == pytest.approx(3.85)
    got = cohorts.group_quantiles(df, [], "x", {"near": cohorts.nearest(0.95), "mid": cohorts.linear(0.5), "p95": cohorts.linear(0.95)}).first()
    assert (got.n, got.near, got.mid, got.p95) == (4, 4.0, 2.5, pytest.approx(3.85))
    assert one(df.agg(stats.upper_median("x"))) == 3.0
    assert cohorts.group_quantiles(df.where("false"), [], "x", {"near": cohorts.nearest(0.95)}).count() == 0
    got = df.where("false").agg(*stats.serving_summary(F.col("x"), F.col("x"), F.col("x") > 0, 1.0)).first()
    assert got["mean"] == 0.0 and got["completed"] == 0


def test_quantiles_of_large_groups(spark):
    """Few groups, many ties, nulls, a null group: the same as Spark's own percentiles."""
    x = spark.range(5000).select(F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")).alias("g"), F.when(F.col("id") % 11 > 0, F.floor(F.sqrt(F.col("id"))).cast("double")).alias("x"))
    got = {r.g: (r.n, r.a, r.b) for r in cohorts.group_quantiles(x, ["g"], "x", {"a": cohorts.linear(0.5), "b": cohorts.linear(0.97)}).collect()}
    want = {r.g: (r.n, r.a, r.b) for r in x.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.lit(0.5)).alias("a"), F.percentile("x", F.lit(0.97)).alias("b")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_running_sums_and_halos(spark, monkeypatch):
    x = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    sums = {r.i: r.s for r in joins.cumulated(x, ["g"], ["i"], F.col("v"), "s", blocks=13).collect()}
    assert sums == {i: sum(k % 7 for k in range(i % 3, i + 1, 3)) for i in range(1000)}
    whole = {r.i: r.m for r in cohorts.rolling(x, ["g"], ["i"], 4, m=lambda w: F.sum("v").over(w.rowsBetween(-4, 0))).collect()}
    monkeypatch.setattr(cohorts, "BLOCK", 10)
    parts = {r.i: r.m for r in cohorts.rolling(x, ["g"], ["i"], 4, m=lambda w: F.sum("v").over(w.rowsBetween(-4, 0))).collect()}
    assert whole == parts == {i: sum(k % 7 for k in range(max(i % 3, i - 12), i + 1, 3)) for i in range(1000)}
    assert joins.cumulated(x.where("false"), ["g"], ["i"], F.col("v"), "s").count() == 0


def test_latest_summary_lists(spark):
    """Gated and ungated regressions, an override, a metric without baseline, a failed run."""
    rows = [("m", i, True, True, "pr", "{}", 10.0, 100.0) for i in range(3)]
    rows += [("m", 3, True, False, "pr", "{}", 1.0, 1.0), ("m", 4, False, True, "pr", "{}", 1.0, 1.0)]
    rows += [("m", 9, False, False, "local", '{"throughput": {"gated": false}, "latency": {"threshold_percent": "x"}}', 12.0, 50.0), ("n", 1, True, True, "pr", "oops", None, 5.0)]
    runs = spark.createDataFrame(rows, "model_id string, at int, success boolean, eligible boolean, run_source string, thresholds string, latency double, throughput double")
    policies = policy.policy_table(spark).withColumn("place", F.when(F.col("metric") == "latency", 1).otherwise(2))
    last, rows = cohorts.latest_metrics(runs, ["model_id"], ["latency", "throughput"], policies)
    x = policy.delta(F.col("current"), F.col("baseline"), F.col("direction"), F.col("threshold_percent"), F.col("threshold_absolute"))
    got = {r.model_id: r for r in cohorts.latest_summary(last, rows.withColumns(x).withColumn("regressed", F.col("exceeded") & F.col("gated")), ["model_id"]).collect()}
    m, n = got["m"], got["n"]
    assert (m.at, m.baseline_n, m.exceeded_metrics, m.failing_metrics, m.regression_status, m.status, m.worst_regression) == (9, 3, "latency,throughput", "latency", "fail", "fail", 50.0)
    assert (n.at, n.baseline_n, n.exceeded_metrics, n.regression_status, n.status, n.worst_regression) == (1, 0, "", "pass", "pass", None)


def test_validator_chain(spark):
    df = spark.createDataFrame([(None, 1.0), ("", 1.0), ("c", None), ("c", 2.0)], "cap string, fps double")
    chain = filters.ValidatorChain({"caption": F.length("cap") > 0}).add_validator("fps", F.col("fps") > 0)
    assert {r.rule: r.n for r in chain.counts(df).collect()} == {"caption": 2, "fps": 1, "kept": 1}
    assert chain.keep(df).count() == 1
    assert filters.ValidatorChain().keep(df).count() == 4


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "n")], "k int, v string")
    assert {(r.k, r.v) for r in joins.lookup(a, b, ["k"], "v").collect()} == {(1, None), (2, "y"), (None, "z")}
    with pytest.raises(Exception, match="no match"):
        joins.lookup(a, b, ["k"], "v", strict=True).collect()
    assert {(r.k, r.status) for r in joins.reconcile(a.where("k is not null"), b, ["k"]).collect()} == {(1, "both"), (2, "missing"), (3, "extra")}
    z = joins.zip_rows(a.select("v"), spark.range(2), ["v"], ["id"])
    assert sorted((r.pos, r.v, r.id) for r in z.collect()) == [(0, "x", 0), (1, "y", 1), (2, "z", None)]
    assert joins.positions(a.where("false"), ["k"]).count() == 0


def test_positions_are_dense(spark):
    got = joins.positions(spark.range(1000).select((F.col("id") % 7).alias("g"), "id"), ["g", "id"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1000))
    assert [(r.g, r.id) for r in got] == sorted((i % 7, i) for i in range(1000))


@pytest.mark.parametrize("drop_last", [True, False])
def test_batches(spark, drop_last):
    rows = sampling.batches(spark.range(103), "id", 4, 3, 9, 103, drop_last).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.batch)
    assert {len(b) for b in shards.values()} == {32 if drop_last else 36}
    assert len({r.id for r in rows}) == (96 if drop_last else 103)
    assert sampling.batches(spark.range(2), "id", 4, 2, 1, 2, False).count() == 8


def test_sampling(spark):
    assert sampling.spread_indices(10, 4) == [0, 2, 5, 8] and sampling.spread_indices(3, 5) == [0, 1, 2]
    assert sampling.spread_indices(9, 3, "ends") == [0, 4, 8]
    packed = sampling.pack_longest_first(spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3)], "k string, n long"), "k", "n", 2).collect()
    assert {r.key: r.shard for r in packed} == {"a": 0, "b": 1, "c": 1, "d": 0}
    sizes = [(f"f{i}", [7, 3, 3, 1, 1, 1, 0][i % 7]) for i in range(60)]
    fill, want = [0] * 5, {}
    for k, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        want[k] = fill.index(min(fill))
        fill[want[k]] += n
    got = {r.key: r.shard for r in sampling.pack_longest_first(spark.createDataFrame(sizes, "k string, n long"), "k", "n", 5).collect()}
    assert {k: s for k, s in got.items() if dict(sizes)[k]} == {k: s for k, s in want.items() if dict(sizes)[k]} and len(got) == 60
    own = [(i, "b" if i % 3 == 0 else "?" if i % 7 == 0 else None) for i in range(31)]
    style = {r.key: r.variant for r in sampling.least_used(spark.createDataFrame(own, "i int, own string"), "i", "own", ["a", "b", "c"]).collect()}
    assert len(style) == 31 and all(style[i] == "b" for i, o in own if o == "b")
    assert max(n := [list(style.values()).count(v) for v in "abc"]) - min(n) <= 1
    with pytest.raises(ValueError, match="no row uses"):
        sampling.least_used(spark.createDataFrame(own[:1], "i int, own string"), "i", "own", ["a", "b"])
    cells = spark.createDataFrame([(1, 7, "a"), (1, 8, "b"), (2, 7, "a"), (2, 9, "c")], "c int, u int, o string")
    assert {(r.cell, r.unit) for r in sampling.quota_cells(cells, "c", "u", "o", 1).collect()} == {(1, 7), (2, 9)}


def test_text(spark):
    df = spark.createDataFrame([("Ｈｅｌｌｏ,  World!",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(text.normalised(F.col("s"))).collect()] == ["hello world", None, ""]
    assert [r[0] for r in df.select(text.path_safe(F.col("s"))).collect()][1:] == ["_", "_"]
    pairs = spark.createDataFrame([("a b c", "a x c d"), ("", ""), ("", "a"), (None, None)], "r string, h string")
    assert [r[0] for r in pairs.select(text.word_error_rate("r", "h")).collect()] == [pytest.approx(2 / 3), 0.0, 1.0, 0.0]
    bad = spark.createDataFrame([('{"b":1, "a":[{"z":1,"y":null}]}',), ("{",), (None,)], "s string")
    assert [r[0] for r in bad.select(text.canonical_json_text("s")).collect()] == ['{"a":[{"y":null,"z":1}],"b":1}', None, None]
    assert one(spark.range(1).select(text.markdown_cell(F.lit("a|b\nc")))) == "a\\|b c"


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(arrays.pad(F.col("v"), 3)).collect()] == [[1.0, 2.0, 0.0], [0.0] * 3, None]
    assert [r[0] for r in df.select(arrays.decode_tensor(arrays.encode_tensor("v"), F.lit(""))).collect()] == [[1.0, 2.0], [], None]
    assert one(spark.range(1).select(arrays.mask_iou(F.array(F.lit(0)), F.array(F.lit(0))))) == 1.0
    assert one(spark.range(1).select(arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))) is None
    assert one(spark.range(1).select(arrays.largest_frames(F.lit(4)))) is None
    t = spark.createDataFrame([([float(i) for i in range(12)], [1, 2, 3, 2])], "v array<float>, s array<int>")
    assert one(t.select(arrays.frames_last("v", "s"))) == [0, 2, 4, 6, 8, 10, 1, 3, 5, 7, 9, 11]


def test_ssim(spark):
    a = [((i * 7) % 11) / 11 for i in range(16 * 16)]
    df = spark.createDataFrame([(a, a), (a, [1 - x for x in a]), (None, a)], "x array<double>, y array<double>")
    same, other, none = (r[0] for r in df.select(arrays.ssim("x", "y", F.array(F.lit(16), F.lit(16)))).collect())
    assert same == pytest.approx(1.0) and other < 0 and none is None


def test_frechet(spark):
    rows = [(g, [x + g, y]) for g in (0, 1) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0))] + [(2, [0.0, float("nan")]), (3, None)]
    df = spark.createDataFrame(rows, "g int, v array<double>")
    got = {r.g: r.distance for r in evaluation.frechet_distance(df, "g", "v", 0).collect()}
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(1.0)


def test_metric_registry():
    with pytest.raises(KeyError):
        evaluation.resolve("nothing")
    assert evaluation.resolve("nothing", strict=False) == []


def test_path_specs():
    assert readers.parse_path_specs("a:2, b") == [("a", 2), ("b", 1)]
    assert readers.parse_path_specs({"a": 0, "b": 3}) == [("b", 3)]
    assert readers.parse_path_specs(["a", "a"]) == [("a", 1), ("a", 1)]
    assert readers.parse_path_specs("s3://x/y") == [("s3://x/y", 1)]
    with pytest.raises(ValueError):
        readers.parse_path_specs("a:x")


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"m": "x", "v": 1.5}')
    (tmp_path / "t" / "b.json").write_text("{broken")
    assert [tuple(r) for r in readers.tolerant_json_tree(spark, str(tmp_path / "t"), "m string, v double").collect()] == [("x", 1.5)]
    with pytest.raises(Exception):
        readers.strict_json(spark, str(tmp_path / "t"), "m string, v double").collect()
    (tmp_path / "p.txt").write_text(" one \n\n two\n")
    assert [r.prompt for r in readers.prompts(spark, str(tmp_path / "p.txt")).collect()] == ["one", "two"]
    (tmp_path / "c.jsonl").write_text('# note\n\n{"a": 1}\n')
    assert [r.a for r in readers.commented_jsonl(spark, str(tmp_path / "c.jsonl"), "a int").collect()] == [1]
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"a": 1}, {"a": 2}]}))
    assert {r.a for r in readers.by_suffix(spark, str(tmp_path / "d.json")).collect()} == {1, 2}
    with pytest.raises(ValueError):
        readers.by_suffix(spark, "x.bin")


def test_more_readers(spark, tmp_path):
    spark.range(10).repartitionByRange(3, "id").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    assert {r.pos: r.id for r in readers.point_lookup(df, [0, 4, 9]).collect()} == {0: 0, 4: 4, 9: 9}
    with pytest.raises(IndexError):
        readers.point_lookup(df, [10])
    (tmp_path / "m.txt").write_text("a,b\nc,d\n")
    with pytest.raises(ValueError):
        readers.annotations(spark, str(tmp_path / "m.txt"), "path string")
    (tmp_path / "a.txt").write_text("1\n2\n")
    (tmp_path / "b.txt").write_text("1\n")
    with pytest.raises(Exception, match="numbers of lines"):
        readers.zipped_files(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).collect()
    with pytest.raises(KeyError):
        readers.corpus(spark, "no such corpus")
    row = spark.createDataFrame([([1, 2], [1]), ], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="lengths differ"):
        joins.zip_arguments(row, [], ["a", "b"], []).collect()
    docs = ['{"caption": ["a", "b"]}', '{"x": "long one", "y": "s"}', "{}", "oops", None]
    got = spark.createDataFrame([(x,) for x in docs], "s string").select(text.caption_of(F.col("s"))).collect()
    assert [r[0] for r in got] == ["a, b", "long one", None, None, None]


def test_sinks(spark, tmp_path):
    df = spark.range(25).select(F.col("id").cast("string").alias("id"))
    sinks.write_fixed(df.withColumn("n", F.col("id").cast("int")), str(tmp_path / "o"), ["n"], 10)
    back = readers.parquet_tree(spark, str(tmp_path / "o"))
    assert back.count() == 25
    assert sorted(r.n for r in readers.file_counts(spark.read.parquet(str(tmp_path / "o"))).collect()) == [5, 10, 10]
    schema = sinks.record_schema(["vae_latent"])
    row = sinks.conform(df.limit(1), schema).first()
    assert row["vae_latent_bytes"] == b"" and row["vae_latent_shape"] == [] and row["width"] == 0
    with pytest.raises(ValueError):
        sinks.conform(df, schema, strict=True)
    assert sinks.conform(df.where("false"), schema).schema.names == schema.names
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert {tuple(r) for r in sinks.patch(base, spark.createDataFrame([(1, None), (2, "n")], "k int, v string"), ["k"], ["v"]).collect()} == {(1, "a"), (2, "n")}
    with pytest.raises(Exception):
        base.unionByName(base.withColumn("extra", F.lit(1)))
    assert sinks.migrate(base, {"v": "d", "w": 1}, []).orderBy("k").collect()[1]["v"] == "d"


def test_health(spark):
    s, f = True, False
    cases = [([s], "HEALTHY"), ([s, f, f], "HEALTHY"), ([s, f, f, f], "UNHEALTHY"), ([s, f, f, f, s], "UNHEALTHY"), ([f, f, f, s, s], "HEALTHY"), ([], "UNKNOWN")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, e array<boolean>")
    assert [r[0] for r in df.orderBy("i").select(sessions.health_fold(F.col("e"), 2, 3)).collect()] == [h for _, h in cases]
    import itertools

    every = [(i, list(c)) for i, c in enumerate(c for n in range(1, 8) for c in itertools.product((s, f), repeat=n))]
    df = spark.createDataFrame(every, "i int, e array<boolean>")
    fold = {r.i: r.h for r in df.select("i", sessions.health_fold(F.col("e"), 2, 3).alias("h")).collect()}
    rows = df.select("i", F.posexplode("e").alias("t", "ok"))
    assert {r.i: r.health for r in sessions.health(rows, "i", ["t"], "ok", 2, 3).collect()} == fold


def test_streams(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, i), i % 4 != 3) for i in range(8)] + [("b", dt.datetime(2024, 1, 1, 0, 0, i), False) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, ok boolean")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sessions.run_available(sessions.health_stream(stream, "k"), "health_rows", "update", str(tmp_path / "c1"))
    assert {r.k: r.health for r in spark.table("health_rows").collect()} == {"a": "HEALTHY", "b": "UNHEALTHY"}
    counts = sessions.tumbling(stream, "ts", "4 seconds", F.count("*").alias("n"), late="1 minute")
    sessions.run_available(counts, "bucket_rows", "complete", str(tmp_path / "c2"))
    batch = {(r.start, r.n) for r in sessions.tumbling(df, "ts", "4 seconds", F.count("*").alias("n")).collect()}
    assert {(r.start, r.n) for r in spark.table("bucket_rows").collect()} == batch


def test_entry_without_llm(spark, data):
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'agg04_latest_summary' in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]), timeout=120)


def test_schema_of_record():
    assert sinks.record_schema(["a"], video=False).names == ["id", "a_bytes", "a_shape", "a_dtype", "file_name", "caption", "media_type"]
    assert isinstance(sinks.tensor_fields("x")[1].dataType, T.ArrayType)


def test_canonical_json_is_ascii(spark):
    import json

    from pyspark.sql import functions as F

    from tessera.functions import text

    maps = [{"b": 'é😀x"', "a": "y"}, {"ü": "日本", "A": "\x7f"}, {}, None, {"k": "�\n"}]
    got = [r.j for r in spark.createDataFrame([(m,) for m in maps], "m map<string,string>").select(text.canonical_json(F.col("m")).alias("j")).collect()]
    assert got == [None if m is None else json.dumps(m, sort_keys=True, separators=(",", ":")) for m in maps]
