"""Tables by commits, Arrow files, the index of files."""

import threading
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from tessera.plans import files
from tessera.sources import arrow_files, readers, sinks
from tessera.sources.versioned import CommitConflict, VersionedTable


def values(df):
    return {r.k: r.v for r in df.collect()}


def test_versions_and_touched_files(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    base = spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    t.create(base.repartitionByRange(10, "k"))
    first = t.snapshot()
    assert len(first.files) == 10
    t.upsert(spark.createDataFrame([(5, "new"), (200, "more")], "k long, v string"), ["k"])
    second = t.snapshot()
    assert len(set(first.files) - set(second.files)) == 1 and second.version == 2  # one file holds key 5
    t.delete(spark.createDataFrame([(7,), (99,)], "k long"), ["k"])
    assert values(t.read()) == {k: "new" if k == 5 else "more" if k == 200 else "old" for k in [*range(100), 200] if k not in (7, 99)}
    assert len(values(t.read(1))) == 100 and values(t.read(2))[200] == "more"
    with pytest.raises(ValueError, match="may not change"):
        t.patch(spark.createDataFrame([(1, "x")], "k long, v string"), ["k"], ["other"])
    assert t.delete(spark.createDataFrame([(12345,)], "k long"), ["k"]) == 3  # nothing touched, no version
    with pytest.raises(CommitConflict):
        t.create(base)


def test_columns_with_defaults(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create(spark.range(4).select(F.col("id").alias("k")))
    t.add_columns({"v": ("string", "default"), "k": ("long", 0)})
    t.append(spark.createDataFrame([(9, None), (8, "own")], "k long, v string"))
    assert values(t.read()) == {0: "default", 1: "default", 2: "default", 3: "default", 9: None, 8: "own"}
    t.upsert(spark.createDataFrame([(0, "x")], "k long, v string"), ["k"])
    assert values(t.read())[0] == "x" and values(t.read())[9] is None and t.read(1).columns == ["k"]


def test_of_two_writers_one_wins(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create(spark.range(40).select(F.col("id").alias("k"), F.lit("old").alias("v")).repartitionByRange(4, "k"))
    base, seen, lost = t.snapshot(), [], []
    before = t.read()

    def write(name):
        try:
            t.upsert(spark.createDataFrame([(3, name)], "k long, v string"), ["k"], snap=base)
            seen.append(name)
        except CommitConflict:
            lost.append(name)

    writers = [threading.Thread(target=write, args=(n,)) for n in ("a", "b", "c")]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert len(seen) == 1 and len(lost) == 2
    assert values(t.read())[3] == seen[0] and t.snapshot().version == 2 and values(before)[3] == "old"
    t.append(spark.createDataFrame([(77, "x")], "k long, v string"))
    assert t.commit(2, [], [], blind=True) == 4  # an append goes up to the next free number


def test_arrow_files(spark, tmp_path):
    arrow_files.register(spark)
    df = spark.range(1000).select("id", F.concat(F.lit("é"), "id").alias("s"), F.array(F.col("id"), F.lit(None).cast("long")).alias("l"), F.lit(None).cast("double").alias("x"))
    at = str(tmp_path / "f.arrow")
    df.repartition(3).write.format("arrow_ipc").mode("append").save(at)
    back = readers.by_suffix(spark, at)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    one = str(tmp_path / "one.arrow")
    with pa.ipc.new_file(one, pa.schema([("a", pa.int32()), ("d", pa.dictionary(pa.int8(), pa.string()))])) as out:
        for i in range(5):
            out.write_batch(pa.RecordBatch.from_arrays([pa.array([i, None], pa.int32()), pa.array(["x", "y"]).dictionary_encode().cast(pa.dictionary(pa.int8(), pa.string()))], schema=out.schema if hasattr(out, "schema") else pa.schema([("a", pa.int32()), ("d", pa.dictionary(pa.int8(), pa.string()))])))
    got = spark.read.format("arrow_ipc").schema("a int, d string, more long").load(one)
    assert got.rdd.getNumPartitions() == 5 and got.count() == 10 and {r.d for r in got.collect()} == {"x", "y"} and {r.more for r in got.collect()} == {None}
    with pytest.raises(Exception, match="no .arrow files|NotFound|not"):
        spark.read.format("arrow_ipc").load(str(tmp_path / "none.arrow")).collect()


def test_index_of_files_and_places(spark, tmp_path):
    at = str(tmp_path / "p")
    spark.range(100).repartitionByRange(7, "id").write.parquet(at)
    df = spark.read.parquet(at)
    index = sorted((r.path, r.n, r["first"]) for r in readers.file_index(df).collect())
    assert sum(n for _, n, _ in index) == 100 and [f for _, _, f in index] == [sum(n for _, n, _ in index[:i]) for i in range(len(index))]
    rows = [r.id for p, _, _ in index for r in spark.read.parquet(p).collect()]
    assert {r.pos: r.id for r in readers.point_lookup(df, [0, 13, 99, 13]).collect()} == {p: rows[p] for p in (0, 13, 99)}
    for places in ([100], [-1]):
        with pytest.raises(IndexError):
            readers.point_lookup(df, places)


def test_co_listed_samples(spark, tmp_path):
    names = spark.createDataFrame([(f"latent_{i}.pt", "x") for i in range(5)] + [("odd.pt", "x")], "name string, value string")
    sinks.write_named(names, str(tmp_path / "latents"))
    sinks.write_named(names.where("name <> 'latent_2.pt'").withColumn("name", F.replace("name", F.lit("latent_"), F.lit("condition_"))), str(tmp_path / "conditions"))
    sinks.write_named(names.where("name <> 'latent_4.pt'"), str(tmp_path / "audio"))
    got = readers.co_listed(spark, str(tmp_path), {"conditions": "c", "latents": "l", "audio": "a"})
    assert {r["sample"]: r.c.rpartition("/")[2] for r in got.collect()} == {"latent_0.pt": "condition_0.pt", "latent_1.pt": "condition_1.pt", "latent_3.pt": "condition_3.pt", "odd.pt": "odd.pt"}


def test_files_are_listed_by_tasks(spark, tmp_path):
    """Folders in folders, hidden names, and no list of the files with the driver."""
    names = spark.createDataFrame([(f"{i % 3}/deep/latent_{i}.pt", "x") for i in range(9)] + [("_no/latent_90.pt", "x"), (".latent_91.pt", "x"), ("0/other.txt", "x")], "name string, value string")
    sinks.write_named(names, str(tmp_path / "latents"))
    sinks.write_named(spark.createDataFrame([(f"condition_{i}.pt", "x") for i in range(1, 99)], "name string, value string"), str(tmp_path / "conditions"))
    got = readers.co_listed(spark, str(tmp_path), {"conditions": "c", "latents": "l"})
    assert {(r["sample"], r.c.rpartition("/")[2]) for r in got.collect()} == {(f"{i % 3}/deep/latent_{i}.pt", f"condition_{i}.pt") for i in range(1, 9)}
    assert all(r.l.endswith(f"/latents/{r['sample']}") and spark.read.text(r.l).count() == 1 for r in got.limit(2).collect())
    assert not any(f.endswith(".pt") for f in got.inputFiles())


def test_listing_holds_few_files(spark, tmp_path, monkeypatch):
    """Samples are written and listed in rounds: the files there at once do not grow with the table, and a table of
    which a source has no file is listed too."""
    monkeypatch.setattr(files, "FOLDER_FILES", 10)
    monkeypatch.setattr(files, "ROUND_FOLDERS", 10, raising=False)
    held, roots, listing = [], [], readers.co_listed

    def counted(spark, root, *args, **kwargs):
        there = [p for r in {*roots, root} for p in Path(r).rglob("*.bin")]
        roots.append(root)
        held.append(len(there))
        return listing(spark, root, *args, **kwargs)

    monkeypatch.setattr(readers, "co_listed", counted)
    for n, size in ((300, "1 + id % 50"), (20, "3"), (0, "1")):
        held.clear()
        at = tmp_path / f"{n}-{size}"
        spark.range(n).select(F.col("id").alias("p_partkey"), F.format_string("part %d", "id").alias("p_name"), F.expr(f"cast({size} as int)").alias("p_size")).write.parquet(f"{at}/part.parquet")
        sizes = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{at}/part.parquet").collect()}
        got = [(r.k, r.condition) for r in files.src15_listing(spark, str(at)).collect()]
        assert sorted(got) == [(k, f"condition_{k}.bin") for k, s in sorted(sizes.items()) if s % 3 and s % 5]
        assert max(held) < 400 and len(held) == max(1, -(-n // 100))  # 744 files in all of the first
        assert sum(held) == sum(1 + (s % 3 > 0) + (s % 5 > 0) for s in sizes.values())
    assert not any(Path(r).exists() for r in roots)


def test_names_of_one_text(spark, tmp_path):
    """Further names of a text, written twice over; other rows' files stay when those of some go."""
    rows = spark.createDataFrame([(f"a/{i}.bin", f"é {i}", [f"b/c/{i}.bin", f"{i}.bin"] if i % 2 else None) for i in range(20)], "name string, value string, links array<string>")
    for _ in range(2):
        sinks.write_named(rows, str(tmp_path))
    for i in range(20):
        assert all((tmp_path / d / f"{i}.bin").read_text() == f"é {i}" for d in (("a", "b/c", ".") if i % 2 else ("a",)))
    assert len(list(tmp_path.rglob("*.bin"))) == 40
    for _ in range(2):
        sinks.remove_named(rows.where("name <> 'a/7.bin'"), str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.bin")) == ["7.bin", "a/7.bin", "b/c/7.bin"]


def test_lists_of_segments_are_full(spark, tmp_path, monkeypatch):
    """As many lists as a group of rows needs, many in a file; a missing status is kept."""
    rows = spark.range(12_000).select(F.col("id").alias("o_orderkey"), F.format_string("%d-X", F.col("id") % 4).alias("o_orderpriority"), F.when(F.col("id") % 5 != 0, "F").alias("o_orderstatus"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    seen, tree = [], readers.segment_tree
    monkeypatch.setattr(readers, "segment_tree", lambda s, at, schema: seen.append(at) or tree(s, at, schema))
    got = {(r.segment, r.source): (r.n, r["keys"]) for r in files.src20_tree(spark, str(tmp_path)).collect()}
    assert got == {(str(s), t): (len(k), sum(k)) for s in range(4) for t in ("F", None) for k in [[i for i in range(12_000) if i % 4 == s and (i % 5 != 0) == (t == "F")]]}
    lists = spark.read.option("multiLine", True).json(f"{seen[0]}/seg_*").select(F.size("nodes").alias("n"), F.col("_metadata.file_path").alias("f"))
    sizes = [r.n for r in lists.collect()]
    assert len(sizes) == 4 * (5 + 2) and max(sizes) < 700
    assert lists.select("f").distinct().count() == 4


def test_chunks_of_workers_are_files_of_their_own(spark, tmp_path):
    """Chunks over several batches, rows in order, a shorter last one; no rows make no chunk."""
    df = spark.range(0, 206, 2).select((F.col("id") * 7 % 206).alias("k"), F.when(F.col("id") % 3 != 0, F.lit("x")).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        sinks.write_worker_chunks(df, str(tmp_path / "w"), ["k"], 10, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, v = sorted(r.k for r in df.collect()), {r.k: r.v for r in df.collect()}
    found = sorted((tmp_path / "w").rglob("*.parquet"))
    assert sorted(str(f.relative_to(tmp_path / "w")) for f in found) == sorted(f"worker={i // 4}/data_chunk_{i % 4}.parquet" for i in range(11))
    for i in range(11):
        rows = pa.parquet.read_table(tmp_path / "w" / f"worker={i // 4}" / f"data_chunk_{i % 4}.parquet", partitioning=None).to_pylist()
        assert [r["k"] for r in rows] == want[10 * i : 10 * i + 10] and all(r["v"] == v[r["k"]] for r in rows)
    back = readers.worker_chunks(spark, str(tmp_path / "w"), df.schema)
    assert {(r.k, 4 * r.worker + r.chunk) for r in back.collect()} == {(k, i // 10) for i, k in enumerate(want)}
    sinks.write_worker_chunks(df.limit(0), str(tmp_path / "none"), ["k"], 10, 3)
    assert readers.worker_chunks(spark, str(tmp_path / "none"), df.schema).count() == 0
