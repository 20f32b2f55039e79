"""Writers and table updates (SNK-01 to SNK-16). Files are written by Spark's committers, so a task that
runs again leaves nothing behind."""

from __future__ import annotations

import contextlib
import itertools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.joins import positions
from tessera.sources import arrow_files

_DEFAULTS = {T.StringType: "", T.BinaryType: bytearray(), T.LongType: 0, T.IntegerType: 0, T.DoubleType: 0.0, T.FloatType: 0.0}


def conform(df: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """SNK-01, SNK-05, SNK-06: the columns of ``schema`` in its order and types; missing or null ones get
    the type's empty value. A strict call refuses missing columns."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if strict and missing:
        raise ValueError(f"no value for {', '.join(missing)}")

    def column(f: T.StructField):
        empty = F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(_DEFAULTS.get(type(f.dataType))).cast(f.dataType)
        return (F.coalesce(F.col(f.name).cast(f.dataType), empty) if f.name in df.columns else empty).alias(f.name)

    return df.select(*map(column, schema))


def tensor_fields(name: str) -> list[T.StructField]:
    """The three columns of a tensor: bytes, shape, dtype."""
    return [T.StructField(f"{name}_bytes", T.BinaryType()), T.StructField(f"{name}_shape", T.ArrayType(T.LongType())), T.StructField(f"{name}_dtype", T.StringType())]


def record_schema(tensors: list[str], video: bool = True) -> T.StructType:
    """§1.3: a schema of tensor triplets, then the sample's metadata."""
    meta = [("file_name", T.StringType()), ("caption", T.StringType()), ("media_type", T.StringType())]
    meta += [("width", T.LongType()), ("height", T.LongType()), ("num_frames", T.LongType()), ("duration_sec", T.DoubleType()), ("fps", T.DoubleType())] * video
    return T.StructType([T.StructField("id", T.StringType()), *[f for t in tensors for f in tensor_fields(t)], *[T.StructField(n, k) for n, k in meta]])


def file_numbers(df: DataFrame, order: list[str], rows_per_file: int) -> DataFrame:
    """SNK-02, SNK-03: ``file_id``: exactly ``rows_per_file`` rows each but for the last."""
    return positions(df, order).withColumn("file_id", F.floor(F.col("pos") / rows_per_file)).drop("pos")


def write_fixed(df: DataFrame, path: str, order: list[str], rows_per_file: int, compression: str = "zstd") -> None:
    """SNK-02 to SNK-04: one file for each ``file_id``."""
    numbered = file_numbers(df, order, rows_per_file)
    numbered.repartition("file_id").write.partitionBy("file_id").option("compression", compression).parquet(path)


def write_records(df: DataFrame, path: str, by: str) -> None:
    """SNK-07, SNK-09: JSON lines below a folder for each value of ``by``."""
    df.write.partitionBy(by).json(path)


def _links(df: DataFrame) -> Column:
    return F.col("links") if "links" in df.columns else F.lit(None).cast("array<string>").alias("links")


def write_named(df: DataFrame, path: str) -> None:
    """SNK-12: a file each for the texts of (name, value), under the row's own name, which may have folders; small
    files, written by tasks to the store that ``path`` names. A column ``links`` may list further names of the text: on
    a local store they are links to the one file, elsewhere files."""

    def run(batches):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        made = set()

        def placed(name):
            folder = f"{at}/{name}".rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            return f"{at}/{name}"

        def put(name, value):
            with store.open_output_stream(placed(name)) as out:  # whole on close; a second try writes the same
                out.write((value or "").encode())

        def share(name, link, value):
            if isinstance(store, fs.LocalFileSystem):
                with contextlib.suppress(OSError):  # no links in this file system, or one of a first try
                    return os.link(f"{at}/{name}", placed(link))
            put(link, value)

        for batch in batches:
            for name, value, links in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                put(name, value)
                for link in links or ():
                    share(name, link, value)
            yield batch.slice(0, 0)

    df.select("name", "value", _links(df)).mapInArrow(run, "name string, value string, links array<string>").write.format("noop").mode("overwrite").save()


def remove_named(df: DataFrame, path: str) -> None:
    """SNK-12: the files that ``write_named`` makes of these rows go, by tasks; one that is gone already is passed
    over. Folders stay."""

    def run(batches):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        for batch in batches:
            for name, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for file in (*(links or ()), name):
                    with contextlib.suppress(FileNotFoundError):
                        store.delete_file(f"{at}/{file}")
            yield batch.slice(0, 0)

    df.select("name", _links(df)).mapInArrow(run, "name string, links array<string>").write.format("noop").mode("overwrite").save()


def upsert(base: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """SNK-15: rows of ``updates`` replace those of their key."""
    return base.join(updates, key, "left_anti").unionByName(updates)


def patch(base: DataFrame, updates: DataFrame, key: list[str], allowed: list[str]) -> DataFrame:
    """SNK-15: the allowed columns change where an update states them; nulls change nothing."""
    new = updates.select(*key, *[F.col(c).alias(f"_new_{c}") for c in allowed])
    out = base.join(new, key, "left")
    return out.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in allowed else F.col(c) for c in base.columns])


def delete(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys, key, "left_anti")


def migrate(df: DataFrame, added: dict[str, object], removed: list[str]) -> DataFrame:
    """SNK-16: new columns with defaults (kept where they are there already), old ones gone."""
    df = df.drop(*removed)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in added.items()})


def json_document(df: DataFrame, order: str) -> DataFrame:
    """SNK-08: one document ``{"data": [...]}``; for listings, as the whole of it is one row."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"])
    return df.agg(F.to_json(F.struct(rows.alias("data"))).alias("value"))


def unfilled(df: DataFrame, schema: T.StructType) -> list[str]:
    """SNK-06: the fields of a record that nothing fills."""
    return [f.name for f in schema if f.name not in df.columns]


def write_worker_chunks(df: DataFrame, path: str, order: list[str], rows_per_chunk: int, workers: int) -> None:
    """SNK-03: ``worker=i/data_chunk_k.parquet`` files of ``rows_per_chunk`` rows each, in order; a worker has chunks
    that follow one another. Chunks are small and many: tasks write them to the store that ``path`` names, whole on
    close and under their own names, so a second try writes the same; a committer would move each on the driver.
    ``readers.worker_chunks`` reads them."""
    at = file_numbers(df, order, rows_per_chunk)
    last = at.agg(F.max("file_id")).first()[0]
    chunks = 1 if last is None else -(-(last + 1) // workers)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, to = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not held.num_rows:
                continue
            ids = held["file_id"].to_numpy()
            begins = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            done = len(begins) - (1 if batch is None else 2)  # the last file may go on in the next batch
            for a, b in itertools.pairwise(begins[: done + 1]):
                worker, chunk = divmod(int(ids[a]), chunks)
                store.create_dir(f"{to}/worker={worker}", recursive=True)
                pq.write_table(held.slice(a, b - a).drop_columns(["file_id"]), f"{to}/worker={worker}/data_chunk_{chunk}.parquet", filesystem=store, compression="zstd")
            held = held.slice(begins[done])
            if batch is not None:
                yield batch.slice(0, 0)

    arrow_files.make_folder(path)
    dealt = at.repartition("file_id").sortWithinPartitions("file_id", *order)
    dealt.mapInArrow(run, dealt.schema).write.format("noop").mode("overwrite").save()


def write_flushed(df: DataFrame, path: str, rows_per_file: int) -> None:
    """SNK-04: a file is closed after ``rows_per_file`` rows; tasks hold no more than the writer's buffer."""
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def write_tensor_trees(df: DataFrame, root: str, key: str, tensors: dict[str, str]) -> None:
    """SNK-12: a table below ``root`` for each tensor (folder: column), all with the key; rows without the tensor
    are not in its table."""
    for folder, column in tensors.items():
        df.where(F.col(column).isNotNull()).select(key, F.col(column).alias("tensor")).write.parquet(f"{root}/{folder}")


def read_tensor_trees(spark: SparkSession, root: str, key: str, tensors: dict[str, str]) -> DataFrame:
    """The rows of ``write_tensor_trees`` that every table has."""
    out = None
    for folder, column in tensors.items():
        part = spark.read.parquet(f"{root}/{folder}").withColumnRenamed("tensor", column)
        out = part if out is None else out.join(part, key)
    return out


def json_document_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """SNK-08: the document ``{"data": [...]}`` of a table of any size as lines by ``pos``: the head, a record a
    line, the tail."""
    at = positions(df, order)
    n = at.count()
    body = at.select((F.col("pos") + 1).alias("pos"), F.concat(F.to_json(F.struct(*df.columns)), F.when(F.col("pos") < n - 1, ",").otherwise("")).alias("line"))
    ends = df.sparkSession.createDataFrame([(0, '{"data":['), (n + 1, "]}")], "pos bigint, line string")
    return body.unionByName(ends)
