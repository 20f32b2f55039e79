"""Readers (SRC-01 to SRC-23). Everything is read by Spark, so any store that Spark reads will do; ``listed_files``
lists by pyarrow."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import joins
from tessera.operators.filters import kept_by_hash
from tessera.operators.scans import scan
from tessera.sources import arrow_files


def parquet_tree(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-01: every Parquet file below a folder."""
    r = spark.read.option("recursiveFileLookup", True)
    return (r.schema(schema) if schema else r).parquet(path)


def file_counts(df: DataFrame) -> DataFrame:
    """SRC-01: rows of each file. No column is read: the footers give the rows of each row group."""
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))


def file_index(df: DataFrame) -> DataFrame:
    """SRC-01, SRC-03: each file's path, rows (n) and the number of its first row over all files in order of path
    (first); a running sum over ranges, so the list of files stays in Spark."""
    return joins.cumulated(file_counts(df), [], ["path"], F.col("n"), "upto").select("path", "n", (F.col("upto") - F.col("n")).alias("first"))


def parse_path_specs(specs: str | list[str] | dict[str, int]) -> list[tuple[str, int]]:
    """SRC-02: ``dir:2,dir2``, a list (paths as they are, once each) or a mapping as (path, times); times of zero or
    less drop out."""
    if isinstance(specs, dict):
        pairs = [(p, int(n)) for p, n in specs.items()]
    elif not isinstance(specs, str):
        pairs = [(str(s), 1) for s in specs]
    else:
        pairs = []
        for s in specs.split(","):
            head, sep, tail = s.strip().rpartition(":")
            if sep and not tail.startswith("/"):
                if not tail.lstrip("-").isdigit():
                    raise ValueError(f"{s!r}: the repeat count is no number")
                pairs.append((head, int(tail)))
            elif s.strip():
                pairs.append((s.strip(), 1))
    return [(p, n) for p, n in pairs if n > 0]


def mixed(frames: list[tuple[DataFrame, int]]) -> DataFrame:
    """SRC-02: frames of one schema, each repeated; the repetition is a row generator, not another scan."""
    parts = [df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) for df, n in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: .csv, .json (rows under ``data``), .jsonl, .parquet or .arrow; others are refused."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        return spark.read.option("header", True).csv(path)
    if suffix == "json":
        return spark.read.option("multiLine", True).json(path).select(F.explode("data").alias("r")).select("r.*")
    if suffix == "jsonl":
        return spark.read.json(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "arrow":
        arrow_files.register(spark)
        return spark.read.format("arrow_ipc").load(path)
    raise ValueError(f"no reader for .{suffix} files")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: one prompt a line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("prompt")).where("prompt <> ''")


def commented_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-12: JSON lines without blank lines and lines that begin with #."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not v like '#%'")
    return lines.select(F.from_json("v", schema).alias("r")).select("r.*")


def tolerant_json_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-09: one record a file, all below a folder; what cannot be parsed is left out."""
    kept = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    df = spark.read.schema(kept).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.where("_bad is null").drop("_bad")


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-11: the same, but a bad record fails the query."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def synthetic_requests(spark: SparkSession, n: int, width: int = 832, height: int = 480) -> DataFrame:
    """SRC-19: numbered synthetic prompts."""
    return spark.range(n).select(F.col("id").alias("request_id"), F.format_string("Random prompt %d for benchmarking", "id").alias("prompt"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def common_samples(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """SRC-15, JOIN-08: keys that every source has."""
    out = None
    for df in sources.values():
        k = df.select(key).distinct()
        out = k if out is None else out.join(k, key)
    return out


def point_lookup(df: DataFrame, places: list[int]) -> DataFrame:
    """SRC-03: the rows of Parquet files at the given numbers over all files, in order of path: ``pos`` and the
    columns.

    Places and files meet in one ordered scan (each place takes the last file that begins at or before it), so no list
    of files reaches the driver, only the names of those asked for; these alone are read, and their rows meet the
    places in a broadcast join. A place outside is an error.
    """
    spark, index = df.sparkSession, file_index(df)
    wanted = spark.createDataFrame([(p,) for p in sorted(set(places))], "pos bigint")
    starts = index.where("n > 0").select(F.col("first").alias("at"), F.lit(0).alias("kind"), F.struct("path", "first", "n").alias("file"), F.lit(None).cast("bigint").alias("pos"))
    asked = wanted.select(F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["file"].dataType).alias("file"), "pos")
    met = scan(starts.unionByName(asked), [], ["at", "kind"]).add(held=("last", F.col("file"))).rows.where("kind = 1")
    found = [r for r in met.select("pos", "held.*").collect()]  # a row a place asked for
    if outside := [r.pos for r in found if r.path is None or not 0 <= r.pos < r.first + r.n]:
        raise IndexError(f"no rows {sorted(outside)}")
    at = spark.createDataFrame([(r.path, r.pos - r.first, r.pos) for r in found], "_f string, _i bigint, pos bigint")
    rows = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    return rows.where(F.col("_f").isin(sorted({r.path for r in found}))).join(F.broadcast(at), ["_f", "_i"]).drop("_f", "_i")


def listed_files(spark: SparkSession, root: str, suffix: str, sources: list[str], lists: str | None = None) -> DataFrame:
    """The files whose names have the suffix below the folders ``sources`` of ``root``: ``source``, ``rel``, their
    place in it, and ``path``. Names that begin with _ or . are left out.

    Tasks list the folders of a level side by side and write down what they find (below ``lists``, if named), so the
    driver sees how many folders there are and no file. A folder is one task's; local ones are read entry by entry.
    The jobs run when the frame is made."""
    at = root.rstrip("/")

    def run(batches):
        for batch in batches:
            for source, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = ((f"{folder}{name}", is_dir) for name, is_dir in arrow_files.entries(f"{at}/{source}/{folder}") if not name.startswith(("_", ".")))
                kept = ((name, is_dir) for name, is_dir in names if is_dir or name.endswith(suffix))
                while block := list(itertools.islice(kept, 10_000)):
                    yield pa.RecordBatch.from_pydict({"source": [source] * len(block), "rel": [n for n, _ in block], "is_dir": [d for _, d in block]})

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    shown = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, n, files = spark.createDataFrame([(s, "") for s in sources], "source string, folder string"), len(sources), None
    for depth in itertools.count():
        level = joins.settled(folders.repartition(min(n, tasks)).mapInArrow(run, "source string, rel string, is_dir boolean"), lists and f"{lists}/{depth}")
        found = level.where("not is_dir").select("source", "rel", F.concat_ws("/", F.lit(shown), "source", "rel").alias("path"))
        files = found if files is None else files.unionByName(found)
        folders = level.where("is_dir").select("source", F.concat("rel", F.lit("/")).alias("folder"))
        n = folders.count()
        if not n:
            return files


def co_listed(spark: SparkSession, root: str, sources: dict[str, str], suffix: str = ".pt", renamed: dict[str, tuple[str, str]] | None = None, lists: str | None = None) -> DataFrame:
    """SRC-15: the samples of which every source has its file: one row with the path in each source (column names are
    the values of ``sources``, folders below ``root`` its keys). The first source, or ``latents``, says which samples
    there are; ``renamed`` maps a folder to the prefixes (in the first source, in this one) by which names differ.
    Files are listed by tasks (``listed_files``, all sources at once), not read."""
    lead = "latents" if "latents" in sources else next(iter(sources))
    renamed = {"conditions": ("latent_", "condition_")} if renamed is None else renamed
    listed, out = listed_files(spark, root, suffix, list(sources), lists), None
    for folder, column in sorted(sources.items(), key=lambda x: x[0] != lead):
        files = listed.where(F.col("source") == folder).drop("source").withColumnRenamed("path", column)
        if out is None:
            out = files
            continue
        key = F.col("rel")
        if folder in renamed:
            there, here = renamed[folder]
            name = F.substring_index("rel", "/", -1)
            key = F.when(F.startswith(name, F.lit(there)), F.concat(F.lit(here), F.substr(name, F.lit(len(there) + 1)))).otherwise(F.col("rel"))
        out = out.withColumn("_k", key).join(files.withColumnRenamed("rel", "_k"), "_k").drop("_k")
    return out.withColumnRenamed("rel", "sample")


def annotations(spark: SparkSession, merge: str, schema: str) -> DataFrame:
    """SRC-06: the records of the annotation list that ``merge`` names in its one line ``folder,json``, their
    ``path`` below the folder."""
    lines = prompts(spark, merge).limit(2).collect()
    pairs = [tuple(x.strip() for x in r["prompt"].split(",")) for r in lines]
    if len(pairs) != 1 or len(pairs[0]) != 2:
        raise ValueError(f"{merge}: one line with a folder and a list is asked for")
    folder, path = pairs[0]
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("path", F.concat_ws("/", F.lit(folder), "path"))


def built_dataset(records: DataFrame, folder: str, keep: Column, shards: int = 1, index: int = 0) -> DataFrame:
    """SRC-08: merged records as a dataset: cap and path under the names caption and name, rows that ``keep`` holds
    for, one of ``shards`` strided parts in order of name, and the video's place."""
    named = records.withColumnsRenamed({"cap": "caption", "path": "name"}).where(keep)
    if shards > 1:
        named = joins.positions(named, ["name"]).where(F.col("pos") % shards == index).drop("pos")
    return named.withColumn("video", F.concat_ws("/", F.lit(folder), "name"))


def csv_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-13: rows of CSV files with a header, by column name."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def worker_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SNK-03: the rows of ``sinks.write_worker_chunks`` with their ``worker`` and ``chunk``."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    at = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(at, r"/worker=(\d+)/[^/]*$", 1).cast("int").alias("worker"), F.regexp_extract(at, r"/data_chunk_(\d+)\.parquet$", 1).cast("int").alias("chunk"))


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The lines of text files with their number ``pos``, in order of file and place."""
    lines = spark.read.text(path).select(F.col("value").alias(name), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    return joins.positions(lines.withColumn("_i", F.monotonically_increasing_id()), ["_f", "_b", "_i"]).drop("_f", "_b", "_i")


def zipped_files(spark: SparkSession, prompts_path: str, videos_path: str) -> DataFrame:
    """SRC-14: two text files, line by line; another number of lines fails the query."""
    both = numbered_lines(spark, prompts_path, "prompt").join(numbered_lines(spark, videos_path, "video"), "pos", "full_outer")
    alike = F.col("prompt").isNotNull() & F.col("video").isNotNull()
    return both.withColumn("prompt", F.when(alike, F.col("prompt")).otherwise(F.raise_error(F.lit("the files have other numbers of lines"))))


def expanded_media(spark: SparkSession, specs: list[str], suffixes: tuple[str, ...]) -> DataFrame:
    """SRC-16: the files that folders, patterns and paths name, each once, where it comes first: ``spec`` is the
    number of the specification, and files of one come in order of path."""
    out = None
    for i, spec in enumerate(specs):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "*" not in spec).load(spec).select(F.lit(i).alias("spec"), "path")
        out = files if out is None else out.unionByName(files)
    return out.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes)).groupBy("path").agg(F.min("spec").alias("spec"))


def prompt_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: prompts of a .json list or .jsonl lines; an entry is a text or a record with prompt or text_prompt.
    Entries without either, or with blank ones, are left out."""
    if path.rstrip("/").endswith(".jsonl"):
        lines = spark.read.text(path).where(F.trim("value") != "").select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"))
    else:
        lines = spark.read.text(path, wholetext=True)
    entry = lines.select(F.posexplode(F.from_json("value", "array<string>")).alias("i", "e"))
    record = F.from_json("e", "prompt string, text_prompt string")
    prompt = F.when(F.startswith(F.ltrim("e"), F.lit("{")), F.coalesce(record["prompt"], record["text_prompt"])).otherwise(F.col("e"))
    return entry.select(F.trim(prompt).alias("prompt")).where("prompt <> ''")


_CORPORA: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_corpus(name: str, build: Callable[[SparkSession], DataFrame]) -> None:
    """SRC-18: a corpus of prompts by name; it is built when it is asked for."""
    _CORPORA[name] = build


def corpora() -> list[str]:
    return sorted(_CORPORA)


def corpus(spark: SparkSession, name: str) -> DataFrame:
    if name not in _CORPORA:
        raise KeyError(f"no corpus {name!r}; there are {', '.join(corpora())}")
    return _CORPORA[name](spark)


def segment_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """SRC-20: candidates of all ``seg_*/metadata.json`` below a folder: segment, the record's fields, and a row for
    each of its ``nodes``."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/seg_*")
    segment = F.regexp_extract(F.col("_metadata.file_path"), r"/seg_([^/]+)/", 1)
    return rows.withColumn("segment", segment).withColumn("node", F.explode("nodes")).drop("nodes")


def latent_annotations(spark: SparkSession, path: str, latents: DataFrame, last: int, seed: int, rate: float) -> DataFrame:
    """SRC-22: the latents that a JSON list of file names picks, their last ``last`` steps; for a share ``rate`` of
    rows, by hash, the condition is dropped (``dropped``)."""
    names = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("name"))
    rows = names.join(latents, "name")
    return rows.withColumn("latent", F.slice("latent", -last, last)).withColumn("dropped", ~kept_by_hash(F.col("name"), seed, rate))
