"""What the operators of this subpackage share: tables in the shared folder, id casts, byte views of
Arrow text columns, word hashes, and a stratified sample with a stated bound."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWNED: dict[str, SparkSession] = {}


# --------------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (tests) may it be unset, and a temporary folder is then set for the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if not _OWNED:
        atexit.register(_remove_all)
    _OWNED[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _OWNED.pop(path, None)


def _remove_all() -> None:
    for path, spark in list(_OWNED.items()):
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder goes with it
            _OWNED.pop(path, None)


def table(df: DataFrame, name: str, compression: str = "lz4_raw") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPLIT = 128 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``. One of fewer files than cores and under ``SPLIT`` bytes may be a single row
    group, which one task would work through alone; its rows are dealt over the cores first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at)
    cores = spark.sparkContext.defaultParallelism
    df = spark.read.parquet(path)
    return df.repartition(cores) if held.getFileCount() < cores and held.getLength() < SPLIT else df


# --------------------------------------------------------------------- columns


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fold of a document. Null ids have no fold."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, by: str, key: str, bound: int, size: str | None = None, most: int = 0) -> DataFrame:
    """About ``bound`` rows at most for each value of ``by``, taken by hash of ``key``, whose column ``size``
    (if named) adds up to about ``most``.

    The bounds are the documented parameters of the classifiers fitted here. Each group keeps the
    rows whose hash is under bound / its size, so no sort, window or exchange of rows is needed; ``by`` is a
    column of labels, and a row a label reaches every task.
    """
    rates = [F.lit(float(bound)) / F.count("*")] + ([F.lit(float(most)) / F.greatest(F.sum(size), F.lit(1))] if size else [])
    sizes = df.groupBy(by).agg((F.least(*rates) if size else rates[0]).alias("_rate"))
    unit = F.pmod(F.xxhash64(F.lit(20), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.join(F.broadcast(sizes), by).where(unit < F.col("_rate")).drop("_rate")


# --------------------------------------------------------------------- bytes of text columns


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of an Arrow text or binary column; null counts as empty."""
    large = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(large)
    if col.null_count:
        col = pc.fill_null(col, b"" if large == pa.large_binary() else "")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of ``most`` bytes at most each (a longer row stands alone)."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = min(hi, n)
    return out


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (two multiply and shift rounds)."""
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xFF51AFD7ED558CCD)
    a ^= a >> np.uint64(33)
    a *= np.uint64(0xC4CEB9FE1A85EC53)
    a ^= a >> np.uint64(33)
    return a


_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << (max(n, 1 << 16) - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; the hash of [s, e) is (h[e] - h[s]) * base**-s."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=out[1:])
    return out


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_ascii()
_PIECE = 1 << 20


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run of ``is_word`` bytes inside one row), in ``data``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    w = is_word[data[lo:hi]]
    before = np.empty(len(w), dtype=bool)
    if len(w):
        before[0] = False
        before[1:] = w[:-1]
        cuts = offsets[1:-1] - lo
        before[cuts[cuts < len(w)]] = False
    starts = np.flatnonzero(w & ~before)
    after = np.zeros(len(w), dtype=bool)
    if len(w):
        after[:-1] = w[1:] & before[1:]
    ends = np.flatnonzero(w & ~after) + 1
    return starts + lo, ends + lo


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, letters A-Z lower-cased; bounded pieces of bytes at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        h = prefix_hash(LOWER[data[lo:hi]])
        _, down = powers(hi - lo + 1)
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((h[e] - h[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.full(m, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        acc = acc * np.uint64(0x2545F4914F6CDD1D) + words[k : k + m]
        acc ^= acc >> np.uint64(29)
    return mix(acc)


# --------------------------------------------------------------------- joins and components

BROADCAST_IDS = 2_000_000


def small_side(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (a written table of single longs) with a broadcast hint if it has ``most`` rows or fewer."""
    return F.broadcast(ids) if ids.count() <= most else ids


HEAVY = 1024


def keyed_join(rows: DataFrame, sides: DataFrame, key: str, size: str = "size", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``sides``, one row for each value of ``key``, whose column ``size`` says how many of
    ``rows`` have it (or how many at least). Both are written tables.

    Values with over 1 / ``HEAVY`` of all rows, fewer than ``HEAVY`` of them, are broadcast, so their rows stay
    where they are; the others are shuffled, and none of those fills a task.
    """
    total = sides.agg(F.sum(size)).first()[0] or 0  # one number
    heavy = sides.where(F.col(size) * HEAVY > total)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(sides.where(F.col(size) * HEAVY <= total), key, how)
    return rows.join(F.broadcast(heavy), key).unionByName(light).drop(size)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node) of every connected component; roots themselves have no row.

    Large-star and small-star steps in turn, each round a written table, until no edge changes. Both
    are joins and partial minima on the edges, so no component is ever gathered in one task.
    """
    e = table(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _edge_state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # the node itself keeps its edge to the least neighbour
        e_next = table(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        was, state = state, _edge_state(e_next)
        e = e_next
        if was == state:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _edge_state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
