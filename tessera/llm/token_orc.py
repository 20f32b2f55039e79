"""Operator 11: token ids in ORC files, in the order of the documents.

Texts are encoded by the tokenizers library and an end id is appended. The rows are dealt by range of their ids,
sorted, and written as ORC: ids in stripes with integer run-length encoding, row indexes, and Bloom filters on
the document ids. So readers take stripes apart from one another, a lookup by id skips files, stripes and row
groups by their statistics and filters (``lookup``), and lengths are read without touching the ids (``starts``).
A manifest row a file says which documents and tokens it has; ``token_range`` opens no other file.

White space separates tokens in these vocabularies, and so does the place between a letter and a mark: each batch is
cut there, its distinct pieces are found by Arrow, the library gets those that the worker has not met before in
one call, and a bounded table keeps their ids. The tests hold that against whole texts through the library.

Defined results: null and empty text is the end id alone; null ids come first; rows of one id stand in the order of
their CRC, equal rows keep one place each; a text is one row whatever its length; an empty table gives no files'
rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import LOWER, byte_view, remove, scratch, slices

END_ID = 1
TABLE_ENTRIES = 900_000
LONG = 64
GROUP_BYTES = 4 << 20
FILE_TOKENS = 64 << 20
LEAST_TOKENS = 1 << 18
SHIFT = 1 << 15
STRIPE_BYTES = 16 << 20
ROW_GROUP = 1000


# --------------------------------------------------------------------- encoding


# What a byte is: a letter or digit of ASCII, a mark of ASCII that no contraction begins with, white space, or another.
OTHER, LETTER, MARK, SPACE = range(4)
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[33:127] = MARK
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = LETTER
KINDS[ord("'")] = OTHER
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE


def pieces(data: np.ndarray, rows: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of the stretches that a tokenizer of this kind splits apart whatever is around them, which bytes are
    in them (all but white space), and where they start.

    Rows and white space end one, and so does a place between a letter or digit and a mark. Letters of two bytes from
    U+00C0 on count as such; next to any other character nothing is cut, and in ``special`` rows, which may hold
    strings of special tokens, at white space only.
    """
    kind = KINDS[data]
    for i in np.flatnonzero(special):
        kind[rows[i] : rows[i + 1]][kind[rows[i] : rows[i + 1]] == MARK] = OTHER
    lead = (data >= 0xC3) & (data <= 0xC8)
    lead[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # multiplication and division signs
    lead[:-1] &= ~((data[:-1] == 0xC4) & (data[1:] == 0xB0))  # I with a dot, whose lower case ends with a mark
    kind[lead] = LETTER
    kind[1:][lead[:-1]] = LETTER
    space = kind == SPACE
    new = np.zeros(len(data) + 1, dtype=bool)
    pair = kind[:-1] + kind[1:]
    new[1:-1] = space[:-1] | ((pair == LETTER + MARK) & (kind[:-1] != OTHER) & (kind[1:] != OTHER))
    new[rows] = True
    inside, close = ~space, new[1:].copy()
    close[:-1] |= space[1:]
    start = np.flatnonzero(new[:-1] & inside)
    return np.flatnonzero(close & inside) + 1 - start, inside, start


def _values(column: pa.BinaryArray) -> list[bytes]:
    """The values of a binary column without nulls; many times faster than one by one through Arrow."""
    offsets, data = byte_view(column)
    ends, raw = (offsets - offsets[0]).tolist(), data[offsets[0] : offsets[-1]].tobytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Encoder:
    """The tokenizer of one worker, for vocabularies that drop white space and lower the case."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.known: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each piece as unsigned 32-bit integers; the library gets those not met before in one call."""
        known = self.known
        if len(known) + len(words) > TABLE_ENTRIES:
            known.clear()
        out = list(map(known.get, words))
        at = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(at, self.library.encode_batch_fast([words[i].decode() for i in at], add_special_tokens=False), strict=True):
            out[i] = array("I", found.ids).tobytes()
            if len(words[i]) <= LONG:
                known[words[i]] = out[i]
        return out

    def encode(self, data: np.ndarray, rows: np.ndarray, end: int, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (bytes rows[i] to rows[i + 1]), each with the end id, and where each row's begin. Letters
        A-Z are lower-cased first, but in ``special`` rows."""
        n = len(rows) - 1
        low = LOWER[data]
        for i in np.flatnonzero(special):
            low[rows[i] : rows[i + 1]] = data[rows[i] : rows[i + 1]]
        size, inside, start = pieces(low, rows, special)
        offsets = np.zeros(len(start) + 1, dtype=np.int32)
        np.cumsum(size, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
        own = self._ids(_values(words.dictionary))
        count = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        flat = np.frombuffer(b"".join(own), dtype="<u4")
        first = np.cumsum(count) - count
        codes = words.indices.to_numpy(zero_copy_only=False)
        each = count[codes] if len(codes) else np.zeros(0, dtype=np.int64)
        before = np.concatenate(([0], np.cumsum(each)))
        per_row = before[np.searchsorted(start, rows)]  # ids before each row, end ids not counted
        at = per_row + np.arange(n + 1)
        out = np.full(int(at[-1]), end, dtype="<u4")
        source = np.repeat(first[codes] - before[:-1], each) + np.arange(int(before[-1])) if len(codes) else np.zeros(0, dtype=np.int64)
        out[np.arange(int(before[-1])) + np.repeat(np.arange(n), np.diff(per_row))] = flat[source]
        return out, at


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """A worker that goes on to the next task keeps its tokenizer and its table; the broadcast is another object then."""
    definition = shared.value
    if (known := hash(definition)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[known] = Encoder(definition)
    return _ENCODERS[known]


def tokenizer(spark: SparkSession, path: str):
    """A tokenizer file as a broadcast: its size is the vocabulary's, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def is_wide(shared, end: int = END_ID) -> bool:
    """Whether ids need more than 16 bits."""
    ids = Encoder(shared.value).library.get_vocab(with_added_tokens=True).values()
    return max(*ids, end) >= 2 * SHIFT


def encode(docs: DataFrame, shared, text: str = "text", key: str = "doc_id", end: int = END_ID, narrow: bool = False) -> DataFrame:
    """key, n_tokens, crc (unsigned CRC-32 of the ids' bytes) and input_ids of each row, the end id included. ``narrow``
    ids (all below 65,536) travel as 16 bits, less ``SHIFT``; ``write`` takes both."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for b in batches:
            offsets, data = byte_view(b.column(1))
            special = pc.fill_null(pc.match_substring(b.column(1), "<|"), False).to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets, GROUP_BYTES):
                ids, at = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end, special[lo:hi])
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                values = (ids.view("<i4") - SHIFT).astype(np.int16) if narrow else ids.view("<i4")
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(crc, pa.int64()), lists], names=[key, "n_tokens", "crc", "input_ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, n_tokens bigint, crc bigint, input_ids array<{'smallint' if narrow else 'int'}>")


# --------------------------------------------------------------------- files


def write(tokens: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Write encoded rows to ORC files at ``path`` in ascending order of ``key``; returns what ``files`` reads.

    ``place`` numbers the rows through all files: the range in its upper bits, the row in the lower ones. The rows
    are written once in any order first, so that the ranges come from a narrow read of ids.
    """
    spark = tokens.sparkSession
    written = scratch(spark, "tokens")
    tokens.withColumn("tie", F.rand(11)).write.option("compression", "lz4_raw").parquet(written)
    rows = spark.read.parquet(written)
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]  # one number
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(-(-total // FILE_TOKENS), min(usual, -(-total // LEAST_TOKENS)), 1)
    order = [key, "crc", "tie"]
    narrow = rows.schema["input_ids"].dataType.elementType == T.ShortType()
    ids = F.transform("input_ids", lambda x: x.cast("int") + SHIFT) if narrow else F.col("input_ids")
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    (
        dealt.select(key, F.monotonically_increasing_id().alias("place"), "n_tokens", ids.alias("input_ids"))
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.rows.between.memory.checks", ROW_GROUP // 10)  # so that long rows end a stripe in time
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_GROUP)
        .option("orc.bloom.filter.columns", key)
        .option("orc.bloom.filter.fpp", "0.01")
        .mode("error")
        .orc(path)
    )
    remove(spark, written)
    return files(spark, path, key)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, place, n_tokens and input_ids of every row; the reader splits files at their stripes."""
    return spark.read.orc(path)


def files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The manifest: of each range (a file) its name, rows, first and last key, tokens, and the tokens before it.

    From lengths and keys alone; a row a file, at least ``LEAST_TOKENS`` tokens each, so the one window over them is short.
    """
    rows = read(spark, path).select(F.shiftright("place", 33).alias("range"), F.input_file_name().alias("file"), key, "n_tokens")
    each = rows.groupBy("range").agg(F.min("file").alias("file"), F.count("*").alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def starts(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """``rows`` (place, n_tokens and others) with ``start``: the tokens of all rows before."""
    before = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("range", F.shiftright("place", 33)).withColumn("own", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return own.join(manifest.select("range", F.col("start").alias("base")), "range").withColumn("start", F.col("base") + F.col("own")).drop("range", "own", "base")


def lookup(spark: SparkSession, path: str, keys: list, key: str = "doc_id") -> DataFrame:
    """The rows of a few keys: the filter reaches the scan, which skips by statistics and Bloom filters."""
    return read(spark, path).where(F.col(key).isin(keys))


def token_range(spark: SparkSession, manifest: DataFrame, lo: int, hi: int) -> DataFrame:
    """place and the ids of the tokens ``lo`` to ``hi`` (exclusive) of the whole, by rows; opens the files that
    hold them, which are as many as the range asked for is long."""
    held = manifest.where((F.col("start") < hi) & (F.col("start") + F.col("tokens") > lo))
    names = [r.file for r in held.select("file").collect()]  # those of the range asked for
    if not names:
        return spark.createDataFrame([], "place bigint, start bigint, input_ids array<int>")
    rows = starts(spark.read.orc(*names) if len(names) == 1 else spark.read.orc(names), manifest)
    rows = rows.where((F.col("start") < hi) & (F.col("start") + F.col("n_tokens") > lo))
    first = F.greatest(F.lit(lo) - F.col("start"), F.lit(0)).cast("int")
    last = F.least(F.lit(hi) - F.col("start"), F.col("n_tokens")).cast("int")
    return rows.select("place", (F.col("start") + first).alias("start"), F.slice("input_ids", first + 1, last - first).alias("input_ids"))


# --------------------------------------------------------------------- report


def _checked(rows: DataFrame, key: str) -> DataFrame:
    """key, place, n_tokens and ids_crc32, counted anew from the ids read."""
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4")
            at = np.zeros(b.num_rows + 1, dtype=np.int64)
            np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), out=at[1:])
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=[key, "place", "n_tokens", "ids_crc32"])

    return rows.select(key, "place", "input_ids").mapInArrow(run, f"`{key}` {key_type}, place bigint, n_tokens bigint, ids_crc32 bigint")


def token_report(docs: DataFrame, shared) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that are written when the frame is made."""
    path = scratch(docs.sparkSession, "orc")
    manifest = write(encode(docs, shared, narrow=not is_wide(shared)), path)
    rows = _checked(read(docs.sparkSession, path), "doc_id")
    return starts(rows, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
