"""Operator 7: WARC archives with a Zstandard dictionary.

Every row of pages becomes one WARC record. Tasks write archives (``.warc.zst``) of ``ARCHIVE_BYTES``
of payload each to the shared folder: a dictionary is built from the archive's own records, embedded
in a leading skippable frame, and each record is compressed on its own with it. The reader takes the
dictionary from the leading frame, then the records one frame at a time.

Among records with equal payloads of ``LEAST`` bytes or more the one with the smallest page_id is a
``response`` and carries the payload; the others are ``revisit`` records that name it and its digest.

Defined results: null html is an empty payload; rows that repeat the smallest page_id are all
responses; rows with a null page_id are responses and never referred to; a table without rows makes
an archive folder without archives; other columns are not read. An archive's name holds the attempt that
wrote it and only the listing of the attempt that Spark commits is read, so a task that runs again, or twice
at once, never mixes its archives with another's. Dictionaries are trained on ``SAMPLE_BYTES`` of an
archive's records, the first 64 KB of each; that changes its size, never what is read back.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed_join, scratch, table

LEAST = 100
MOST_COPIES = 200_000
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"  # archives are reproducible: no clock in them

# The magic numbers of the skippable frame that holds a dictionary and of a frame.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response) of each row of pages.

    Digests that occur again are found from keys alone. While there are ``MOST_COPIES`` of them or fewer they
    are broadcast and no payload moves; beyond that payloads are shuffled by digest, but those of the few
    digests that many rows share stay where they are.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    copies = (
        rows.where((F.octet_length("payload") >= LEAST) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count("*").alias("size"))
        .where("first_id < last_id")
        .select("digest", "first_id", "size")
    )
    copies = table(copies, "copies")
    if copies.count() <= MOST_COPIES:
        joined = rows.join(F.broadcast(copies.drop("size")), "digest", "left")
    else:  # what cannot be a copy, such as all empty pages, has no part in the shuffle
        single = (F.octet_length("payload") < LEAST) | F.col("page_id").isNull()
        joined = keyed_join(rows.where(~single), copies, "digest", how="left").unionByName(rows.where(single).withColumn("first_id", F.lit(None).cast(rows.schema["page_id"].dataType)))
    refers = F.when(F.col("first_id") < F.col("page_id"), F.col("first_id"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").cast("bigint").alias("n"), "digest", refers.alias("refers_to"))


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def encode_record(page_id, url: str | None, payload: bytes | None, n: int, digest: str, refers_to) -> bytes:
    """The bytes of one record: header lines, a blank line, the block, two line ends."""
    block = b"" if refers_to is not None else payload or b""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Page-ID": "" if page_id is None else page_id,
        "WARC-Payload-Length": n,
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": _record_id(refers_to), "WARC-Refers-To-Page-ID": refers_to, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head["Content-Length"] = len(block)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not hold")
    return fields, rest[:n]


def make_dictionary(records: list[bytes]):
    """A trained dictionary; where there is too little to train on, the records' own bytes."""
    import zstandard

    sample, size = [], 0
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for r in records[::step]:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[: 1 << 16])
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:
        raw = b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: list[bytes]) -> None:
    import zstandard

    words = make_dictionary(records)
    body = words.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True)
    for r in records:
        out.write(compress.compress(r))


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one frame after the other; what is read stays small."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame leads the archive")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    rest = b""
    while True:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not rest:
                rest = source.read(1 << 16)
                if not rest:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of ``plan_records``; one row (archive, n_records, n_bytes) for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        task = TaskContext.get()
        part, kept, size, made = f"{task.partitionId():06d}-{task.taskAttemptId()}", [], 0, []
        store.create_dir(root, recursive=True)

        def flush() -> None:
            name = f"{root}/part-{part}-{len(made):04d}.warc.zst"
            hidden = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(hidden, compression=None) as out:
                write_archive(out, kept)
            store.move(hidden, name)
            made.append((name.rpartition("/")[2], len(kept), store.get_file_info(name).size))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept.append(encode_record(*row))
                size += len(kept[-1])
                if size >= archive_bytes:
                    flush()
                    kept, size = [], 0
        if kept:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["archive", "n_records", "n_bytes"])

    return records.mapInArrow(run, "archive string, n_records bigint, n_bytes bigint")


def read_archives(archives: DataFrame, folder: str, key_type: str = "bigint") -> DataFrame:
    """One row for each record of the archives: what its headers say, and its block measured again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, root = _filesystem(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for raw in read_archive(source):
                        head, block = decode_record(raw)
                        kind, digest, n = head["WARC-Type"], head["WARC-Payload-Digest"].partition(":")[2], int(head["WARC-Payload-Length"])
                        if kind == "response" and (len(block), hashlib.sha256(block).hexdigest()) != (n, digest):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append((head["WARC-Page-ID"] or None, n, digest, kind, head.get("WARC-Refers-To-Page-ID"), head["WARC-Target-URI"]))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    got = archives.select("archive").mapInArrow(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string")
    return got.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back."""
    folder = scratch(spark, "warc")
    listing = f"{folder}-list"
    write_archives(plan_records(pages), folder).write.parquet(listing)
    written = spark.read.schema("archive string, n_records bigint, n_bytes bigint").parquet(listing)
    spread = written.repartition(max(1, min(written.count(), 1000)))
    return read_archives(spread, folder, pages.schema["page_id"].dataType.simpleString()).drop("url")
