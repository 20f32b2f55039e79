"""Operator 10: benchmark decontamination.

The windows of the benchmark (``window`` consecutive normalised words of an item; an item with fewer
words is one window) go to the executors as sorted arrays of hashes. Training texts are scanned
window by window in numpy; every hash hit is verified word by word before it counts.

The broadcast is bounded: benchmark items are dealt into shards of ``SHARD_BYTES`` of text, each shard
is broadcast and scanned for in turn, and what was found is carried in a written table between
shards. One shard (the usual case) is one map-only pass.

Defined results: words are maximal runs of a-z, 0-9 and bytes from 0x80, after A-Z are lower-cased;
null and empty texts have no words; items without words have no window; benchmark rows with the same
id are one item; a null item id is the item ``null``; repeated documents are scanned one by one; a
benchmark without rows marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, byte_view, shingle_hashes, slices, table, word_hashes, word_spans

WINDOW = 10
SHARD_BYTES = 8 << 20
_FILTER_BITS = 20
_CHUNK = 1 << 20

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[:128] = False
IS_WORD[ord("0") : ord("9") + 1] = IS_WORD[ord("a") : ord("z") + 1] = IS_WORD[ord("A") : ord("Z") + 1] = True


def _words_of(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    return b" ".join(LOWER[data[a:b]].tobytes() for a, b in zip(s, e, strict=True))


def window_index(items: list[tuple[str, str]], window: int = WINDOW) -> dict:
    """Sorted window hashes by window length, with the item and the words of each window."""
    names, lengths = [], {}
    for name, text in items:
        offsets, data = byte_view(pa.array([text], pa.string()))
        s, e = word_spans(data, offsets, IS_WORD)
        if not len(s):
            continue
        h, n = word_hashes(data, s, e), min(window, len(s))
        lengths.setdefault(n, []).extend((int(x), len(names), i) for i, x in enumerate(shingle_hashes(h, n)))
        names.append((name, data, s, e))
    index = {}
    for n, rows in lengths.items():
        rows.sort()
        hashes = np.array([r[0] for r in rows], dtype=np.uint64)
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        index[n] = (hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), seen)
    return {"items": names, "windows": index}


def _hits(index: dict, data: np.ndarray, s: np.ndarray, e: np.ndarray, words: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """(row, first word, window length, item) of each verified occurrence in a chunk of rows."""
    known: dict = {}
    for n, (hashes, item, pos, seen) in index["windows"].items():
        h = shingle_hashes(words, n)
        if not len(h):
            continue
        at = np.flatnonzero(seen[h >> np.uint64(64 - _FILTER_BITS)])
        at = at[doc_of[at] == doc_of[at + n - 1]]
        first = np.searchsorted(hashes, h[at])
        ok = first < len(hashes)
        ok[ok] = hashes[first[ok]] == h[at[ok]]
        for k, j in zip(at[ok], first[ok], strict=True):
            here = _words_of(data, s[k : k + n], e[k : k + n])
            while j < len(hashes) and hashes[j] == h[k]:
                if (n, j) not in known:
                    _, d, a, b = index["items"][item[j]]
                    known[n, j] = _words_of(d, a[pos[j] : pos[j] + n], b[pos[j] : pos[j] + n])
                if known[n, j] == here:
                    yield int(doc_of[k]), int(k), n, index["items"][item[j]][0]
                j += 1


def _scan(rows: DataFrame, index: dict, key_type: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)
    schema = f"id {key_type}, t string, n_words bigint, hit array<int>, items array<string>"
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[5:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            offsets, data = byte_view(b.column(1))
            counts = np.zeros(b.num_rows, dtype=np.int64)
            old_hit, old_items = b.column(3).to_pylist(), b.column(4).to_pylist()
            hit, items = [set(x or ()) for x in old_hit], [set(x or ()) for x in old_items]
            for lo, hi in slices(offsets, _CHUNK):
                s, e = word_spans(data, offsets[lo : hi + 1], IS_WORD)
                doc_of = np.searchsorted(offsets[lo : hi + 1], s, side="right") - 1
                counts[lo:hi] = np.bincount(doc_of, minlength=hi - lo)
                begin = np.concatenate(([0], np.cumsum(counts[lo:hi])))
                for row, k, n, name in _hits(index, data, s, e, word_hashes(data, s, e), doc_of):
                    hit[lo + row].update(range(k - begin[row], k - begin[row] + n))
                    items[lo + row].add(name)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array([sorted(x) for x in hit], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *b.columns[5:]],
                names=b.schema.names,
            )

    return rows.mapInArrow(run, schema)


def _shards(benchmark: DataFrame, shard_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in lists of about ``shard_bytes`` of text, one list on the driver at once."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, rest: bool = False) -> DataFrame:
    """doc_id, text, n_words, hit (numbers of the words inside occurrences), items (sorted ids as text);
    with ``rest`` also a struct ``rest`` of the whole row."""
    key_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"), *([F.struct(*docs.columns).alias("rest")] if rest else []))
    for k, items in enumerate(_shards(benchmark, shard_bytes)):
        rows = _scan(table(rows, "decontaminate") if k else rows, window_index(items, window), key_type)
    return rows.select(F.col("id").alias("doc_id"), F.col("t").alias("text"), "n_words", "hit", "items", *(["rest"] if rest else []))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of each document's occurrences."""
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window occurs."""
    return find_contamination(docs, benchmark, rest=True).where(F.size("hit") == 0).select("rest.*")


def remove_hit_words(texts: pa.Array, hits: list) -> list:
    """Each text without its hit words (and the separators inside a run of them)."""
    offsets, data = byte_view(texts)
    out = []
    for i, hit in enumerate(hits):
        row = data[offsets[i] : offsets[i + 1]]
        if not hit:
            out.append(row.tobytes().decode("utf-8", "replace"))
            continue
        s, e = word_spans(row, np.array([0, len(row)]), IS_WORD)
        keep, inside = np.ones(len(row), dtype=bool), set(hit)
        for k in hit:
            keep[s[k] : (s[k + 1] if k + 1 < len(s) and k + 1 in inside else e[k])] = False
        out.append(row[keep].tobytes().decode("utf-8", "replace"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """(doc_id, text) without contaminated documents, or with the hit words cut out (``remove='spans'``)."""
    found = find_contamination(docs, benchmark)
    if remove == "documents":
        return found.where(F.size("hit") == 0).select("doc_id", "text")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(remove_hit_words(b.column(1), b.column(2).to_pylist()), pa.string())], names=["doc_id", "text"])

    return found.select("doc_id", "text", "hit").mapInArrow(cut, f"doc_id {key_type}, text string")
