"""Operator 2: removal of repeated byte strings by column-wise multi-document suffix sorting.

The construction inserts one symbol of every text each round and updates, in one pass over the current
order, the order of the suffixes (the collection's Burrows-Wheeler order) and the common prefixes of
neighbours. Over whole texts that takes as many rounds as the longest text has bytes, and every round
passes over all that was inserted before. So the collection is cut first, without losing a match:

1. Each string of ``MATCH`` bytes has an anchor, its least hashed ``GRAM``-byte gram (the leftmost one of
   equals). Equal strings have the same anchor at the same place, so only strings that share an anchor
   need to meet. The starts of a text fall into runs with one anchor; a run and its bytes are a piece.
2. Pieces with the same bytes (same anchor, an independent 64-bit digest of all bytes) are counted once, those
   side by side in one text already where they are cut; anchors that occur once are dropped.
3. The pieces of an anchor, aligned at it, are one collection. From the last column to the first, each
   round inserts one symbol per piece (``ColumnSort``): a stable sort by it gives the new order, running
   minima give the common prefixes, and a start repeats if it shares ``MATCH`` bytes with a neighbour.
   Pieces arrive sorted by anchor, in sequential files that Spark's external sort has written.
4. An anchor with over ``HOT`` different pieces is not sorted in one task: its strings are counted by
   hash, with partial counts before the exchange.

Defined results: null text is empty; texts under ``MATCH`` bytes lose nothing; repeated rows and equal
texts repeat each other; matches inside one text count, overlapping ones too; rows with a null or a
repeated doc_id are rows of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_view, mix, powers, prefix_hash, slices, table

MATCH = 400
GRAM = 32
HOT = 50_000
_CHUNK = 1 << 19
_POSITION_BITS = 21
_SLICE = 20_000

_PIECE = "a int, n int, off int, anchor bigint, d bigint, reps int"


def _span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return (h[e] - h[s]) * down[s]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values."""
    m = len(x) - w + 1
    if m <= 0:
        return x[:0]
    rows = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    rows[: len(x)] = x
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def cut_pieces(data: np.ndarray, bounds: np.ndarray, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first start, number of starts, anchor's distance, anchor, digest and repeats of each piece.

    ``data`` holds the bytes of some texts one after the other, ``bounds`` where each begins and the end.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < match:
        return (none,) * 7
    h = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = mix(_span_hash(h, at, at + gram))
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = _sliding_min((grams & ~low) | at.astype(np.uint64), match - gram + 1)
    anchor_at = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor_at)]
    whole = np.arange(len(anchor_at)) + match <= bounds[1:][row]
    new = np.ones(len(anchor_at), dtype=bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (row[1:] != row[:-1])
    new &= whole
    end = np.zeros(len(anchor_at), dtype=bool)
    end[:-1] = whole[:-1] & (new[1:] | ~whole[1:])
    end[-1] = whole[-1]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    n, off = last - first + 1, anchor_at[first] - first
    body = memoryview(np.ascontiguousarray(data))
    digest = np.frombuffer(b"".join(hashlib.md5(body[s:e]).digest()[:8] for s, e in zip(first.tolist(), (last + match).tolist(), strict=True)), dtype=np.int64)
    digest = digest ^ (n * 1024 + off)
    cols = row[first], first - bounds[row[first]], n, off, grams[anchor_at[first]].view(np.int64), digest
    # equal pieces side by side in one text (a repeated byte, a repeated line) are one row that counts them
    new = np.ones(len(first), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in (cols[0], *cols[2:])], axis=0) | (first[1:] != first[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return *(c[at] for c in cols), np.diff(np.append(at, len(first)))


def _texts(docs: DataFrame) -> DataFrame:
    """key (of the row's id and text), doc_id, t (text or empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), text).cast("binary"))).alias("key"), "doc_id", text.alias("t"))


def pieces(texts: DataFrame, match: int = MATCH) -> DataFrame:
    """key and p, the array of pieces (a, n, off, anchor, d, reps) of each text that has one."""
    kind = pa.struct([("a", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("anchor", pa.int64()), ("d", pa.int64()), ("reps", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = byte_view(b.column(1))
            for lo, hi in slices(offsets, _CHUNK):
                got = []
                if hi - lo == 1:  # maybe a long text: its starts by and by
                    size = int(offsets[hi] - offsets[lo])
                    for s in range(0, max(size - match + 1, 0), _CHUNK):
                        part = data[offsets[lo] + s : min(offsets[lo] + s + _CHUNK + match - 1, offsets[hi])]
                        row, a, *rest = cut_pieces(part, np.array([0, len(part)]), match)
                        got.append((row, a + s, *rest))
                else:
                    got.append(cut_pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], match))
                cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, dtype=np.int64)] * 7
                counts = np.bincount(cols[0], minlength=hi - lo)
                some = np.flatnonzero(counts)
                values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols[1:], kind, strict=True)], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts[some]))), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(some)), lists], names=["key", "p"])

    return texts.select("key", "t").mapInArrow(run, f"key binary, p array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>")


def piece_texts(texts: DataFrame, wanted: DataFrame, match: int = MATCH) -> DataFrame:
    """anchor, d, n, off, copies, kinds and the bytes of each piece in ``wanted``."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("a", "n", "off", "anchor", "d", "copies", "kinds")).alias("p"))
    rows = texts.select("key", "t").join(lists, "key").select("t", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = byte_view(b.column(0))
            flat = b.column(1).flatten()
            owner = np.repeat(np.arange(b.num_rows), np.asarray(b.column(1).value_lengths().fill_null(0)))
            a, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("a", "n"))
            start = offsets[:-1][owner] + a
            for lo in range(0, len(owner), 4096):
                cut = slice(lo, lo + 4096)
                body = [data[s : s + k + match - 1].tobytes() for s, k in zip(start[cut], n[cut], strict=True)]
                yield pa.RecordBatch.from_arrays([*(flat.field(k).slice(lo, 4096) for k in ("anchor", "d", "n", "off", "copies", "kinds")), pa.array(body, pa.binary())], names=["anchor", "d", "n", "off", "copies", "kinds", "body"])

    return rows.mapInArrow(run, "anchor bigint, d bigint, n int, off int, copies bigint, kinds bigint, body binary")


class ColumnSort:
    """Suffix order and common prefixes of aligned pieces; ``insert`` adds one symbol to each of them.

    ``group`` (sorted) keeps collections apart. A symbol of 0 means that the piece has none here.
    """

    def __init__(self, group: np.ndarray, most: int):
        self.high = group.astype(np.int64) << 9
        self.order = np.arange(len(group))
        self.common = np.zeros(len(group) + 1, dtype=np.int32)  # with the neighbour before; the last is a bound
        self.most = most

    def insert(self, column: np.ndarray) -> None:
        key = self.high + column[self.order]
        common = self.common
        if (key[1:] >= key[:-1]).all():
            before = common[:-1].copy()
            place = None
        else:
            place = np.argsort(key, kind="stable")
            key = key[place]
            before = common[place]
            apart = np.flatnonzero((key[1:] == key[:-1]) & (place[1:] > place[:-1] + 1)) + 1
            if len(apart):
                bounds = np.empty(2 * len(apart), dtype=np.int64)
                bounds[0::2], bounds[1::2] = place[apart - 1] + 1, place[apart] + 1
                before[apart] = np.minimum.reduceat(common, bounds)[0::2]
            self.order = self.order[place]
        same = np.zeros(len(key), dtype=bool)
        same[1:] = (key[1:] == key[:-1]) & ((key[1:] & 511) > 0)
        common[:-1] = np.where(same, np.minimum(before + 1, self.most), 0)

    def repeated(self) -> np.ndarray:
        """Whether each piece, by its number, shares ``most`` symbols with a neighbour."""
        full = self.common >= self.most
        full[0] = False
        out = np.zeros(len(self.order), dtype=bool)
        out[self.order] = full[:-1] | full[1:]
        return out


def repeated_starts(group: np.ndarray, n: np.ndarray, off: np.ndarray, bodies: list[bytes], match: int = MATCH, gram: int = GRAM) -> list[np.ndarray]:
    """For each piece the starts (counted from its first) whose ``match`` bytes start elsewhere too."""
    left, m = match - gram, len(n)
    width = left + match
    text = np.zeros((m, width), dtype=np.int16)
    for i, body in enumerate(bodies):
        lo = left - off[i]
        text[i, lo : lo + len(body)] = np.frombuffer(body, dtype=np.uint8)
        text[i, lo : lo + len(body)] += 1
    text = np.ascontiguousarray(text.T)
    sort, found = ColumnSort(group, match), np.zeros((left + 1, m), dtype=bool)
    for c in range(width - 1, -1, -1):
        sort.insert(text[c])
        if c <= left:
            found[c] = sort.repeated()
    return [np.flatnonzero(found[left - off[i] : left - off[i] + n[i], i]) for i in range(m)]


def _runs(starts: np.ndarray) -> list[int]:
    """[first, end, first, end, ...] of the runs of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([np.concatenate((starts[:1], starts[cut + 1])), np.append(starts[cut], starts[-1]) + 1], axis=1).ravel().tolist()


def _sorted_pieces(bodies: DataFrame, match: int) -> DataFrame:
    """anchor, d, runs of the pieces of anchors with at most HOT kinds of pieces."""
    names = ["anchor", "d", "n", "off", "body"]

    def solve(rows: dict) -> pa.RecordBatch:
        anchor, d = np.array(rows["anchor"], dtype=np.int64), np.array(rows["d"], dtype=np.int64)
        group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
        starts = repeated_starts(group, np.array(rows["n"]), np.array(rows["off"]), rows["body"], match)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(d), pa.array([_runs(s) for s in starts], pa.list_(pa.int32()))], names=["anchor", "d", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = {k: [] for k in names}, None
        for b in batches:
            cols = {k: b.column(b.schema.get_field_index(k)).to_pylist() for k in names}
            for i in range(b.num_rows):
                if last is not None and (cols["anchor"][i], cols["d"][i]) == last:
                    continue  # a repeated row of the table
                if len(rows["d"]) >= _SLICE and cols["anchor"][i] != last[0]:
                    yield solve(rows)
                    rows = {k: [] for k in names}
                last = cols["anchor"][i], cols["d"][i]
                for k in names:
                    rows[k].append(cols[k][i])
        if rows["d"]:
            yield solve(rows)

    return bodies.select(*names).repartition("anchor").sortWithinPartitions("anchor", "d").mapInArrow(run, "anchor bigint, d bigint, runs array<int>")


def _counted_pieces(bodies: DataFrame, match: int) -> DataFrame:
    """anchor, d, runs of the other pieces: every string by hash, counted with partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                body = np.frombuffer(b.column(3)[i].as_py(), dtype=np.uint8)
                at = np.arange(len(body) - match + 1)
                h = prefix_hash(body)
                one, two = mix(_span_hash(h, at, at + match)), mix(_span_hash(h, at + match // 2, at + match))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(k)[0 + i].as_py()] * len(at), pa.int64()) for k in (0, 1)] + [pa.array(at, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([b.column(2)[i].as_py()] * len(at), pa.int64())], names=["anchor", "d", "s", "h1", "h2", "copies"])

    strings = bodies.select("anchor", "d", "copies", "body").mapInArrow(run, "anchor bigint, d bigint, s int, h1 bigint, h2 bigint, copies bigint")
    often = strings.groupBy("h1", "h2").agg(F.sum("copies").alias("c")).where("c > 1").select("h1", "h2")
    hits = strings.join(often, ["h1", "h2"]).groupBy("anchor", "d").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return hits.select("anchor", "d", F.flatten(F.transform("s", lambda s: F.array(s, s + 1))).alias("runs"))


def find_repeats(docs: DataFrame, match: int = MATCH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The texts (key, doc_id, t) and, by key, the runs of starts whose string starts elsewhere too."""
    texts = _texts(docs)
    every = table(pieces(texts, match), "pieces").select("key", F.explode("p").alias("p")).select("key", "p.*")
    kinds = every.groupBy("anchor", "d").agg(F.sum("reps").alias("copies"), F.min(F.struct("key", "a", "n", "off")).alias("at"))
    kinds = table(kinds, "kinds")
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).where("total > 1").select("anchor", "kinds")
    kinds = kinds.join(anchors, "anchor").select("anchor", "d", "copies", "kinds", "at.*")
    wanted = table(kinds, "repeated")
    whole = wanted.where("copies > 1").select("anchor", "d", F.array(F.lit(0), "n").alias("runs"))
    some = wanted.where("kinds > 1")
    bodies = piece_texts(texts, some, match)
    if some.where(F.col("kinds") > hot).limit(1).count():
        bodies = table(bodies, "bodies")
        found = _sorted_pieces(bodies.where(F.col("kinds") <= hot), match).unionByName(_counted_pieces(bodies.where(F.col("kinds") > hot), match))
    else:
        found = _sorted_pieces(bodies, match)
    once = wanted.where("copies = 1").select("anchor", "d")
    runs = table(found.where(F.size("runs") > 0), "runs").join(once, ["anchor", "d"], "left_semi").unionByName(whole)
    placed = every.join(runs, ["anchor", "d"]).select("key", F.struct("a", F.when(F.col("reps") > 1, F.array(F.lit(0), F.col("n") * F.col("reps"))).otherwise(F.col("runs")).alias("runs")).alias("r"))
    return texts, placed.groupBy("key").agg(F.collect_set("r").alias("found"))


def covered(found: list | None, match: int = MATCH) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the found strings cover."""
    spans: list[list[int]] = []
    for s, e in sorted((r["a"] + r["runs"][k], r["a"] + r["runs"][k + 1] - 1 + match) for r in found or () for k in range(0, len(r["runs"]), 2)):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    return [(s, e) for s, e in spans]


def _each(docs: DataFrame, match: int, hot: int, schema: str, rows) -> DataFrame:
    texts, found = find_repeats(docs, match, hot)
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = byte_view(b.column(1))
            out = [rows(data[offsets[i] : offsets[i + 1]], covered(x, match)) for i, x in enumerate(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*out, strict=True))], names=["doc_id", *[c.split()[0] for c in schema.split(", ")]]) if out else b.slice(0, 0)

    return texts.join(found, "key", "left").select("doc_id", "t", "found").mapInArrow(run, f"doc_id {key_type}, {schema}")


def _kept(data: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in spans:
        parts.append(data[at:s].tobytes())
        at = e
    return b"".join([*parts, data[at:].tobytes()])


def dedup_report(docs: DataFrame, match: int = MATCH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the digest of the remaining bytes and whether any were removed."""
    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, repeated boolean"
    return _each(docs, match, hot, schema, lambda data, spans: (len(data), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest(), bool(spans)))


def remove_repeats(docs: DataFrame, match: int = MATCH, hot: int = HOT) -> DataFrame:
    """(doc_id, text) of the bytes that remain; a character of which only a part remains becomes U+FFFD."""
    return _each(docs, match, hot, "text string", lambda data, spans: (_kept(data, spans).decode("utf-8", "replace"),))
