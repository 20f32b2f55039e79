"""Operator 3: set-similarity join of documents on word n-grams by T-occurrence search (DivideSkip).

A document is the set of its distinct word shingles. The inverted lists of a corpus do not fit one
task, so lists are kept by block: shingles are dealt by hash over segments, more of them than two linked
sets can differ in shingles, so two linked sets agree in the whole of one segment at least, and a block
is the sets that agree in one. Within a block the search is T-occurrence: the long inverted lists of a
query are set aside, the short ones are merged and counted, candidates with enough hits are probed in the
long lists by binary search, and those that reach the overlap the threshold asks for are linked.

1. Equal sets are one class before anything is compared; classes stand for their documents.
2. Every member of a block is first searched from one pivot per block (a star, linear in the block, dealt
   over many tasks when large); components are formed.
3. Blocks that still hold more than one component are searched in full, those with the same least member
   as one, large ones in pairs of bounded parts. Pairs inside one component are skipped: they change
   nothing. Every linked pair shares a block (``Segments``), so no link between components is lost, and no
   list of all pairs is made.

Defined results: words are maximal runs without blanks (space, tab to carriage return), A-Z lower-cased;
texts with fewer words than a shingle have one shingle, texts without words (or null) an empty set, which
links with nothing; equal texts are linked; rows with a null doc_id link as any other and take the least
id of their component (null if there is none); repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_view, components, keyed_join, mix, shingle_hashes, slices, small_side, table, word_hashes, word_spans

NGRAM = 3
THRESHOLD = (90, 100)
BLOCK = 1024
DEALS = 4
_CHUNK = 1 << 20

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(words):
        return words
    return np.unique(shingle_hashes(words, min(n, len(words))))


def needed(a: int, b: int, t: tuple[int, int]) -> int:
    """The least overlap of linked sets of these sizes: t[1] * overlap >= t[0] * union."""
    return -(-t[0] * (a + b) // (t[0] + t[1]))


class Segments:
    """Signatures of sets: one for each segment of hashes, for the band of the set's size and the next.

    Linked sets of up to ``hi`` shingles differ in at most k = 2 * hi * (1 - t) / (1 + t) of them, so they
    agree in ``1 + spare`` or more of ``k + 1 + spare`` segments. A segment without shingles says nothing and is not
    signed. A set with ``spare`` of those or fewer shares a signed segment with each set linked to it; a sparse
    one, with more, might miss other sparse ones, so those are dealt anew, by another hash, up to ``DEALS`` times,
    and what is sparse in all of them signs its prefix: the least of its shingles, so many that linked sets have
    one in common. A set that shares fewer signatures than ``needs`` with all others together has no link, and
    sets of a size at which only equal ones link sign the whole of themselves.
    """

    def __init__(self, t: tuple[int, int]):
        self.t, self.edges, self.plan = t, [1], []

    def band(self, size: int) -> int:
        while len(self.edges) < 4 or self.edges[-4] <= size:
            self.edges.append(self.edges[-1] * self.t[1] // self.t[0] + 1)
        while len(self.plan) < len(self.edges) - 1:
            lo, hi = self.edges[len(self.plan)], self.edges[len(self.plan) + 1] - 1
            k = 2 * hi * (self.t[1] - self.t[0]) // (self.t[1] + self.t[0])
            spare = 2 + (k + 1) // 8 + math.ceil(2 * (k + 1) * math.exp(-max(1, lo) / (k + 1))) if k else 0
            self.plan.append((k + 1 + spare, spare))
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    @staticmethod
    def _deal(s: np.ndarray, n: int, deal: int = 0) -> np.ndarray:
        s = mix(s + np.uint64(deal)) if deal else s
        return (((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)

    def links(self, size: int) -> bool:
        """Whether sets of this size can be linked to a different set."""
        return any(needed(size, b, self.t) <= min(size, b) - (size == b) for b in (size - 1, size, size + 1) if b)

    def needs(self, s: np.ndarray) -> int:
        at, out = self.band(len(s)), []
        for n, spare in self.plan[at : at + 2]:
            empty = int((np.bincount(self._deal(s, n), minlength=n) == 0).sum())
            out.append(1 + spare - empty if empty <= spare else 1)
        return min(out)

    def sign(self, s: np.ndarray) -> np.ndarray:
        out, at = [], self.band(len(s))
        if not self.links(len(s)):
            return mix(s.sum(keepdims=True) + np.uint64(len(s))).view(np.int64)
        low, high = (s & np.uint64(0xFFFFFFFF)).astype(np.float64), (s >> np.uint64(32)).astype(np.float64)
        for band in (at, at + 1):
            n, spare = self.plan[band]
            for deal in range(DEALS):
                seg = self._deal(s, n, deal)
                count = np.bincount(seg, minlength=n)
                total = np.bincount(seg, low, minlength=n).astype(np.uint64) + (np.bincount(seg, high, minlength=n).astype(np.uint64) << np.uint64(32))
                keep = np.flatnonzero(count)
                where = np.uint64((deal << 48) + (band << 32)) + keep.astype(np.uint64)
                out.append(mix(mix(total[keep]) + mix(where + np.uint64(1))))
                if n - len(keep) <= spare:
                    break
            else:
                least = needed(len(s), -(-len(s) * self.t[0] // self.t[1]), self.t)
                out.append(mix(mix(s[: len(s) - least + 1]) + mix(np.array([(DEALS << 48) + (band << 32)], dtype=np.uint64))))
        return np.concatenate(out).view(np.int64)


def _word_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    offsets, data = byte_view(column)
    for lo, hi in slices(offsets, _CHUNK):
        s, e = word_spans(data, offsets[lo : hi + 1], IS_WORD)
        h = word_hashes(data, s, e)
        cut = np.searchsorted(s, offsets[lo : hi + 1])
        for i in range(hi - lo):
            yield h[cut[i] : cut[i + 1]]


def signed(docs: DataFrame, n: int, t: tuple[int, int], rest: bool = False) -> DataFrame:
    """Written table: nid (a number of the row), the row's doc_id and text, n_shingles, key, needs; with
    ``rest`` a struct of the row's other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if rest else []
    kept = [F.struct(*others).alias("rest")] if others else []
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Segments(t)
        for b in batches:
            sizes, keys, least = [], [], []
            for words in _word_lists(b.column(1)):
                s = shingle_set(words, n)
                sizes.append(len(s))
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                least.append(plan.needs(s) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(least, pa.int32()), *b.columns[2:]], names=["doc_id", "text", "n_shingles", "key", "needs"] + b.schema.names[2:])

    source = docs.select("doc_id", "text", *kept)
    schema = f"doc_id {key_type}, text string, n_shingles bigint, key binary, needs int" + "".join(f", rest {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    rows = source.mapInArrow(run, schema)
    return table(rows.select(F.monotonically_increasing_id().alias("nid"), "*"), "signed", compression="zstd")


def signatures(texts: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """sig and nid of every signature of the rows (nid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Segments(t)
        for b in batches:
            nid = b.column(0).to_numpy()
            sigs, who, size = [], [], 0
            for i, words in enumerate(_word_lists(b.column(1))):
                s = shingle_set(words, n)
                if len(s):
                    sigs.append(plan.sign(s))
                    who.append(np.full(len(sigs[-1]), nid[i]))
                    size += len(sigs[-1])
                if size > _CHUNK // 8 or (size and i == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(who))], names=["sig", "nid"])
                    sigs, who, size = [], [], 0

    return texts.select("nid", "text").mapInArrow(run, "sig bigint, nid bigint")


def _blocks(sigs: DataFrame) -> DataFrame:
    """sig, nid and pivot (least nid) of the members of each block of two or more.

    Rows are dealt by range of (sig, nid), so that a block of any size is spread; a part of a block has a
    pivot of its own, and the rows at the ends of a task's range tie the parts together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sig: np.ndarray, nid: np.ndarray, pivot: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(nid), pa.array(pivot), pa.array(end)], names=["sig", "nid", "pivot", "end"])

        last = None  # sig, its pivot and whether the pivot has been given out
        first = None
        for b in batches:
            sig, nid = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(sig):
                continue
            new = np.ones(len(sig), dtype=bool)
            new[1:] = sig[1:] != sig[:-1]
            if last is not None and sig[0] == last[0]:
                new[0] = False
            start = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            pivot = np.where(start < 0, last[1] if last is not None else 0, nid[np.maximum(start, 0)])
            if first is None:
                first = (sig[0], pivot[0])
            many = ~new
            more = many.copy()
            more[:-1] |= many[1:] & (sig[:-1] == sig[1:])
            if last is not None and not last[2] and many[0]:
                yield out(np.array([last[0]]), np.array([last[1]]), np.array([last[1]]), np.array([False]))
            if more.any():
                yield out(sig[more], nid[more], pivot[more], np.zeros(int(more.sum()), dtype=bool))
            last = (sig[-1], pivot[-1], bool(more[-1]))
        if first is not None:
            yield out(np.array([first[0], last[0]]), np.array([first[1], last[1]]), np.array([first[1], last[1]]), np.array([True, True]))

    found = table(sigs.repartitionByRange("sig", "nid").sortWithinPartitions("sig", "nid").mapInArrow(run, "sig bigint, nid bigint, pivot bigint, end boolean"), "blocks")
    ends = found.where("end").groupBy("sig").agg(F.min("pivot").alias("least"), F.collect_set("pivot").alias("parts")).where(F.size("parts") > 1)
    tied = ends.select("sig", F.explode("parts").alias("nid"), F.col("least").alias("pivot"))
    return found.where("not end").select("sig", "nid", "pivot").unionByName(tied)


def overlaps(query: np.ndarray, s: np.ndarray) -> int:
    at = np.searchsorted(s, query)
    at[at == len(s)] = 0
    return int((s[at] == query).sum()) if len(s) else 0


def divide_skip(sets: list[np.ndarray], root: np.ndarray, t: tuple[int, int], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the sets of a block that join different components (``root``); with ``side`` only
    links between different sides are looked for. Every set is a query against those before it."""
    parent = {int(r): int(r) for r in root}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    root = [int(root[i]) for i in order]
    side = None if side is None else side[order]
    token, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([0] + [len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), np.diff(cuts))
    by_token = np.argsort(flat, kind="stable")
    lists, begin = owner[by_token], np.searchsorted(flat[by_token], np.arange(len(token) + 1))
    links = []
    for q in range(1, len(sets)):
        mine = flat[cuts[q] : cuts[q + 1]]
        lo, hi = begin[mine], begin[mine + 1]
        # documents before q in each list: lists are sorted, and q stands where the earlier ones end
        size = np.array([np.searchsorted(lists[x:y], q) for x, y in zip(lo, hi, strict=True)]) if len(mine) < 64 else _earlier(lists, lo, hi, q)
        t_least = needed(len(mine), -(-len(mine) * t[0] // t[1]), t)
        longest = int(size.max(initial=0))
        if not longest:
            continue
        skip = min(t_least - 1, int(t_least / (0.01 * math.log2(longest + 1) + 1)))
        by_size = np.argsort(size, kind="stable")
        short, long_ = by_size[: len(mine) - skip], by_size[len(mine) - skip :]
        total = int(size[short].sum())
        if not total:
            continue
        at = np.repeat(lo[short] - np.concatenate(([0], np.cumsum(size[short])[:-1])), size[short]) + np.arange(total)
        hits = np.bincount(lists[at], minlength=q)
        for c in np.flatnonzero(hits >= max(1, t_least - skip)):
            if (side is not None and side[c] == side[q]) or find(root[c]) == find(root[q]):
                continue
            least = needed(len(mine), len(sets[c]), t)
            if int(hits[c]) + len(long_) < least:
                continue
            if int(hits[c]) + overlaps(token[mine[long_]], sets[c]) >= least:
                links.append((order[c], order[q]))
                parent[find(root[c])] = find(root[q])
    return links


def _earlier(lists: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: int) -> np.ndarray:
    """For each list the number of its members under ``q``, all lists bisected at once."""
    a, b = lo.copy(), hi.copy()
    while (a < b).any():
        mid = (a + b) // 2
        low = (a < b) & (lists[np.minimum(mid, len(lists) - 1)] < q)
        b = np.where((a < b) & ~low, mid, b)
        a = np.where(low, mid + 1, a)
    return a - lo


def _search(rows: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """Links (a, b) found in blocks: rows (block, nid, root, side, star, text). A star is searched from its
    pivot alone (side 0, which comes first), so its members pass by one at a time."""

    def links(part: list[tuple]) -> list[tuple[int, int]]:
        side = np.array([r[2] for r in part])
        found = divide_skip([r[3] for r in part], np.array([r[1] for r in part]), t, None if (side == side[0]).all() else side)
        return [(part[i][0], part[j][0]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part = None, []
        for b in batches:
            got = []
            cols = [b.column(k).to_pylist() for k in range(5)]
            for i, words in enumerate(_word_lists(b.column(5))):
                if cols[0][i] != block:
                    if len(part) > 1:
                        got += links(part)
                    block, part = cols[0][i], []
                s = shingle_set(words, n)
                if cols[4][i] and part:
                    if overlaps(part[0][3], s) >= needed(len(s), len(part[0][3]), t):
                        got.append((part[0][0], cols[1][i]))
                else:
                    part.append((cols[1][i], cols[2][i], cols[3][i], s))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if len(part) > 1:
            got = links(part)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block", "side", "nid").select("block", "nid", "root", "side", "star", "text").mapInArrow(run, "a bigint, b bigint")


def _with_texts(rows: DataFrame, signs: DataFrame) -> DataFrame:
    wanted = table(rows.select("nid").distinct(), "wanted")
    texts = signs.select("nid", "text").join(small_side(wanted), "nid", "left_semi")
    return rows.join(texts, "nid")


def _roots(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, members["nid"] == comps["node"], "left").select("sig", "nid", F.coalesce("root", "nid").alias("root"))


def link_classes(signs: DataFrame, n: int, t: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the representatives of classes; as many as join every component."""
    classes = table(signs.where("n_shingles > 0").groupBy("key").agg(F.min("nid").alias("rep"), F.count("*").alias("size")).where("size > 1"), "classes")
    copies = table(keyed_join(signs.where("n_shingles > 0").select("nid", "key"), classes, "key").where("nid != rep").select("nid"), "copies")
    reps = signs.where("n_shingles > 0").join(small_side(copies), "nid", "left_anti")
    members = _blocks(signatures(reps, n, t)).select("sig", "nid")
    enough = members.groupBy("nid").count().join(signs.select("nid", "needs"), "nid").where("count >= needs").select("nid")
    members = members.join(small_side(table(enough, "enough")), "nid", "left_semi")
    members = table(members, "signed")
    pivots = table(members.groupBy("sig").agg(F.min("nid").alias("pivot"), F.max("nid").alias("top"), F.count("*").alias("size")).where("pivot < top").drop("top"), "pivots")
    members = table(keyed_join(members, pivots, "sig").distinct(), "members")

    # one pivot per set: that of most of its blocks
    shared = members.where("nid != pivot").groupBy("nid", "pivot").count()
    star = shared.groupBy("nid").agg(F.max(F.struct("count", F.negative("pivot").alias("p"))).alias("m")).select("nid", F.negative("m.p").alias("pivot"))
    star = table(star, "stars")
    parts = table(star.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("parts"), F.count("*").alias("size")), "parts")
    spread = F.pmod(F.xxhash64("nid"), F.col("parts"))
    spokes = keyed_join(star, parts, "pivot").select(F.xxhash64("pivot", spread).alias("block"), "nid", F.col("nid").alias("root"), F.lit(1).alias("side"), F.lit(True).alias("star"))
    hubs = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.xxhash64("pivot", "part").alias("block"), F.col("pivot").alias("nid"), F.col("pivot").alias("root"), F.lit(0).alias("side"), F.lit(True).alias("star"))
    first = table(_search(_with_texts(table(spokes.unionByName(hubs), "spokes"), signs), n, t), "links")
    comps = components(first)

    # blocks that still hold several components; those with the same least member are searched as one
    rooted = table(_roots(members.select("sig", "nid"), comps), "rooted")
    mixed = table(rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("nid").alias("pivot"), F.count("*").alias("size")).where("lo != hi").drop("lo", "hi"), "mixed")
    rest = table(keyed_join(rooted, mixed, "sig").select("pivot", "nid", "root").distinct(), "rest")
    sizes = table(rest.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("parts"), F.count("*").alias("size")), "sizes")
    dealt = keyed_join(rest, sizes, "pivot").withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lists = dealt.select(F.xxhash64("pivot", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "nid", "root", (F.col("part") > F.col("other")).cast("int").alias("side"), F.lit(False).alias("star"))
    second = _search(_with_texts(table(lists, "mixed"), signs), n, t)
    return table(first.unionByName(second), "links")


def _classes(rows: DataFrame, comps: DataFrame, first: Column) -> DataFrame:
    """Written table key, first (the least of the component), size of every class of equal sets."""
    classes = table(rows.groupBy("key").agg(F.min("nid").alias("rep"), F.min(first).alias("low"), F.count("*").alias("size")), "classes")
    rooted = table(classes.join(comps, classes["rep"] == comps["node"], "left").select("key", F.coalesce("root", "rep").alias("root"), "low", "size"), "rooted")
    least = table(rooted.groupBy("root").agg(F.min("low").alias("first"), F.count("*").alias("classes")), "least")
    return table(keyed_join(rooted.select("key", "root", "size"), least, "root", "classes").select("key", "first", "size"), "named")


def jaccard_components(docs: DataFrame, n: int = NGRAM, t: tuple[int, int] = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and n_row (a number of the row) of every document."""
    signs = signed(docs, n, t)
    comps = components(link_classes(signs, n, t, block))
    rows = signs.select("nid", "doc_id", "n_shingles", "key")
    named = _classes(rows.where("n_shingles > 0"), comps, F.col("doc_id"))
    full = keyed_join(rows.where("n_shingles > 0"), named, "key").select("doc_id", "n_shingles", F.col("first").alias("component_id"), F.col("nid").alias("n_row"))
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("nid").alias("n_row")))


def keep_one(docs: DataFrame, n: int = 5, t: tuple[int, int] = (80, 100), block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, without those linked to an earlier one: of each component the row
    with the least doc_id stays (of rows with equal ids one of them); empty sets all stay."""
    signs = signed(docs, n, t, rest=True)
    comps = components(link_classes(signs, n, t, block))
    rows = signs.where("n_shingles > 0").select("nid", "key", "doc_id")
    named = _classes(rows, comps, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "nid"))
    dropped = table(keyed_join(rows.select("nid", "key"), named, "key").where("nid != first.nid").select("nid"), "dropped")
    kept = signs.join(small_side(dropped), "nid", "left_anti")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])


def jaccard_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return jaccard_components(docs).drop("n_row")
