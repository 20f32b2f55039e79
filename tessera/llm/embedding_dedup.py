"""Operator 4: near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are made unit length and turned into the principal axes of all vectors (the scatter matrix is
summed over every row), so that the leading coordinates hold most of a product. Linked vectors lie within
sqrt(2 - 2t) of each other along any axis, so rows are dealt by label and by cells of that width along
the first axis; a cell meets itself and the next one only. Cells of over ``TILE`` rows are cut, and each
pair of parts is a tile of its own. In a tile the leading dimensions are multiplied first; what the rest
can add is at most the product of the suffix norms (Cauchy-Schwarz), and pairs that cannot reach the
threshold stop there. Pairs that remain are decided by the cosine of the vectors as given, in doubles.

Links are counted per vector and tile; only edges that join a tile's components leave it.

Defined results: null, empty and zero vectors, and those with null or non-finite components, link with
nothing, as do vectors whose label is null; vectors of different lengths do not link; equal vectors of a
label are one class that counts as many times as it occurs; rows with a null vec_id link as any other;
a row that repeats another is another vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, keyed_join, small_side, table

THRESHOLD = 0.98
TILE = 4096
LEAD = (8, 16, 32)
_SUB = 512
_PAIRS = 1 << 15
_SLACK = 1e-9


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values (NaN for null), begin and length of each row's vector; null rows have length 0."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return flat, np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if len(size) else size, size


def numbered(vectors: DataFrame) -> DataFrame:
    """Written table: nid, vec_id, label, dims (0: links with nothing), key (of label and vector), v."""
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, begin, size = _rows_of(b.column(2))
            dims, keys, labels = np.zeros(b.num_rows, dtype=np.int32), [], b.column(1).to_pylist()
            for i, (s, n) in enumerate(zip(begin, size, strict=True)):
                v = flat[s : s + n]
                ok = n > 0 and labels[i] is not None and np.isfinite(v).all() and v.any()
                dims[i] = n if ok else 0
                keys.append(hashlib.md5(f"{labels[i]}|".encode() + (v + 0.0).tobytes()).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims), pa.array(keys, pa.binary()), b.column(2)], names=["vec_id", "label", "dims", "key", "v"])

    v_type = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {id_type}, label {label_type}, dims int, key binary, v {v_type}")
    return table(rows.select(F.monotonically_increasing_id().alias("nid"), "*"), "vectors")


def _units(flat: np.ndarray, begin: np.ndarray, d: int) -> np.ndarray:
    m = flat[begin[:, None] + np.arange(d)] if len(begin) else np.zeros((0, d))
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares stay finite
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The most frequent number of dimensions and the axes (columns, by falling variance) of its vectors."""
    common = rows.where("dims > 0").groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return 0, np.zeros((0, 0))
    d = common["dims"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            flat, begin, _ = _rows_of(b.column(0))
            u = np.hstack([_units(flat, begin, d), np.ones((b.num_rows, 1))])
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "x"])

    sums = rows.where(F.col("dims") == d).select("v").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    m = np.zeros((d + 1) ** 2)
    m[sums["i"].to_numpy()] = sums["x"].to_numpy()
    m = m.reshape(d + 1, d + 1)
    mean = m[:d, d] / m[d, d]
    values, axes = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
    return d, axes[:, np.argsort(-values, kind="stable")]


def _turn(u: np.ndarray, axes: tuple[int, np.ndarray]) -> np.ndarray:
    return u @ axes[1] if u.shape[1] == axes[0] else u


def _cells(rows: DataFrame, axes, width: float) -> DataFrame:
    """rows with the cell of each vector along the first axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, begin, size = _rows_of(b.column(4))
            cell = np.zeros(b.num_rows, dtype=np.int32)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                u = _units(flat, begin[at], int(d))
                first = u @ axes.value[1][:, 0] if d == axes.value[0] else u[:, 0]
                cell[at] = np.floor(first / width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["nid", "label", "dims", "w", "v", "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("nid", "label", "dims", "w", "v").mapInArrow(run, f"nid bigint, label {kinds['label']}, dims int, w bigint, v {kinds['v']}, cell int")


class _Forest:
    """Least number reached from each of ``n`` numbers by the pairs joined so far."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.low[i], self.low[j]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.low, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.low != self.low[self.low]).any():
                self.low = self.low[self.low]


def tile_links(one: np.ndarray, two: np.ndarray, axes, t: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of ``one`` and ``two`` (unit vectors as given) with cosine of ``t`` or more."""
    a, b = _turn(one, axes), _turn(two, axes)
    d = a.shape[1]
    cuts = [c for c in LEAD if c < d] + [d]
    rest = [(np.sqrt((a[:, c:] ** 2).sum(axis=1)), np.sqrt((b[:, c:] ** 2).sum(axis=1))) for c in cuts]
    for x in range(0, len(a), _SUB):
        for y in range(x if same else 0, len(b), _SUB):
            p = a[x : x + _SUB, : cuts[0]] @ b[y : y + _SUB, : cuts[0]].T
            ra, rb = rest[0]
            i, j = np.nonzero(p + ra[x : x + _SUB, None] * rb[None, y : y + _SUB] >= t - _SLACK)
            if same and x == y:
                i, j = i[i < j], j[i < j]
            p, i, j = p[i, j], i + x, j + y
            for at in range(0, len(i), _PAIRS):
                pi, pj, pp = i[at : at + _PAIRS], j[at : at + _PAIRS], p[at : at + _PAIRS]
                for k in range(1, len(cuts)):
                    lo, hi = cuts[k - 1], cuts[k]
                    pp = pp + np.einsum("ij,ij->i", a[pi, lo:hi], b[pj, lo:hi])
                    on = pp + rest[k][0][pi] * rest[k][1][pj] >= t - _SLACK
                    pi, pj, pp = pi[on], pj[on], pp[on]
                if len(pi):
                    on = np.einsum("ij,ij->i", one[pi], two[pj]) >= t
                    yield pi[on], pj[on]


def _compare(tiles: DataFrame, axes, t: float) -> DataFrame:
    """(a, b, n): b null: a has n links in a tile; else an edge between components of a tile."""

    def solve(part: list[tuple]) -> tuple[list, list, list]:
        side = np.array([p[0] for p in part])
        nid, w = np.array([p[1] for p in part]), np.array([p[2] for p in part])
        units = _units(np.concatenate([p[3] for p in part]), np.arange(len(part)) * len(part[0][3]), len(part[0][3]))
        # side 0 alone meets itself; otherwise side 0 meets side 1
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        count, forest = np.zeros(len(part), dtype=np.int64), _Forest(len(part))
        for i, j in tile_links(units[left], units[right], axes.value, t, same):
            i, j = left[i], right[j]
            count += np.bincount(i, w[j], len(part)).astype(np.int64) + np.bincount(j, w[i], len(part)).astype(np.int64)
            forest.join(i, j)
        has, tied = np.flatnonzero(count), np.flatnonzero(forest.low != np.arange(len(part)))
        return nid[has].tolist() + nid[tied].tolist(), [None] * len(has) + nid[forest.low[tied]].tolist(), count[has].tolist() + [0] * len(tied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, part = None, []
        for b in batches:
            flat, begin, size = _rows_of(b.column(4))
            tiles_, sides, nids, ws = (b.column(k).to_pylist() for k in range(4))
            for i in range(b.num_rows):
                if tiles_[i] != tile:
                    if len(part) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in solve(part)], names=["a", "b", "n"])
                    tile, part = tiles_[i], []
                part.append((sides[i], nids[i], ws[i], flat[begin[i] : begin[i] + size[i]]))
        if len(part) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in solve(part)], names=["a", "b", "n"])

    return tiles.repartition("tile").sortWithinPartitions("tile", "side", "nid").select("tile", "side", "nid", "w", "v").mapInArrow(run, "a bigint, b bigint, n bigint")


def _tiles(cells: DataFrame, tile: int) -> DataFrame:
    """tile, side, nid, w, v: each row in every tile that it is compared in."""
    key = ["label", "dims", "cell"]
    parts = cells.groupBy(*key).agg(F.ceil(F.count("*") / tile).alias("parts"))
    after = parts.select("label", "dims", (F.col("cell") - 1).alias("cell"), F.col("parts").alias("next_parts"))
    rows = cells.join(parts, key).join(after, key, "left").withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    name = lambda kind, cell, p, q: F.concat_ws("/", F.lit(kind), F.col("label").cast("string"), F.col("dims").cast("string"), cell.cast("string"), p.cast("string"), q.cast("string"))
    home = F.transform(upto("parts"), lambda o: F.struct(name("in", F.col("cell"), F.least("part", o), F.greatest("part", o)).alias("tile"), (F.col("part") > o).cast("int").alias("side")))
    out = F.transform(upto("next_parts"), lambda o: F.struct(name("on", F.col("cell"), F.col("part"), o).alias("tile"), F.lit(0).alias("side")))
    # and as the later side of the cell before
    before = parts.select("label", "dims", (F.col("cell") + 1).alias("cell"), F.col("parts").alias("last_parts"))
    rows = rows.join(before, key, "left")
    back = F.transform(upto("last_parts"), lambda o: F.struct(name("on", F.col("cell") - 1, o, F.col("part")).alias("tile"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<tile:string,side:int>>")
    return rows.select(F.explode(F.concat(home, F.coalesce(out, none), F.coalesce(back, none))).alias("m"), "nid", "w", "v").select("m.tile", "m.side", "nid", "w", "v")


def embedding_links(vectors: DataFrame, t: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = numbered(vectors)
    classes = rows.where("dims > 0").groupBy("key").agg(F.min("nid").alias("rep"), F.count("*").alias("w"), F.min("vec_id").alias("low"))
    classes = table(classes, "classes")
    several = classes.where("w > 1")
    copies = table(keyed_join(rows.where("dims > 0").select("nid", "key"), several.select("key", "rep", F.col("w").alias("size")), "key").where("nid != rep").select("nid"), "copies")
    weights = several.select(F.col("rep").alias("nid"), "w")
    axes = vectors.sparkSession.sparkContext.broadcast(principal_axes(rows))
    reps = rows.where("dims > 0").join(small_side(copies), "nid", "left_anti").join(weights, "nid", "left").withColumn("w", F.coalesce("w", F.lit(1)).cast("bigint"))
    cells = _cells(reps, axes, float(np.sqrt(2 - 2 * t)) + 1e-6)
    found = table(_compare(_tiles(cells, tile), axes, t), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = components(found.where("b is not null"))
    rooted = classes.join(comps, classes["rep"] == comps["node"], "left").select("key", "rep", "w", "low", F.coalesce("root", "rep").alias("root"))
    rooted = table(rooted, "rooted")
    least = table(rooted.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("size")), "least")
    named = keyed_join(rooted, least, "root").join(links, "rep", "left")
    named = table(named.select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component", F.col("w").alias("size")), "named")
    # vectors that link with nothing have no key and stay where they are
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component"))
    out = keyed_join(rows.where("key is not null").select("vec_id", "key"), named, "key").select("vec_id", "n_links", "component").unionByName(alone)
    component = F.col("component")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
