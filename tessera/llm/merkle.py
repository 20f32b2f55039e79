"""Operator 13: a Merkle manifest of a dataset, built and proved level by level.

A row's leaf is the SHA-256 of its fields, each with its length. The leaves of a source are numbered in ascending
order of their ids; ``FANOUT`` consecutive nodes become the hash of their digests, until one node, the subroot,
is left; the subroots of all sources, in order, become the root in the same way. Each level is one aggregation
keyed by (source, position // FANOUT), so a source of any size is spread over all tasks, and is written
to the shared folder. Proofs go down again: a join a level hands each run of siblings the path above it, and
only the last step, which is not shuffled, makes a row a document of it.

Defined results: null and empty fields differ (``-`` and ``0:``), null and empty sources are two sources, null ids
come first; rows of one id stand in the order of their leaves, equal rows keep one place each; an empty table
has no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed_join, remainder, table
from tessera.operators.joins import group_positions, positions

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<run:array<string>,at:int>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha256(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts' UTF-8 bytes in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def source_key(source: Column) -> Column:
    """A text that orders sources by their bytes, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))


def leaves(docs: DataFrame, altered: Column | None = None, suspect: Column | None = None) -> DataFrame:
    """doc_id, g (the source's key), leaf, and ``altered``: the leaf with the text ``altered`` where ``suspect``
    holds, else null."""
    leaf = lambda text: sha256(*[field(text if f == "text" else F.col(f)) for f in FIELDS])
    other = F.when(suspect, leaf(altered)) if altered is not None else F.lit(None).cast("string")
    return docs.select("doc_id", source_key(F.col("source")).alias("g"), leaf(F.col("text")).alias("leaf"), other.alias("altered"))


def _runs(nodes: DataFrame, group: list[str], keep: list[Column]) -> DataFrame:
    """Each ``FANOUT`` consecutive nodes (position ``at``) of a group: their place ``pos``, and ``run``."""
    return nodes.groupBy(*group, F.expr(f"at div {FANOUT}").alias("pos")).agg(F.sort_array(F.collect_list(F.struct("at", *keep))).alias("run"))


def _hashed(level: DataFrame) -> DataFrame:
    """A run's hash; a group of one node keeps that node."""
    joined = sha256(F.array_join("run.hash", ""))
    return level.withColumn("hash", F.when(F.col("n") == 1, F.col("run")[0]["hash"]).otherwise(joined))


def _levels(first: DataFrame, group: list[str], most: int, name: str) -> list[DataFrame]:
    """The written levels above ``first``; groups of ``n`` leaves end where one node is left of them."""
    out, k = [first], 1
    while FANOUT**k < most:
        nodes = out[-1].where(F.col("n") > FANOUT**k).select(*group, F.col("pos").alias("at"), "hash", "n")
        runs = _runs(nodes, [*group, "n"], [F.col("hash")])
        out.append(table(_hashed(runs), name))
        k += 1
    return out


def _tops(level: DataFrame, k: int) -> DataFrame:
    """The rows of level ``k`` (from 1) that are the one node left of their group."""
    return level.where((F.col("n") <= FANOUT**k) & ((F.col("n") > FANOUT ** (k - 1)) | F.lit(k == 1)))


def _down(rows: DataFrame, carried: list[str]) -> DataFrame:
    """The nodes of each run with their own path: the run and their place in it, then the run's path."""
    step = f"named_struct('run', run.hash, 'at', i)"
    own = F.expr(f"IF(n = 1, path, concat(array({step}), path))")
    return rows.selectExpr("*", "posexplode(run) AS (i, node)").select(*carried, "node", own.alias("path"))


def manifest(marked: DataFrame) -> DataFrame:
    """The proof of every leaf of ``marked`` (as ``leaves`` gives them): doc_id, leaf, altered, subroot, root and
    ``path``, the runs from the leaf's own up to the root with the place in each.

    The leaves are written and numbered when the frame is made; proofs are lazy.
    """
    placed = group_positions(table(marked, "leaves"), ["g"], ["doc_id", "leaf"], "at")
    runs = table(_runs(placed, ["g"], [F.col("leaf").alias("hash"), "doc_id", "altered"]), "runs")
    sizes = table(runs.groupBy("g").agg(F.sum(F.size("run")).alias("n"), F.count("*").alias("size")), "sizes")
    most = sizes.agg(F.max("n")).first()[0]  # one number
    if most is None:
        return marked.select("doc_id", "leaf", "altered", F.lit("").alias("subroot"), F.lit("").alias("root"), F.from_json(F.lit("[]"), _PATH).alias("path")).where("false")
    levels = _levels(table(_hashed(keyed_join(runs, sizes, "g")), "level"), ["g"], most, "level")

    subroots = None
    for k, level in enumerate(levels, 1):
        found = _tops(level, k).select("g", "hash")
        subroots = found if subroots is None else subroots.unionByName(found)
    upper = positions(subroots, ["g"], "at")
    total = upper.count()
    first = table(_hashed(_runs(upper, [], [F.col("hash"), "g"]).withColumn("n", F.lit(total).cast("bigint"))), "upper")
    above = _levels(first, [], total, "upper")

    empty = F.from_json(F.lit("[]"), _PATH)
    paths = above[-1].select("pos", F.col("hash").alias("root"), empty.alias("path"))
    for level in above[:0:-1]:
        below = _down(level.join(paths, "pos"), ["root"])
        paths = below.select(F.col("node.at").alias("pos"), "root", "path")
    tops = _down(above[0].join(paths, "pos"), ["root"]).select(F.col("node.g").alias("g"), F.col("node.hash").alias("subroot"), "root", "path")

    known = None
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        here = _tops(level, k).join(tops, "g")
        if known is not None:
            here = here.unionByName(level.join(known, ["g", "pos"]))
        below = _down(here, ["g", "subroot", "root"])
        known = below.select("g", F.col("node.at").alias("pos"), "subroot", "root", "path") if k > 1 else below
    return known.select("node.doc_id", F.col("node.hash").alias("leaf"), "node.altered", "subroot", "root", "path")


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(
        path, start,
        lambda acc, s: sha256(F.array_join(F.slice(s["run"], 1, s["at"]), ""), acc, F.array_join(F.slice(s["run"], s["at"] + 2, FANOUT), "")),
    )


def siblings(path: str = "path") -> Column:
    """The digests that a proof needs besides the leaf: level by level up to the root, left to right."""
    return F.expr(f"transform({path}, s -> array_join(filter(s.run, (x, i) -> i <> s.at), ''))")


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Documents whose id's CRC-32 5 divides are
    tampered with (letters A-Z of the text lower-cased) before their leaf is folded."""
    marked = leaves(docs, F.translate("text", _UPPER, _LOWER), remainder("doc_id", 5) == 0)
    out = manifest(marked).select(
        "doc_id", "leaf", "subroot", "root",
        sha256(F.array_join(siblings(), "")).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
