"""Deterministic sampling, sharding and batching (SMP-01 to SMP-25). Order is by SHA-1 of seed and key,
which any engine can repeat; a shuffled order is the same in every run and on any number of machines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.joins import group_positions, positions, settled
from tessera.operators.scans import scan

NEAR_UNITS = 64


def order_key(seed: int | str, *keys: Column) -> Column:
    """HSH-04: the stable order of rows for a seed."""
    return F.sha1(F.concat_ws("/", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def hash_remainder(seed: int | str, n: int | Column, *keys: Column) -> Column:
    """SMP-14: the first eight hexadecimal digits of the order key, modulo ``n``."""
    return (F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("bigint") % n).cast("bigint")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``pos``: the row's place in the seed's permutation."""
    return positions(df.withColumn("_k", order_key(seed, F.col(key))), ["_k", key]).drop("_k")


def batches(df: DataFrame, key: str, batch: int, groups: int, seed: int, total: int, drop_last: bool = True) -> DataFrame:
    """SMP-01: permutation, then strided shards, then batches; the rest is dropped or filled from the front."""
    step = batch * groups
    whole = total // step * step if drop_last else -(-total // step) * step
    rows = shuffled(df, key, seed)
    if whole > total:  # rows of the front come again at the end, as often as it takes
        times = F.floor((F.lit(whole - 1) - F.col("pos")) / total)
        rows = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), times))).withColumn("pos", F.col("pos") + F.col("_r") * total).drop("_r")
    rows = rows.where(F.col("pos") < whole)
    return rows.withColumn("shard", F.col("pos") % groups).withColumn("batch", F.floor(F.floor(F.col("pos") / groups) / batch))


def contiguous(pos: Column, total: int, workers: int) -> Column:
    """SMP-05: ranges of ceil(total / workers) positions."""
    return F.floor(pos / F.lit(-(-total // workers)))


def spread_indices(total: int, n: int, rule: str = "round") -> list[int]:
    """SMP-10 to SMP-12, SMP-24: ``n`` places evenly over ``total`` (round half to even, floor, middle or ends)."""
    if n >= total:
        return list(range(total))
    if rule == "round":
        got = sorted({min(round(i * total / n), total - 1) for i in range(n)})
    elif rule == "floor":
        got = sorted({int(i * (total / n)) for i in range(n)})
    elif rule == "middle":
        got = sorted({int((i + 0.5) * total / n) for i in range(n)})
    else:
        got = sorted({int(i * (total - 1) / max(1, n - 1)) for i in range(n)})
    free = (i for i in range(total) if i not in set(got))
    return sorted(got + [next(free) for _ in range(n - len(got))])


ACCURACY = 10_000


def take_positions(df: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    """SMP-10 to SMP-12, SMP-16: rows at the given places (``pos``) of an order, without sorting the table.

    The first order column is numeric. A mergeable sketch gives values a little below and above each place; one pass
    counts what lies below and between them exactly; only rows between them are placed. If a sketch should have missed
    (the counts say so), or the column is not numeric, the whole table is numbered. Runs jobs; rows stay in Spark.
    """
    places = sorted(set(places))
    key = F.col(order[0])
    if not isinstance(df.schema[order[0]].dataType, T.NumericType):
        return positions(df, order).where(F.col("pos").isin(places))
    n, nulls = df.agg(F.count("*"), F.count_if(key.isNull())).first()  # two numbers
    places = [p for p in places if 0 <= p < n]
    late = [p for p in places if p >= nulls]
    spans = []
    if late:
        share = lambda p, side: min(1.0, max(0.0, (p - nulls + side) / (n - nulls) + side * 2 / ACCURACY))
        edges = df.agg(F.percentile_approx(key, [share(p, side) for p in late for side in (-1, 1)], ACCURACY)).first()[0]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
    within = [key.between(F.lit(lo), F.lit(hi)) for lo, hi in spans]
    counts = df.agg(F.lit(0), *[F.count_if(c) for lo, hi in spans for c in (key < F.lit(lo), key.between(F.lit(lo), F.lit(hi)))]).first()
    held = [(0, nulls, key.isNull())] * (len(late) < len(places))
    held += [(nulls + counts[1 + 2 * i], counts[2 + 2 * i], w) for i, w in enumerate(within)]
    if not all(any(below <= p < below + size for below, size, _ in held) for p in places):
        return positions(df, order).where(F.col("pos").isin(places))
    span = F.lit(None).cast("bigint")
    for below, _, is_ in reversed(held):
        span = F.when(is_, F.lit(below).cast("bigint")).otherwise(span)
    near = df.withColumn("_below", span).where(F.col("_below").isNotNull())
    return group_positions(near, ["_below"], order).withColumn("pos", F.col("pos") + F.col("_below")).drop("_below").where(F.col("pos").isin(places))


def stride_indices(total: int, n: int) -> list[int]:
    """SMP-16: every (total // n)-th place from the first, ``n`` at most."""
    return list(range(0, total, max(1, total // n)))[:n]


def round_robin(df: DataFrame, group: str, key: str, seed: int, n: int) -> DataFrame:
    """SMP-13: one row of each group in turn, in hash order within a group, ``n`` rows in all. Each task keeps the
    first ``n`` rows of a group (a limited rank), then ``n`` rows of all."""
    w = Window.partitionBy(group).orderBy(order_key(seed, F.col(key)), key)
    ranked = df.withColumn("depth", F.row_number().over(w)).where(F.col("depth") <= n)
    return ranked.orderBy("depth", group).limit(n)


def repeat_rows(df: DataFrame, k: int, name: str = "copy") -> DataFrame:
    """SMP-09, ARR-12: every row ``k`` times with its number."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def dealt(fill: list[int], step: int, count: int) -> list[int]:
    """How many of ``count`` equal pieces of size ``step`` each shard gets, each piece going to the least filled
    shard (of equals the first): the pieces fill all shards up to one level, found by bisection."""
    if step <= 0:
        return [count if s == fill.index(min(fill)) else 0 for s in range(len(fill))]
    below = lambda level: [max(0, -(-(level - f) // step)) for f in fill]
    lo, hi = min(fill), max(fill) + step * (count + 1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if sum(below(mid)) <= count else (lo, mid)
    got, rest = below(lo), count - sum(below(lo))
    for s, f in enumerate(fill):
        if rest and lo >= f and (lo - f) % step == 0:
            got[s], rest = got[s] + 1, rest - 1
    return got


def _slots(spark: SparkSession, deals: list[tuple[int, int, int, int]]) -> DataFrame:
    """For (step, shard, fill, pieces): step, shard and pos of each piece, in the order in which pieces of one
    step are dealt."""
    plan = spark.createDataFrame([d for d in deals if d[3]], "step bigint, shard int, fill bigint, pieces bigint")
    rows = plan.select("step", "shard", "fill", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"))
    rows = rows.select("step", "shard", (F.col("fill") + F.col("i") * F.col("step")).alias("level"))
    return group_positions(rows, ["step"], ["level", "shard"]).drop("level")


def pack_longest_first(files: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """SMP-02: files to shards, the largest first, each to the least filled shard (of equals the first).

    Files of one size are dealt alike, so the walk is over the distinct sizes (they and their numbers of files
    reach the driver, not the files) and ``dealt`` says how many each shard gets; a file then finds its shard by
    its place among those of its size.
    """
    fill, deals = [0] * shards, []
    for step, count in files.groupBy(F.col(size).cast("bigint")).count().orderBy(F.desc(size)).toLocalIterator():
        got = dealt(fill, step, count)
        deals += [(step, s, fill[s], n) for s, n in enumerate(got)]
        fill = [f + n * step for f, n in zip(fill, got, strict=True)]
    at = group_positions(files.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("step")), ["step"], ["key"])
    return at.join(_slots(files.sparkSession, deals), ["step", "pos"]).select("key", F.col("shard").cast("bigint").alias("shard"), F.col("step").alias("size"))


def packing_plan(files: DataFrame, key: str, size: str, shards: int, seed: int, at: str) -> DataFrame:
    """SMP-02: the packed files (key, shard, size) with their ``place`` in the shard's own seeded order; the plan is
    kept below ``at`` under a digest of files, shards and seed, and read from there when it is asked for again."""
    spark = files.sparkSession
    rows, digest = files.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(F.col(key), F.col(size).cast("bigint")).cast("decimal(38,0)")), F.lit(0))).first()
    path = f"{at.rstrip('/')}/plan-{rows}-{digest}-{shards}-{seed}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        packed = pack_longest_first(files, key, size, shards).withColumn("_k", order_key(seed, F.col("shard"), F.col("key")))
        group_positions(packed, ["shard"], ["_k", "key"], "place").drop("_k").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def k_repeat(df: DataFrame, key: str, batch: int, k: int, world: int, rank: int, seed: int) -> DataFrame:
    """SMP-09: ``world`` * ``batch`` / ``k`` rows by the seed's order, each ``k`` times (``copy``), shuffled, and the
    ``batch`` of them that are ``rank``'s, with their place ``pos`` among all. As many rows as a step takes."""
    if batch * world % k:
        raise ValueError(f"world * batch must be a multiple of k ({world} * {batch}, {k})")
    unique = batch * world // k
    top = df.orderBy(order_key(seed, F.col(key)), key).limit(unique)
    if (there := top.count()) < unique:
        raise ValueError(f"{unique} rows are needed, {there} are there")
    copies = repeat_rows(top, k).withColumn("_k", order_key(seed + 1, F.col(key), F.col("copy")))
    placed = positions(copies, ["_k", key, "copy"]).drop("_k")
    return placed.where((F.col("pos") >= rank * batch) & (F.col("pos") < (rank + 1) * batch))


def quota_cells(rows: DataFrame, cell: str, unit: str, order: str, quota: int, strict: bool = False) -> DataFrame:
    """SMP-15: up to ``quota`` units for each cell, no unit in two cells; cells in order, units in order. ``strict``
    is an error when a cell gets fewer.

    The walk, in which each cell takes its first free units before the next one chooses, gives the stable outcome
    for units that all prefer the earlier cell, and there is only one. So all cells propose at once: each to its first
    units that no earlier cell holds; a unit keeps the first cell that asks and is lost to all later ones, asked or
    not; until no unit is asked twice. A round ranks a cell's first ``near`` units alone, whatever the table's size; in
    which order cells propose does not matter, so those that use theirs up go on later with four times as many. Rows without a
    unit have no part.
    """
    pairs = rows.where(F.col(unit).isNotNull()).select(F.struct(F.col(cell).alias("cell")).alias("c"), F.col(unit).alias("unit"), F.struct(order, unit).alias("o")).groupBy("c", "unit").agg(F.min("o").alias("o"))
    pairs, asked = settled(pairs), None
    w = Window.partitionBy("c").orderBy("o")

    def first(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")

    near = max(NEAR_UNITS, 8 * quota)
    while True:
        some = settled(first(pairs, near))
        while True:
            free = some
            if asked is not None:
                held = asked.groupBy("unit").agg(F.min("c").alias("_h"))  # a cell asks on for what it holds
                free = some.join(held, "unit", "left").where("_h is null or c <= _h").drop("_h")
            asked = settled(first(free, quota).select("c", "unit"))
            if asked.groupBy("unit").count().where("count > 1").isEmpty():
                break
        full = some.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") == near)
        if full.join(asked.groupBy("c").count(), "c", "left").where(F.coalesce("count", F.lit(0)) < quota).isEmpty():
            break
        near *= 4
    if strict:
        short = pairs.select("c").distinct().join(asked.groupBy("c").count(), "c", "left").where(F.coalesce("count", F.lit(0)) < quota).first()
        if short:
            raise ValueError(f"cell {short.c.cell!r} has only {short['count'] or 0} free units")
    return asked.select(F.col("c.cell").alias("cell"), "unit")


def _walk(labels: list[int], first: int, used: list[int]) -> list[int]:
    """The variant of each row; a label below 0 is none. ``used`` is counted on; ties go by the row's place."""
    n, out = len(used), []
    for i, own in enumerate(labels, first):
        if own < 0:
            own = min(((used[(i + j) % n], j) for j in range(n)))[1]
            own = (i + own) % n
        used[own] += 1
        out.append(own)
    return out


def least_used(rows: DataFrame, key: str, label: str, variants: list[str], blocks: int | None = None, subset: bool = False) -> DataFrame:
    """SMP-25: a stated label wins; each other row, in order of ``key``, takes the variant used least by the rows
    before it; of equals the first in a rotation that begins at the row's place. A variant that no row uses is an
    error; with ``subset`` not if all rows are labelled.

    The walk runs over ranges of rows side by side. A range needs the counts it starts with, less their least; they
    are taken to be level, then what the range before ended with, and ranges whose start turned out otherwise
    walk again. Unlabelled rows level the counts, so a range's end soon depends on its own rows only; at worst
    there are as many rounds as ranges. The driver holds a few numbers a range.
    """
    spark, v = rows.sparkSession, len(variants)
    own = F.coalesce(F.array_position(F.array(*map(F.lit, variants)), F.col(label)).cast("int"), F.lit(0)) - 1
    placed = scan(rows.select(F.col(key).alias("key"), own.alias("own")), [], ["key"], blocks).add(pos=("sum", F.lit(1)))
    dealt = settled(placed.dealt)
    kind = dealt.schema["key"].dataType.simpleString()
    parts = sorted(r._p for r in dealt.select("_p").distinct().collect())  # a number a range
    starts: dict[int, tuple[int, ...]] = {}
    ends: dict[int, tuple[int, ...]] = {}
    level = tuple([0] * v)
    wanted = dict.fromkeys(parts, level)

    def run(todo: dict[int, tuple[int, ...]], write: bool) -> DataFrame:
        names = variants

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, used = pdf.sort_values("pos"), list(todo[int(pdf["_p"].iloc[0])])
            got = _walk(pdf["own"].tolist(), int(pdf["pos"].iloc[0]) - 1, used)
            if write:
                return pd.DataFrame({"key": pdf["key"], "variant": [names[i] for i in got]})
            return pd.DataFrame({"_p": pdf["_p"].iloc[:1], "used": [[u - min(used) for u in used]]})

        chosen = dealt.where(F.col("_p").isin(list(todo)))
        return chosen.groupBy("_p").applyInPandas(walk, f"key {kind}, variant string" if write else "_p int, used array<int>")

    while todo := {p: s for p, s in wanted.items() if starts.get(p) != s}:
        ends |= {r._p: tuple(r.used) for r in run(todo, False).collect()}  # a few numbers a range
        starts |= todo
        wanted = {p: ends[q] if q is not None else level for q, p in zip([None, *parts], parts)}
    out = settled(run(starts, True)) if parts else spark.createDataFrame([], f"key {kind}, variant string")
    free = not subset or dealt.where("own < 0").limit(1).count()
    if free and (missing := set(variants) - {r.variant for r in out.select("variant").distinct().collect()}):
        raise ValueError(f"no row uses {', '.join(x for x in variants if x in missing)}")
    return out


def rotated_variant(variants: list[str], turn: Column, feasible: Column) -> Column:
    """SMP-14: the first variant from ``turn`` on, around, that is in the array ``feasible``; null if none is."""
    n = len(variants)
    around = F.array(*[F.element_at(F.array(*map(F.lit, variants)), (F.pmod(turn + i, F.lit(n)) + 1).cast("int")) for i in range(n)])
    return F.get(F.filter(around, lambda x: F.array_contains(feasible, x)), F.lit(0))


def equal_shards(df: DataFrame, key: str, shards: int, batch: int, seed: int, total: int) -> DataFrame:
    """SMP-03: strided shards of the seed's permutation, all cut to the least one's whole batches."""
    most = total // shards // batch * batch
    at = shuffled(df, key, seed).withColumn("shard", F.col("pos") % shards).withColumn("place", F.floor(F.col("pos") / shards))
    return at.where(F.col("place") < most).drop("pos")


def one_shard(df: DataFrame, order: list[str], shards: int, index: int, total: int) -> DataFrame:
    """SMP-07: the rows of one contiguous shard."""
    return positions(df, order).where(contiguous(F.col("pos"), total, shards) == index).drop("pos")


def epochs(df: DataFrame, key: str, seed: int, numbers: range) -> DataFrame:
    """SMP-21: the rows of each epoch in its own order (``pos``); epoch n is the permutation of seed + n, so a
    reader can go on at any epoch."""
    rows = df.withColumn("epoch", F.explode(F.array(*map(F.lit, numbers))))
    keyed = rows.withColumn("_k", F.sha1(F.concat_ws("/", (F.lit(seed) + F.col("epoch")).cast("string"), F.col(key).cast("string")).cast("binary")))
    return group_positions(keyed, ["epoch"], ["_k", key]).drop("_k")
