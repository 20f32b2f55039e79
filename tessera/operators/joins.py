"""Joins with reports: lookups, reconciliation, positional and pair joins (JOIN-01 to JOIN-20)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, on: list[str], update: str, strict: bool = False) -> DataFrame:
    """JOIN-01: ``update`` from the table where its key matches; strict lookups fail on rows without a match."""
    new = table.select(*on, F.col(update).alias("_new"), F.lit(True).alias("_found"))
    out = df.join(new, on, "left")
    value = F.when(F.col("_found"), F.col("_new")).otherwise(F.col(update))
    if strict:
        value = F.when(F.col("_found").isNull(), F.raise_error(F.lit("no match in the lookup table"))).otherwise(value)
    return out.withColumn(update, value).drop("_new", "_found")


def reconcile(left: DataFrame, right: DataFrame, on: list[str], names: tuple[str, str, str] = ("both", "missing", "extra")) -> DataFrame:
    """JOIN-07, JOIN-02: every key with whether both sides have it, the right lacks it, or only the right has it."""
    a, b = left.select(*on).distinct().withColumn("_a", F.lit(1)), right.select(*on).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_b").isNull(), names[1]).when(F.col("_a").isNull(), names[2]).otherwise(names[0])
    return a.join(b, on, "full_outer").select(*on, status.alias("status"))


def shared_folder(spark) -> str:
    """The session's checkpoint folder. One machine may do without and gets a temporary one; a cluster may not,
    as its executors would not see that."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_OWNED: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if not _OWNED:
        atexit.register(_remove_all)
    _OWNED[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path of ``scratch`` and all below it; the driver does it, file by file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _OWNED.pop(path, None)


def _remove_all() -> None:
    for path, spark in list(_OWNED.items()):
        try:
            remove(spark, path)
        except Exception:  # the session has ended before
            pass
    _OWNED.clear()


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once to the session's shared folder (or to ``path``) and read back, so that what depends on how
    rows were dealt is the same each time it is read. The write is a job that runs when the frame is made."""
    path = path or scratch(df.sparkSession, "settled")
    df.write.option("compression", "lz4_raw").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranges(df: DataFrame, order: list[str], blocks: int | None) -> DataFrame:
    """``df`` dealt by range of ``order``, settled, with the number ``_p`` of each row's range."""
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(blocks, *order).withColumn("_p", F.spark_partition_id()))


def positions(df: DataFrame, order: list[str], name: str = "pos", blocks: int | None = None) -> DataFrame:
    """A dense position from 0 over the whole frame without one global window.

    Rows are range-partitioned by ``order`` and numbered within partitions; the partitions' sizes (``blocks``
    rows) give the offsets. Ranges come from a sample, so the dealt rows are settled before both are read.
    """
    local = _ranges(df, order, blocks).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = local.groupBy("_p").agg(F.max("_r").alias("_n"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(offsets.select("_p", "_o")), "_p").withColumn(name, (F.col("_o") + F.col("_r") - 1).cast("bigint")).drop("_p", "_r", "_o")


def cumulated(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, blocks: int | None = None) -> DataFrame:
    """The running sum of ``value`` (a whole number) in each group, up to and with the row, for groups of any
    size: no group is one task.

    Rows are dealt by range of (group, order) and summed within ranges. A group that lies in several ranges adds
    the sums of those before; a range begins inside one group at most, so these are ``blocks`` rows.
    """
    local = _ranges(df.withColumn("_v", value), [*group, *order], blocks)
    totals = local.groupBy("_p", *group).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_o", F.sum("_s").over(before)).where("_o is not null").select("_p", "_o", *[F.col(g).alias(f"_g_{g}") for g in group])
    same = F.col("_p") == F.col("_q")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    own = F.sum("_v").over(Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = local.withColumn("_own", own).join(F.broadcast(carried.withColumnRenamed("_p", "_q")), same, "left")
    return out.select(*df.columns, (F.col("_own") + F.coalesce("_o", F.lit(0))).cast("bigint").alias(name))


def group_positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Each row's place in its group, from 0."""
    return cumulated(df, group, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """JOIN-06, SRC-14: rows paired by position; surplus rows of either side have nulls on the other."""
    return positions(left, left_order).join(positions(right, right_order), "pos", "full_outer")


def pairs(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """JOIN-13: all pairs (i < j) within a bounded key such as the objects of a frame or the lines of an order."""
    a = df.select(*key, *[F.col(c).alias(f"{c}_a") for c in [order, *columns]])
    b = df.select(*key, *[F.col(c).alias(f"{c}_b") for c in [order, *columns]])
    return a.join(b, key).where(F.col(f"{order}_a") < F.col(f"{order}_b"))


def substring_lookup(df: DataFrame, text: str, rules: list[tuple[str, object]], default) -> Column:
    """JOIN-15: value of the first rule whose key the text contains; a short list becomes one expression."""
    out = F
    for key, value in rules:
        out = out.when(F.contains(F.col(text), F.lit(key)), F.lit(value))
    return out.otherwise(F.lit(default))


def with_fallback(df: DataFrame, fine: DataFrame, coarse: DataFrame, fine_key: list[str], coarse_key: list[str], value: str) -> DataFrame:
    """JOIN-10: the fine key's value, else the coarse key's."""
    a = fine.select(*fine_key, F.col(value).alias("_fine"))
    b = coarse.select(*coarse_key, F.col(value).alias("_coarse"))
    out = df.join(a, fine_key, "left").join(b, coarse_key, "left")
    return out.withColumn(value, F.coalesce("_fine", "_coarse")).withColumn("source", F.when(F.col("_fine").isNotNull(), "fine").when(F.col("_coarse").isNotNull(), "coarse")).drop("_fine", "_coarse")


def zip_arguments(df: DataFrame, key: list[str], lists: list[str], scalars: list[str]) -> DataFrame:
    """JOIN-14, UDF-10: one row for each place of the list arguments, scalars repeated; lists of a row must be of
    one length."""
    n = F.size(lists[0])
    same = F.lit(True)
    for c in lists[1:]:
        same = same & (F.size(c) == n)
    zipped = F.when(same, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit(f"{', '.join(lists)}: lengths differ")))
    return df.select(*key, *scalars, F.posexplode(zipped).alias("i", "z")).select(*key, "i", *[F.col("z")[c].alias(c) for c in lists], *scalars)


def to_do(inputs: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """JOIN-18: inputs without an output yet; all of them to overwrite."""
    return inputs if overwrite else inputs.join(done, key, "left_anti")


def labelled_union(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """SET-07: frames of one schema under their labels."""
    out = None
    for label, df in parts.items():
        df = df.withColumn(name, F.lit(label))
        out = df if out is None else out.unionByName(df)
    return out
