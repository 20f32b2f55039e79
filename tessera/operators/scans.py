"""Ordered scans over groups of any size (WIN-04, WIN-08, WIN-11, WIN-12, STR-01, STR-03, AGG-33, SRT-06).

Rows are dealt by range of (group, order). Each range is scanned by itself and leaves one summary a group, whose
combination over the ranges before is what a group brings into the next one. A range begins inside one group at
most, so there are as many summaries to hand on as ranges, and no task has all rows of a large group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import _ranges, group_positions

BLOCK = 1 << 14
LEAST_FACTOR = 1e-150


@dataclass(frozen=True)
class Scan:
    """Rows with their range ``_p``; ``rows`` has the columns added so far."""

    dealt: DataFrame
    group: list[str]
    order: list[str]

    @property
    def rows(self) -> DataFrame:
        return self.dealt.drop("_p")

    def add(self, **columns: tuple) -> Scan:
        """Columns by name: (how, value) or (how, value, "before").

        ``how`` is sum, max, min or last (the last that is not null) over the rows of the group up to the row, or
        before it; ``total`` is the sum over the whole group. All columns of one call take one pass.
        """
        df = self.dealt
        for name, (how, value, *before) in columns.items():
            df = df.withColumn(f"_v_{name}", value)
        p, place = ["_p", *self.group], F.struct(*self.order)
        upto = Window.partitionBy(*p).orderBy(*self.order)
        ahead = Window.partitionBy(*self.group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.group)
        own, sums, carry, final = {}, [], [], {}
        for name, (how, _, *before) in columns.items():
            v, t, c = F.col(f"_v_{name}"), F.col(f"_t_{name}"), F.col(f"_c_{name}")
            frame = upto.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
            mine = F.col(f"_o_{name}")
            if how == "last":
                own[f"_o_{name}"] = F.last(v, True).over(frame)
                sums.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_t_{name}"))
                carry.append(F.last(t, True).over(ahead).alias(f"_c_{name}"))
                final[name] = F.coalesce(mine, c)
            elif how == "total":
                own[f"_o_{name}"] = F.sum(v).over(Window.partitionBy(*p))
                sums.append(F.sum(v).alias(f"_t_{name}"))
                carry.append((F.sum(t).over(whole) - t).alias(f"_c_{name}"))
                final[name] = mine + F.coalesce(c, F.lit(0))
            else:
                f = {"sum": F.sum, "max": F.max, "min": F.min}[how]
                own[f"_o_{name}"] = f(v).over(frame)
                sums.append(f(v).alias(f"_t_{name}"))
                carry.append(f(t).over(ahead).alias(f"_c_{name}"))
                join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}[how]
                final[name] = join(mine, c)
        each = df.groupBy(*p).agg(*sums).withColumn("_several", F.count("*").over(whole) > 1).where("_several")
        handed = each.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g_{g}") for g in self.group], *carry)
        same = F.col("_p") == F.col("_q")
        for g in self.group:
            same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        out = df.withColumns(own).join(F.broadcast(handed), same, "left")  # two rows a range at most
        return Scan(out.select(*self.dealt.columns, *[x.alias(n) for n, x in final.items()]), self.group, self.order)


def scan(df: DataFrame, group: list[str], order: list[str], blocks: int | None = None) -> Scan:
    """``df`` dealt by range and settled, ready for scans; this runs jobs."""
    return Scan(_ranges(df, [*group, *order], blocks), group, order)


def previous(df: DataFrame, group: list[str], order: list[str], blocks: int | None = None, **columns: Column) -> DataFrame:
    """WIN-04, STR-01: the columns' values in the group's row before, nulls included; null in its first row."""
    got = scan(df, group, order, blocks).add(_before=("last", F.struct(*[c.alias(n) for n, c in columns.items()]), "before")).rows
    return got.select(*df.columns, *[F.col("_before")[n].alias(n) for n in columns])


def numbered(df: DataFrame, group: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """Each row's place in its group, from 0 (``pos``), and the group's size (``n``)."""
    got = scan(df, group, order, blocks).add(pos=("sum", F.lit(1)), n=("total", F.lit(1))).rows
    return got.withColumn("pos", F.col("pos") - 1)


def run_lengths(df: DataFrame, group: list[str], order: list[str], flag: str, blocks: int | None = None) -> Scan:
    """WIN-12: ``run``, how many rows in a row up to this one have its ``flag``: the distance to the last row with
    the other one. ``pos`` is the place from 1."""
    placed = scan(df, group, order, blocks).add(pos=("sum", F.lit(1)))
    last = lambda is_: ("last", F.when(is_, F.col("pos")))
    both = placed.add(_true=last(F.col(flag)), _false=last(~F.col(flag)))
    run = F.col("pos") - F.coalesce(F.when(F.col(flag), F.col("_false")).otherwise(F.col("_true")), F.lit(0))
    return Scan(both.dealt.withColumn("run", run).drop("_true", "_false"), group, order)


def _decayed(df: DataFrame, group: list[str], ratio: float, n: int) -> DataFrame:
    """(group, _pos, _b) with ``_y``: the sum over the rows up to each of ``ratio`` ** distance times ``_b``."""
    most = BLOCK if ratio <= 0 else min(BLOCK, int(math.log(LEAST_FACTOR) / math.log(ratio)))
    if ratio <= 0 or most < 2:  # what lies a row back is below any precision
        return df.withColumn("_y", F.col("_b"))
    rows = df.withColumn("_k", F.expr(f"_pos % {most}")).withColumn("_block", F.expr(f"_pos div {most}"))
    grown = F.sum(F.col("_b") * F.pow(F.lit(ratio), -F.col("_k"))).over(Window.partitionBy(*group, "_block").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_y", grown * F.pow(F.lit(ratio), F.col("_k")))
    if n <= most:
        return rows.drop("_k", "_block")
    ends = rows.where(F.col("_k") == most - 1).select(*group, F.col("_block").alias("_pos"), F.col("_y").alias("_b"))
    carried = _decayed(ends, group, ratio**most, -(-n // most)).select(*[F.col(g).alias(f"_g_{g}") for g in group], (F.col("_pos") + 1).alias("_next"), F.col("_y").alias("_c"))
    same = F.col("_block") == F.col("_next")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = rows.join(carried, same, "left")
    y = F.col("_y") + F.coalesce(F.col("_c") * F.pow(F.lit(ratio), F.col("_k") + 1), F.lit(0.0))
    return joined.select(*df.columns, y.alias("_y"))


def exponential_mean(df: DataFrame, group: list[str], order: list[str], value: str, alpha: float, name: str = "background") -> DataFrame:
    """WIN-08 over rows: avg = (1 - alpha) avg + alpha x in each group, from its first value; for groups of any size.

    A step is an affine map of the average, and maps of equal slope compose to a sum of decayed terms. Blocks of rows
    are summed by themselves; their ends are a shorter recursion of the same kind (slope to the power of the
    block's length), whose result each block starts from.
    """
    placed = group_positions(df, group, order, "_pos").withColumn("_b", F.when(F.col("_pos") == 0, F.col(value)).otherwise(F.lit(float(alpha)) * F.col(value)))
    n = (placed.agg(F.max("_pos")).first()[0] or 0) + 1  # one number
    return _decayed(placed, group, 1.0 - alpha, n).select(*df.columns, F.col("_y").alias(name))
