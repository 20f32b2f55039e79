"""Flow fields compared frame by frame (AGG-34, AGG-35): points are rows, statistics are two-step aggregates, so a
frame is no task of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cohorts import group_quantiles, linear


def magnitude(u: str, v: str) -> Column:
    return F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))


def flow_divergence(points: DataFrame, frame: str, angles: int = 36, magnitudes: int = 20, least: float = 0.5, enough: int = 10) -> DataFrame:
    """AGG-34: the divergence KL(a || b) of each frame's flows over a joint grid of angle and log-magnitude.

    ``points`` has frame, side (``a`` or ``b``), u and v. Points under the least magnitude do not count; each side's
    edges of magnitude end at its own largest (``least`` + 1 at least), so edges are aggregated first, then cells.
    Every cell of the grid counts one more than it holds; cells that neither side hits are added up, not made. A
    frame of which a side has under ``enough`` points that count has divergence 0.
    """
    m = points.select(frame, "side", magnitude("u", "v").alias("m"), F.pmod(F.degrees(F.atan2("v", "u")), F.lit(360.0)).alias("angle"))
    valid = m.where(F.col("m") >= least)
    sides = valid.groupBy(frame, "side").agg(F.count("*").alias("n"), F.greatest(F.max("m"), F.lit(least + 1.0)).alias("top"))
    place = F.floor(F.log10(F.col("m") / least) / F.log10(F.col("top") / least) * magnitudes)
    cell = F.least(F.floor(F.col("angle") / (360.0 / angles)), F.lit(angles - 1)) * magnitudes + F.least(place, F.lit(magnitudes - 1))
    counts = valid.join(sides.select(frame, "side", "top"), [frame, "side"]).groupBy(frame, cell.alias("cell")).agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    cells = angles * magnitudes
    totals = sides.groupBy(frame).agg(F.coalesce(F.max(F.when(F.col("side") == "a", F.col("n"))), F.lit(0)).alias("na"), F.coalesce(F.max(F.when(F.col("side") == "b", F.col("n"))), F.lit(0)).alias("nb"))
    p, q = (F.col("a") + 1) / (F.col("na") + cells), (F.col("b") + 1) / (F.col("nb") + cells)
    hit = counts.join(totals, frame).groupBy(frame).agg(F.sum(p * F.log(p / q)).alias("kl"), F.count("*").alias("hit"))
    p0, q0 = 1 / (F.col("na") + cells), 1 / (F.col("nb") + cells)
    kl = F.when((F.col("na") < enough) | (F.col("nb") < enough), 0.0).otherwise(F.col("kl") + (cells - F.col("hit")) * p0 * F.log(p0 / q0))
    every = points.select(frame).distinct().join(totals, frame, "left").join(hit, frame, "left")
    return every.select(frame, F.coalesce(kl, F.lit(0.0)).alias("kl"))


def flow_errors(points: DataFrame, frame: str, cell: Column, least: float = 0.5, quantile: float = 0.8) -> DataFrame:
    """AGG-35: end-point errors of each frame: n_valid, mf_epe, mf_angle_err, mf_cosine, pixel_epe_mean, pixel_epe_max,
    grid_epe_mean, grid_epe_max, fl_all.

    ``points`` has frame, u, v (truth) and gu, gv (generated). A point is valid if the larger of its magnitudes is at
    least ``least`` and not over the frame's quantile of it; a frame, or a cell, without valid points takes all of its
    points. ``cell`` is null outside the grid.
    """
    df = points.withColumns({"_cell": cell, "_m": magnitude("u", "v"), "_g": magnitude("gu", "gv")}).withColumn("_top", F.greatest("_m", "_g"))
    df = df.withColumn("_e", F.sqrt(F.pow(F.col("u") - F.col("gu"), 2) + F.pow(F.col("v") - F.col("gv"), 2)))
    hi = group_quantiles(df.select(frame, "_top"), [frame], "_top", {"_hi": linear(quantile)}).drop("n")
    df = df.join(hi, frame).withColumn("_ok", (F.col("_top") >= least) & (F.col("_top") <= F.col("_hi")))
    far = (F.col("_e") > 3.0) & (F.col("_e") > 0.05 * F.col("_m"))
    ok = lambda f, c: f(F.when(F.col("_ok"), c))
    columns = ("u", "v", "gu", "gv")
    parts = df.groupBy(frame, "_cell").agg(
        F.count("*").alias("n"), F.count_if("_ok").alias("k"),
        F.sum("_e").alias("e"), ok(F.sum, F.col("_e")).alias("ke"), F.max("_e").alias("top"), ok(F.max, F.col("_e")).alias("ktop"),
        F.count_if(far).alias("far"), F.count_if(far & F.col("_ok")).alias("kfar"),
        *[F.sum(c).alias(f"s_{c}") for c in columns], *[ok(F.sum, F.col(c)).alias(f"k_{c}") for c in columns],
    )
    mean = F.when(F.col("_cell").isNotNull(), F.when(F.col("k") > 0, F.col("ke") / F.col("k")).otherwise(F.col("e") / F.col("n")))
    whole = parts.withColumn("_mean", mean).groupBy(frame).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("e").alias("e"), F.sum("ke").alias("ke"), F.max("top").alias("top"), F.max("ktop").alias("ktop"),
        F.sum("far").alias("far"), F.sum("kfar").alias("kfar"), *[F.sum(f"{x}_{c}").alias(f"{x}_{c}") for x in "sk" for c in columns],
        F.avg("_mean").alias("grid_epe_mean"), F.max("_mean").alias("grid_epe_max"),
    )
    some = F.col("k") > 0
    of = lambda c: F.when(some, F.col(f"k_{c}") / F.col("k")).otherwise(F.col(f"s_{c}") / F.col("n"))
    out = whole.withColumns({f"m_{c}": of(c) for c in columns}).withColumns({"_a": magnitude("m_u", "m_v"), "_b": magnitude("m_gu", "m_gv")})
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("m_u") * F.col("m_gu") + F.col("m_v") * F.col("m_gv")) / F.nullif(F.col("_a") * F.col("_b"), F.lit(0.0))))
    still = [F.col("_a") < 0.1, F.col("_b") < 0.1]
    by = lambda both, one, else_: F.when(still[0] & still[1], both).when(still[0] | still[1], one).otherwise(else_)
    return out.select(
        frame, F.col("k").alias("n_valid"),
        F.sqrt(F.pow(F.col("m_u") - F.col("m_gu"), 2) + F.pow(F.col("m_v") - F.col("m_gv"), 2)).alias("mf_epe"),
        by(0.0, 90.0, F.degrees(F.acos(cosine))).alias("mf_angle_err"), by(1.0, 0.0, cosine).alias("mf_cosine"),
        F.when(some, F.col("ke") / F.col("k")).otherwise(F.col("e") / F.col("n")).alias("pixel_epe_mean"), F.when(some, F.col("ktop")).otherwise(F.col("top")).alias("pixel_epe_max"),
        "grid_epe_mean", "grid_epe_max", F.when(some, F.col("kfar") / F.col("k")).otherwise(F.col("far") / F.col("n")).alias("fl_all"),
    )


def grid_cell(x: Column, y: Column, width: int, height: int, grid: int) -> Column:
    """The cell of a point in a ``grid`` by ``grid`` raster of equal cells; null for what is left over at the ends."""
    w, h = width // grid, height // grid
    if not w or not h:
        raise ValueError(f"no {grid} x {grid} cells in {width} x {height}")
    cx, cy = F.floor(x / w), F.floor(y / h)
    return F.when((cx < grid) & (cy < grid), cy * grid + cx)


