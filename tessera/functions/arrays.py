"""Vectors and tensors in array and binary columns (ARR-01 to ARR-14, SCL-15 to SCL-22)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_tensor(data: pd.Series, dtype: pd.Series) -> pd.Series:
    """ARR-01: raw little-endian bytes as floats; the stored dtype holds, float32 where it is blank."""
    return pd.Series([None if b is None else np.frombuffer(b, dtype=np.dtype(t if t and t != "unknown" else "float32")).astype(np.float32) for b, t in zip(data, dtype, strict=True)])


@F.pandas_udf(T.BinaryType())
def encode_tensor(values: pd.Series) -> pd.Series:
    """ARR-02: floats as raw little-endian float32 bytes."""
    return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def frames_last(values: pd.Series, shape: pd.Series) -> pd.Series:
    """ARR-07: (f h w) c as c f h w."""
    return pd.Series([None if v is None else np.asarray(v, dtype=np.float32).reshape(*s).transpose(3, 0, 1, 2).ravel() for v, s in zip(values, shape, strict=True)])


def ssim_score(x: np.ndarray, y: np.ndarray, size: int = 11, sigma: float = 1.5, peak: float = 1.0) -> float:
    """Mean structural similarity of two grey images under a Gaussian window (smaller for small images)."""
    size = min(size, *x.shape)
    taps = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    taps /= taps.sum()

    def blur(m: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(m, size, axis=1) @ taps
        return np.lib.stride_tricks.sliding_window_view(rows, size, axis=0) @ taps

    mx, my = blur(x), blur(y)
    vx, vy, cov = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


@F.pandas_udf(T.DoubleType())
def ssim(a: pd.Series, b: pd.Series, shape: pd.Series) -> pd.Series:
    """ARR-09: of two flat images of one shape (h, w); null where either is null."""
    return pd.Series([None if x is None or y is None else ssim_score(np.asarray(x, dtype=float).reshape(*s), np.asarray(y, dtype=float).reshape(*s)) for x, y, s in zip(a, b, shape, strict=True)], dtype="float64")


def pad(c: Column, length: int, fill: float = 0.0) -> Column:
    """ARR-03: cropped or filled to ``length``."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(fill).cast("float"), length)), 1, length)


def pad_mask(c: Column, length: int) -> Column:
    """ARR-03: 1 where a value stands, 0 where it was filled."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= F.size(c)).cast("int"))


def unpad(c: Column, mask: Column) -> Column:
    """ARR-06: as many values as the mask counts."""
    return F.slice(c, 1, F.aggregate(mask, F.lit(0), lambda a, m: a + m))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """ARR-08; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_abs_diff(a: Column, b: Column) -> Column:
    """WIN-06, ARR-08."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mse(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def psnr(a: Column, b: Column, peak: float = 1.0) -> Column:
    """ARR-08: errors under 1e-10 count as 1e-10."""
    return 10 * F.log10(F.lit(peak * peak) / F.greatest(mse(a, b), F.lit(1e-10)))


def mask_iou(a: Column, b: Column) -> Column:
    """ARR-10: of two 0/1 arrays; an empty union is 1."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(either == 0, 1.0).otherwise(F.try_divide(both, either))


def box_iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """SCL-16."""
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, aw * ah + bw * bh - w * h), F.lit(0.0))


def softmax_kl(p: Column, q: Column) -> Column:
    """SCL-19: KL divergence of the softmaxes of two logit arrays."""

    def log_softmax(c: Column) -> Column:
        top = F.array_max(c).cast("double")
        total = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
        return F.transform(c, lambda x: x.cast("double") - top - F.log(total))

    return F.aggregate(F.zip_with(log_softmax(p), log_softmax(q), lambda x, y: F.exp(x) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def clipped_advantage(a: Column, limit: float, mode: str = "all") -> Column:
    """SCL-17: an advantage clipped, narrowed by mode, and mapped to [0, 1]."""
    c = F.greatest(F.least(a, F.lit(limit)), F.lit(-limit))
    c = {"all": c, "positive_only": F.greatest(c, F.lit(0.0)), "negative_only": F.least(c, F.lit(0.0)), "one_only": F.when(c > 0, 1.0).otherwise(0.0), "binary": F.signum(c)}[mode]
    return F.greatest(F.least(c / limit / 2 + 0.5, F.lit(1.0)), F.lit(0.0))


def decay(step: Column, flat: int, end: int, top: float, low: float) -> Column:
    """SCL-18: constant, then linear down to ``low``."""
    share = F.least((step - flat) / F.lit(float(end - flat)), F.lit(1.0))
    return F.when(step <= flat, top).otherwise(top + (low - top) * share)


def largest_frames(n: Column, modulus: int = 17, rest: int = 5) -> Column:
    """SCL-13: the largest number up to ``n`` with the given remainder; null where there is none."""
    got = n - F.pmod(n - rest, F.lit(modulus))
    return F.when(got >= rest, got)


def crop_box(w: Column, h: Column, tw: int, th: int) -> dict[str, Column]:
    """SCL-15: centred crop of the target's aspect (halves to even)."""
    wide = w * th > h * tw
    cw = F.when(wide, F.bround(h * tw / F.lit(float(th)))).otherwise(w).cast("bigint")
    ch = F.when(wide, h).otherwise(F.bround(w * th / F.lit(float(tw)))).cast("bigint")
    return {"left": F.floor((w - cw) / 2), "top": F.floor((h - ch) / 2), "width": cw, "height": ch}


def decode_log_depth(code: Column, near: float, far: float, bits: int = 16) -> Column:
    """SCL-22: exponential between near and far; 0 is invalid and stays 0."""
    share = (code - 1) / F.lit(float((1 << bits) - 2))
    return F.when(code == 0, 0.0).otherwise(F.exp(F.log(F.lit(near)) + share * (F.log(F.lit(far)) - F.log(F.lit(near)))))
