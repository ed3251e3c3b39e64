"""Numeric expressions shared by the operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def no_nan(col: Column | str) -> Column:
    """NaN is 'missing' in the landed files; downstream it must be null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c), None).otherwise(c)


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    out = col
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def log_of(log: Column, of: Column) -> Column:
    """The logarithm ``log`` of ``of`` with minus infinity at zero, where Spark gives null."""
    return F.when(of == 0, F.lit(float("-inf"))).otherwise(log)


def keyed_uniform(*keys: Column | str | int) -> Column:
    """Uniform in (0, 1) that depends on its keys only, so reruns and other engines draw the same number."""
    parts = [F.col(k) if isinstance(k, str) else (k if isinstance(k, Column) else F.lit(k)) for k in keys]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / F.lit(4294967296.0)


def null_skipping_mean(cols: list[Column]) -> Column:
    """Row mean over the non-null members; null when all are null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    count = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.when(count > 0, total / count)


def _beta_fraction(a: float, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), vectorised."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0.0) & (x < 1.0)
    if inside.any():
        ai, bi, xi = a[inside], b[inside], x[inside]
        front = np.exp(_lgamma(ai + bi) - _lgamma(ai) - _lgamma(bi) + ai * np.log(xi) + bi * np.log1p(-xi))
        direct = xi < (ai + 1.0) / (ai + bi + 2.0)
        lower = front * _beta_fraction(np.where(direct, ai, bi), np.where(direct, bi, ai), np.where(direct, xi, 1 - xi))
        out[inside] = np.where(direct, lower / ai, 1.0 - lower / bi)
    return out


def pearson_p_values(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided Student-t p-value of a correlation; NaN below three samples."""
    r, n = np.asarray(r, dtype=float), np.asarray(n, dtype=float)
    df = n - 2.0
    ok = (df > 0) & ~np.isnan(r)
    p = np.full(r.shape, np.nan)
    rr = np.clip(r[ok] ** 2, 0.0, 1.0)
    p[ok] = beta_inc(df[ok] / 2.0, np.full(rr.shape, 0.5), 1.0 - rr)
    return p


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    p = pearson_p_values(r.to_numpy(dtype=float), n.to_numpy(dtype=float))
    return pd.Series(p).where(~np.isnan(p), None)


@F.pandas_udf(DoubleType())
def chi2_tail_1df(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(math.sqrt(v / 2.0)) if v is not None and v >= 0 else None)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v is not None and v == v else None)
