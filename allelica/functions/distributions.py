"""Tail probabilities and quantiles as vectorised NumPy, and as Arrow UDFs. No SciPy needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    y = np.clip(y, 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def gammaincc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    for i in np.ndindex(a.shape):
        s, v = a[i], x[i]
        if not v > 0:
            out[i] = 1.0 if v == v else np.nan
            continue
        front = math.exp(-v + s * math.log(v) - math.lgamma(s))
        if v < s + 1:
            term = total = 1 / s
            n = s
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= v / n
                total += term
            out[i] = 1 - total * front
        else:
            b = v + 1 - s
            c, d = 1e300, 1 / b
            h = d
            for k in range(1, 1000):
                num = -k * (k - s)
                b += 2
                d = 1 / (num * d + b)
                c = b + num / c
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            out[i] = front * h
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    """P(F >= f)."""
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    return betainc(df2 / 2, df1 / 2, df2 / (df2 + df1 * np.maximum(f, 0)))


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def norm_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def norm_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution by bisection on erfc with a Newton finish."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = _erfc(-mid / math.sqrt(2)) / 2 < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return np.where((p > 0) & (p < 1), (lo + hi) / 2, np.nan)


def _udf(fn):
    def apply(*cols: pd.Series) -> pd.Series:
        arrays = [c.to_numpy(float, na_value=np.nan) for c in cols]
        ok = ~np.any([np.isnan(a) for a in arrays], axis=0)
        out = pd.Series([None] * len(ok), dtype=object)
        if ok.any():
            out[ok] = fn(*[a[ok] for a in arrays]).tolist()
        return out.astype("Float64").astype(object).where(out.notna(), None)

    return apply


def p_t(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; null in, null out."""

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return _udf(t_two_sided)(a, b)

    return f(t.cast("double"), df.cast("double"))


def p_f(x: Column, df1: Column, df2: Column) -> Column:
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _udf(f_upper)(a, b, c)

    return f(x.cast("double"), df1.cast("double"), df2.cast("double"))


def p_chi2(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return _udf(chi2_upper)(a, b)

    return f(x.cast("double"), df.cast("double"))


def p_norm(z: Column) -> Column:
    @F.pandas_udf("double")
    def f(a: pd.Series) -> pd.Series:
        return _udf(norm_two_sided)(a)

    return f(z.cast("double"))


def q_norm(p: Column) -> Column:
    @F.pandas_udf("double")
    def f(a: pd.Series) -> pd.Series:
        return _udf(norm_quantile)(a)

    return f(p.cast("double"))
