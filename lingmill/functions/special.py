"""Distribution tails without external libraries: numpy versions, and Column versions built on them where needed."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    if ok.any():
        aa, bb, xx = a[ok], b[ok], x[ok]
        swap = xx > (aa + 1) / (aa + bb + 2)
        p, q, y = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y))
        value = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * _beta_fraction(p, q, np.clip(y, 0, 1 - 1e-16)) / p))
        out[ok] = np.where(swap, 1 - value, value)
    return out


def t_two_tailed(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2) -> np.ndarray:
    f = np.asarray(f, float)
    return beta_inc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def normal_two_tailed(z) -> np.ndarray:
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


def column(f: Callable) -> Callable[..., Column]:
    """A vectorised Column version of a tail: one call for an Arrow batch."""

    @F.pandas_udf(DoubleType())
    def tail(*args: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(f(*[a.to_numpy(float, na_value=np.nan) for a in args]))

    return tail


p_of_t = column(t_two_tailed)
p_of_z = column(normal_two_tailed)
p_of_f = column(f_upper)
