"""Distribution functions that neither Spark nor NumPy has."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + up * d) or tiny)
            c = (1 + up / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out / a


def t_two_sided(t: float, dof: float) -> float:
    return betainc(dof / 2, 0.5, dof / (dof + t * t))


def _t_pvalues(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(x), float(k) - 1) if x == x and x is not None and k > 1 else None for x, k in zip(t, n)], dtype="float64")


def t_pvalue(t, n):
    """The two-sided p value of a one-sample t statistic of n values: an Arrow UDF over one row per test."""
    return F.pandas_udf(_t_pvalues, "double")(t, n)


def _normal_tails(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(x) / math.sqrt(2)) if x == x else None for x in z.astype(float)], dtype="float64")


def normal_pvalue(z):
    """The two-sided p value of a standard normal value."""
    return F.pandas_udf(_normal_tails, "double")(z)


def first_component(x: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The first right singular vector by power iteration, its largest entry positive."""
    v = np.ones(x.shape[1]) / math.sqrt(max(1, x.shape[1])) + 1e-3 * np.arange(x.shape[1])
    for _ in range(rounds):
        w = x.T @ (x @ v)
        n = np.linalg.norm(w)
        if n == 0:
            return np.zeros(x.shape[1])
        if np.linalg.norm(w / n - v) < 1e-13:
            break
        v = w / n
    return v if v[np.argmax(np.abs(v))] > 0 else -v
