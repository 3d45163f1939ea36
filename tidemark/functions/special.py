"""Tail probabilities for rows that are already reduced (one row per test).

Spark has no erf or Student-t function. These are Arrow UDFs; they see one row
per statistic, never the data behind it.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed: the helpers travel with the UDF.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the 97.5% point of the standard normal distribution.
Z975 = 1.959963984540054


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) for a standard normal Z."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0))).astype("Float64")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def corr_two_sided(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation r of n pairs (Student t with n - 2 degrees)."""

    def one(rv: float, nv: float) -> float | None:
        if pd.isna(rv) or pd.isna(nv) or nv < 3:
            return None
        return incomplete_beta((nv - 2) / 2.0, 0.5, 1.0 - min(1.0, rv * rv))

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="Float64")


def normal_interval(b: Column, se: Column) -> tuple[Column, Column]:
    """95% interval with normal quantiles."""
    return b - Z975 * se, b + Z975 * se
