"""Moving-block bootstrap of a correlation."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.special import Z975, incomplete_beta
from tidemark.operators.stats import complete

# Executors need not have this package installed: the helpers travel with the function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the draw: a prime modulus and the added constant of each round.
PRIME = 2_147_483_647
ROUND_ADD = (12_345, 67_890, 24_680)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble integers below PRIME; x**5 permutes the residues of this prime.

    Products stay under 2**62, so any engine with 64-bit integers draws the same.
    """
    for add in ROUND_ADD:
        sq = x * x % PRIME
        x = (sq * sq % PRIME * x + add) % PRIME
    return x


def block_starts(n: int, block: int, n_boot: int, seed: int) -> np.ndarray:
    """(n_boot, blocks) start positions in [0, n - block]; the same for every group of size n."""
    k = math.ceil(n / block)
    index = np.arange(n_boot * k, dtype=np.int64).reshape(n_boot, k)
    return _mix((index + seed * 1_000_003 + 1) % PRIME) % (n - block + 1)


def resampled_corr(x: np.ndarray, y: np.ndarray, block: int, starts: np.ndarray) -> np.ndarray:
    """r of every resample, from block sums: no resample is built row by row."""
    n = len(x)
    tail = n - (starts.shape[1] - 1) * block
    x, y = x - x.mean(), y - y.mean()
    sums = []
    for v in (x, y, x * x, y * y, x * y):
        c = np.concatenate([[0.0], np.cumsum(v)])
        full = c[block:] - c[:-block]
        last = c[starts[:, -1] + tail] - c[starts[:, -1]]
        sums.append(full[starts[:, :-1]].sum(axis=1) + last)
    sx, sy, sxx, syy, sxy = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        return (n * sxy - sx * sy) / np.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))


def _interval(x: np.ndarray, y: np.ndarray, block: int, starts: np.ndarray | None) -> tuple[float | None, float | None]:
    """The middle 95% of the resampled r; nothing without starts or where no resample varies."""
    if starts is None:
        return None, None
    r = resampled_corr(x, y, block, starts)
    r = r[~np.isnan(r)]
    return tuple(float(v) for v in np.percentile(r, [2.5, 97.5])) if len(r) else (None, None)


def _corr(x: np.ndarray, y: np.ndarray) -> float | None:
    x, y = x - x.mean(), y - y.mean()
    size = math.sqrt((x @ x) * (y @ y))
    return min(1.0, max(-1.0, float(x @ y) / size)) if size else None


def _p(r: float | None, n: int) -> float | None:
    return incomplete_beta((n - 2) / 2.0, 0.5, 1.0 - r * r) if r is not None and n > 2 else None


def _hac_slope(x: np.ndarray, y: np.ndarray, lags: int) -> tuple[float | None, float | None]:
    """Slope of y on x and its error, scores weighted by Bartlett's window over `lags` rows."""
    x, y = x - x.mean(), y - y.mean()
    if not x @ x:
        return None, None
    b = float(x @ y / (x @ x))
    s = (y - b * x) * x
    meat = s @ s + sum(2 * (1 - k / (lags + 1)) * float(s[k:] @ s[:-k]) for k in range(1, min(lags, len(s) - 1) + 1))
    return b, math.sqrt(meat) / float(x @ x) if meat >= 0 else None


class _Starts:
    """Drawn starts of a task, shared by its groups of equal size."""

    def __init__(self, block: int, n_boot: int, seed: int):
        self.block, self.rest, self.drawn = block, (block, n_boot, seed), {}

    def __call__(self, n: int) -> np.ndarray | None:
        if n < self.block:
            return None
        if n not in self.drawn:
            self.drawn[n] = block_starts(n, *self.rest)
        return self.drawn[n]


def block_bootstrap_corr(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str],
    block: int = 6,
    n_boot: int = 5000,
    seed: int = 42,
    order: str = "month",
) -> DataFrame:
    """95% interval of r per group. Groups are monthly samples, bounded by the calendar.

    A resample never leaves its task: only the two interval ends are output. Groups
    shorter than one block give NULL.
    """
    keys = [df.schema[c] for c in by]
    schema = T.StructType(
        [
            *keys,
            T.StructField("n", T.LongType()),
            T.StructField("ci_low", T.DoubleType()),
            T.StructField("ci_high", T.DoubleType()),
        ]
    )

    starts = _Starts(block, n_boot, seed)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        low, high = _interval(pdf[x].to_numpy(float), pdf[y].to_numpy(float), block, starts(len(pdf)))
        return pd.DataFrame([[*key, len(pdf), low, high]], columns=[*by, "n", "ci_low", "ci_high"])

    return complete(df, [x, y]).select(*by, order, F.col(x), F.col(y)).groupBy(*by).applyInPandas(one, schema)


FIGURES = ("r", "p", "ci_low", "ci_high", "rho", "rho_p", "rho_low", "rho_high", "slope", "slope_low", "slope_high")


def corr_rows(
    df: DataFrame,
    y: str,
    x: str,
    by: Sequence[str],
    lags: int = 3,
    block: int = 6,
    n_boot: int = 5000,
    seed: int = 42,
    order: str = "month",
) -> DataFrame:
    """All that is told of one pair of changes: a row per group of complete pairs.

    n; r and rho (ranks, ties share their mean) with two-sided p and the 95% interval over block resamples; the
    slope of y on x with the 95% interval of its HAC error. The blocks of a group are drawn once; values and ranks are
    summed over the same ones. Groups are monthly samples, bounded by the calendar. NULL: figures of a side that does not vary,
    p of fewer than three pairs, intervals of groups shorter than a block.
    """
    schema = T.StructType([*(df.schema[c] for c in by), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in FIGURES)])
    starts = _Starts(block, n_boot, seed)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b, n = pdf[y].to_numpy(float), pdf[x].to_numpy(float), len(pdf)
        told = []
        for u, v in ((a, b), (pdf[y].rank().to_numpy(float), pdf[x].rank().to_numpy(float))):
            r = _corr(u, v)
            told += [r, _p(r, n), *(_interval(u, v, block, starts(n)) if r is not None else (None, None))]
        slope, se = _hac_slope(b, a, lags)
        told += [slope, *((slope - Z975 * se, slope + Z975 * se) if se is not None else (None, None))]
        return pd.DataFrame([[*key, n, *told]], columns=[*by, "n", *FIGURES]).astype(dict.fromkeys(FIGURES, "float64"))

    return complete(df, [y, x]).select(*by, order, F.col(y), F.col(x)).groupBy(*by).applyInPandas(one, schema)
