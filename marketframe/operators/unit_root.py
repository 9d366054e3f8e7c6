"""Augmented Dickey-Fuller test per series, with the number of lagged differences chosen by AIC.

Changes are regressed on a constant, the value before and k changes before.  The regressions of all k are nested, so one matrix
of sums of products per series gives them all: eliminating one regressor after the other leaves each one's residual
sum.  The sums are added up in the JVM; Python sees a few small rows per series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators import series
from marketframe.operators.gram import gram, moments
from marketframe.operators.landing import land

# Response surface of the test's distribution with a constant (MacKinnon 1994): below and above the
# point between, the polynomial in t whose normal probability is the p-value; beyond the ends it is 0 or 1.
P_LOW, P_BETWEEN, P_HIGH = -18.83, -1.61, 2.74
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def p_value(t: float) -> float:
    if t > P_HIGH:
        return 1.0
    if t < P_LOW:
        return 0.0
    x = sum(c * t ** i for i, c in enumerate(P_SMALL if t <= P_BETWEEN else P_LARGE))
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def most_lags(n: int) -> int:
    """Lags tried for a series of n values: Schwert's rule, and no more than half the values allow."""
    return max(0, min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25)))


def _eliminate(cov: np.ndarray, j: int) -> np.ndarray:
    """What is left of the covariances when variable j explains what it can; nothing is, if it does not vary by itself."""
    pivot = cov[j, j]
    return cov - np.outer(cov[:, j], cov[j]) / pivot if pivot > 1e-14 else cov


def _covariances(g: np.ndarray) -> tuple[float, np.ndarray]:
    n = g[0, 0]
    mean = g[0, 1:] / n
    return n, g[1:, 1:] / n - np.outer(mean, mean)


def lag_by_aic(g: np.ndarray, most: int) -> int:
    """The number of lags of least AIC, all on the same rows.  Variables: value before, changes before by lag, change."""
    n, cov = _covariances(g)
    rest, scores = _eliminate(cov, 0), []
    for k in range(most + 1):
        rest = _eliminate(rest, k) if k else rest
        scores.append(n * math.log(max(rest[-1, -1], 1e-300)) + 2 * (k + 2))
    return int(np.argmin(scores))


def t_statistic(g: np.ndarray, lags: int) -> float | None:
    """The t-value of the value before, with ``lags`` changes before."""
    if g[0, 0] <= lags + 2:
        return None
    n, cov = _covariances(g)
    for k in range(1, lags + 1):
        cov = _eliminate(cov, k)
    sxx, sxy, syy = cov[0, 0], cov[0, -1], cov[-1, -1]
    if sxx <= 1e-14:
        return None
    left = syy - sxy * sxy / sxx
    return float(sxy / sxx / math.sqrt(left / (n - lags - 2) / sxx)) if left > 1e-14 else None


def augmented_stationarity(rows: DataFrame, column: str, keys: list[str], order: str = "date", lags: int | None = None,
                           level: float = 0.05, chunk_rows: int = series.CHUNK_ROWS) -> DataFrame:
    """keys, n (changes used), lags, t_stat, p_value and stationary (p below ``level``) per series.

    ``lags`` fixes the number of lagged changes; else it is the one of least AIC among those that ``most_lags`` allows, compared on
    the same rows and then tested on all rows that have them.  Where the test is undefined, t and p are NULL and the series
    does not pass."""
    known = land(series.with_position(rows.select(*keys, order, F.col(column).cast("double").alias("_v")).filter("_v IS NOT NULL"), keys, order))
    longest = known.agg(F.max(series.SIZE)).first()[0] or 0
    deepest = most_lags(longest) if lags is None else lags
    w = series.chunk_window(keys)
    change = lambda i: F.lag("_v", i).over(w) - F.lag("_v", i + 1).over(w)
    names = ["_before", *(f"_d{i}" for i in range(1, deepest + 1)), "_dy"]
    lagged = series.chunked(known, keys, order, deepest + 1, 0, chunk_rows).withColumns({
        "_before": F.lag("_v").over(w), "_dy": F.col("_v") - F.lag("_v").over(w),
        **{f"_d{i}": F.coalesce(change(i), F.lit(0.0)) for i in range(1, deepest + 1)},
        "_has": F.least(F.col(series.POS) - 1, F.lit(deepest)), "_size_of": F.col(series.SIZE)})
    # a row has as many lagged changes as its place allows; rows of one depth are added up together
    # in a struct, since sums leave out rows without a key
    of = series.own_rows(lagged.withColumn("_key", F.struct(*keys))).filter(F.col("_has") >= 0)
    sums = moments(of, names, ["_key", "_has", "_size_of"]).select("_key.*", "_has", "_size_of", "n", "m")
    width = len(names)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {int(h): gram(n, np.asarray(m), width) for h, n, m in zip(pdf["_has"], pdf["n"], pdf["m"])}

        def from_depth(k: int) -> np.ndarray:
            return sum((g for h, g in parts.items() if h >= k), np.zeros((width + 1, width + 1)))
        k = lags
        if k is None:
            most = min(most_lags(int(pdf["_size_of"].iloc[0])), max(parts))
            k = lag_by_aic(from_depth(most), most)
        g = from_depth(k)
        t = t_statistic(g, k)
        p = None if t is None else p_value(t)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in keys}, "n": int(g[0, 0]), "lags": k, "t_stat": t, "p_value": p, "stationary": p is not None and p < level}])
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    return sums.groupBy(*keys).applyInPandas(test, f"{types}, n long, lags int, t_stat double, p_value double, stationary boolean")
