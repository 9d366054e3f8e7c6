"""The augmented test against regressions by numpy."""

import datetime as dt
import math

import numpy as np
import pytest

from marketframe.operators import unit_root
from marketframe.operators.select import stationarity


def regression(y, k, first):
    """t-value of the value before and the residual sum, on the changes from ``first`` on."""
    dy = np.diff(y)
    use = np.arange(first, len(dy))
    a = np.column_stack([y[use], *(dy[use - i] for i in range(1, k + 1)), np.ones(len(use))])
    b, *_ = np.linalg.lstsq(a, dy[use], rcond=None)
    ssr = float(np.sum((dy[use] - a @ b) ** 2))
    return b[0] / math.sqrt(ssr / (len(use) - k - 2) * np.linalg.inv(a.T @ a)[0, 0]), ssr, len(use)


def by_hand(y):
    most = unit_root.most_lags(len(y))
    scores = []
    for k in range(most + 1):
        _, ssr, n = regression(y, k, most)
        scores.append(n * math.log(ssr / n) + 2 * (k + 2))
    k = int(np.argmin(scores))
    return k, *regression(y, k, k)[::2]


@pytest.fixture(scope="module")
def walks():
    rng, out = np.random.default_rng(2), {}
    for name, n, pull, lags in (("walk", 300, 0.0, [0.4, -0.3]), ("back", 250, 0.2, [0.0, 0.0, 0.5]), (None, 90, 0.05, [0.3])):
        y, d = [5.0], [0.0] * 9
        for e in rng.normal(0, 0.5, n - 1):
            d.append(-pull * (y[-1] - 5) + sum(c * d[-1 - i] for i, c in enumerate(lags)) + e)
            y.append(y[-1] + d[-1])
        out[name] = np.array(y)
    return out


def frame(spark, walks):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=2 * i), float(v)) for k, y in walks.items() for i, v in enumerate(y)]
    rows += [("flat", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(40)] + [("one", dt.date(2020, 1, 1), 1.0), ("walk", dt.date(1990, 1, 1), None)]
    return spark.createDataFrame(rows, "symbol string, date date, v double").repartition(5)


def test_lag_and_statistic(spark, walks):
    for chunk_rows in (8192, 64):
        got = {r.symbol: r for r in unit_root.augmented_stationarity(frame(spark, walks), "v", ["symbol"], chunk_rows=chunk_rows).collect()}
        for name, y in walks.items():
            k, t, n = by_hand(y)
            assert (got[name].lags, got[name].n) == (k, n) and got[name].t_stat == pytest.approx(t, rel=1e-6)
        assert not got["walk"].stationary and got["back"].stationary and got["back"].lags >= 3
        assert got["flat"].t_stat is None and got["flat"].stationary is False and "one" not in got


def test_fixed_lags_and_lag_zero_is_the_plain_test(spark, walks):
    df = frame(spark, walks)
    for k in (0, 1, 2):
        got = {r.symbol: r for r in unit_root.augmented_stationarity(df, "v", ["symbol"], lags=k).collect()}
        for name, y in walks.items():
            t, _, n = regression(y, k, k)
            assert got[name].n == n and got[name].t_stat == pytest.approx(t, rel=1e-6)
    plain = {r.symbol: r for r in stationarity(df, "v").collect()}
    got = {r.symbol: r for r in unit_root.augmented_stationarity(df, "v", ["symbol"], lags=0).collect()}
    assert all(got[s].t_stat == pytest.approx(plain[s].t_stat, rel=1e-9) for s in walks)


def test_p_values_at_published_points():
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert unit_root.p_value(t) == pytest.approx(p, abs=0.002)
    assert unit_root.p_value(-30) == 0.0 and unit_root.p_value(3) == 1.0
    steps = [unit_root.p_value(-6 + i / 10) for i in range(85)]
    assert steps == sorted(steps)
