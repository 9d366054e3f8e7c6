"""Fits at an order, forecasts and intervals against numpy, and chunks against whole series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from marketframe.operators import arma

ORDERS = [(1, 0, 0, 0), (0, 0, 1, 0), (1, 0, 1, 7), (1, 1, 1, 7), (2, 1, 0, 0)]


def drawn(n, seed, order, theta=(0.5, -0.3, 0.2)):
    """A series that follows the order, with two features."""
    rng, t = np.random.default_rng(seed), arma.terms(*order)
    x, e, z = rng.normal(0, 1, (n, 2)), rng.normal(0, 0.2, n), np.zeros(n)
    lags, weights = arma.ahead_weights(t, np.full(len(t.ar), 0.3))
    for i in range(n):
        z[i] = 0.1 + x[i] @ [0.6, -0.4] + e[i] + sum(c * e[i - k] for k, c in zip(t.ma, theta) if i >= k)
        z[i] += sum(w * z[i - k] for k, w in zip(lags, weights) if i >= k)
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame({"symbol": f"S{seed}", "date": days, "x1": x[:, 0], "x2": x[:, 1], "y": z})


def residuals(pdf, order, intercept, coef, phi, theta):
    """e by the definition, and the rows that have one."""
    t, y, x = arma.terms(*order), pdf["y"].to_numpy(), pdf[["x1", "x2"]].to_numpy()
    z = np.convolve(y, t.diff)[:len(y)]
    e = np.zeros(len(y))
    for i in range(t.depth, len(y)):
        e[i] = z[i] - intercept - x[i] @ coef - sum(c * z[i - k] for k, c in zip(t.ar, phi)) - sum(c * e[i - k] for k, c in zip(t.ma, theta) if i - k >= 0)
    return e, np.arange(t.depth, len(y))


def path(pdf, test, order, m):
    """Forecasts one by one, and their variances from the weights of a unit shock."""
    t = arma.terms(*order)
    e, _ = residuals(pdf, order, m.intercept, m.coef, m.phi, m.theta)
    lags, weights = arma.ahead_weights(t, np.array(m.phi))
    y, shock = list(pdf["y"]), []
    n = len(y)
    for k, x in enumerate(test[["x1", "x2"]].to_numpy()):
        value = m.intercept + x @ m.coef + sum(c * e[n + k - j] for j, c in zip(t.ma, m.theta) if k < j)
        y.append(value + sum(w * y[n + k - j] for j, w in zip(lags, weights)))
        unit = (1.0 if k == 0 else 0.0) + sum(c for j, c in zip(t.ma, m.theta) if j == k)
        shock.append(unit + sum(w * shock[k - j] for j, w in zip(lags, weights) if k >= j))
    return np.array(y[n:]), m.sigma * np.sqrt(np.cumsum(np.square(shock)))


@pytest.fixture(scope="module")
def fitted(spark):
    """Five series, each with an order of its own, fitted whole and in chunks of 64 rows."""
    parts = [drawn(400, i, o) for i, o in enumerate(ORDERS)]
    train, test = [p[:330] for p in parts], [p[330:] for p in parts]
    rows = spark.createDataFrame(pd.concat(train)).repartition(3)
    orders = spark.createDataFrame([(f"S{i}", *o) for i, o in enumerate(ORDERS)], "symbol string, p int, d int, q int, season int")
    models = [arma.order_fit(rows, orders, ["x1", "x2"], "y", ["symbol"], ridge=0.0, chunk_rows=n) for n in (10_000, 64)]
    return train, test, models, [{r.symbol: r for r in m.collect()} for m in models]


def test_fit_is_the_least_sum_of_squares(fitted):
    train, _, _, (whole, _) = fitted
    for i, o in enumerate(ORDERS):
        m = whole[f"S{i}"]
        assert m.reason is None
        at = np.array([m.intercept, *m.coef, *m.phi, *m.theta])
        cut = [1, 1 + 2, 1 + 2 + len(m.phi)]

        def loss(v):
            e, use = residuals(train[i], o, v[0], v[1:3], v[3:cut[2]], v[cut[2]:])
            return float(np.sum(e[use] ** 2))
        best = loss(at)
        assert m.sigma == pytest.approx(np.sqrt(best / m.n))
        for k in range(len(at)):
            for step in (-1e-3, 1e-3):
                moved = at.copy()
                moved[k] += step
                assert loss(moved) > best


def test_fit_recovers_what_drew_the_series(fitted):
    m = fitted[3][0]["S1"]
    assert m.theta[0] == pytest.approx(0.5, abs=0.12) and m.coef[0] == pytest.approx(0.6, abs=0.05)


def test_chunks_give_the_same_fit(fitted):
    whole, chunked = fitted[3]
    for s, a in whole.items():
        b = chunked[s]
        assert a.n == b.n
        for c in ("intercept", "coef", "phi", "theta", "sigma", "tail_e", "tail_y"):
            np.testing.assert_allclose(np.atleast_1d(a[c]), np.atleast_1d(b[c]), rtol=1e-5, atol=1e-7)


def test_forecasts_and_intervals_follow_the_recursion_in_any_chunks(spark, fitted):
    train, test, (models, _), (whole, _) = fitted
    rows = spark.createDataFrame(pd.concat(test)).repartition(4)
    for chunk_rows in (10_000, 16):
        got = arma.order_forecasts(rows, models, ["x1", "x2"], ["symbol"], chunk_rows=chunk_rows).toPandas().sort_values(["symbol", "step"])
        for i, o in enumerate(ORDERS):
            mine, (pred, half) = got[got["symbol"] == f"S{i}"], path(train[i], test[i], o, whole[f"S{i}"])
            np.testing.assert_allclose(mine["pred"], pred, rtol=1e-8, atol=1e-9)
            np.testing.assert_allclose(mine["upper"] - mine["pred"], 1.96 * half, rtol=1e-8)
            assert mine["step"].tolist() == list(range(1, 71))


def test_short_series_say_why_and_null_keys_are_keys(spark):
    pdf = drawn(60, 1, (1, 0, 0, 0)).assign(symbol=None)
    rows = spark.createDataFrame([*pdf.itertuples(index=False, name=None), ("T", dt.date(2020, 1, 1), 1.0, 2.0, 3.0), ("T", dt.date(2020, 1, 2), None, 2.0, 3.0)],
                                 "symbol string, date date, x1 double, x2 double, y double")
    orders = spark.createDataFrame([(None, 1, 0, 0, 0), ("T", 1, 0, 0, 0)], "symbol string, p int, d int, q int, season int")
    models = arma.order_fit(rows, orders, ["x1", "x2"], "y", ["symbol"])
    got = {r.symbol: r for r in models.collect()}
    assert got[None].reason is None and got[None].n == 59
    assert got["T"].reason == "0 rows for 4 terms" and got["T"].coef is None
    ahead = arma.order_forecasts(rows, models, ["x1", "x2"], ["symbol"]).collect()
    assert {r.symbol for r in ahead} == {None} and len(ahead) == 60
