"""Lagged regressions with moving-average terms: fit at a given order, forecasts of many steps and their intervals.

For an order (p, d, q, season) the target y is differenced d times, and d times by season, to z, and

    z[t] = c + x[t] beta + sum phi[i] z[t-i] + sum theta[j] e[t-j] + e[t]

with i in 1..p and season..p*season, j in 1..q and season..q*season (no seasonal terms where season is 0).  The fit takes the
least sum of squared e (conditional on the first rows) by Gauss-Newton steps, in which e and its derivatives are linear
recursions over the series.  A recursion runs over chunks of a series: a chunk is first run from zero, what it makes
of the state before it is a linear map, the maps of a series are composed in a table with one row per chunk, and the
chunk is run again from its true state.  Series of one chunk are fitted in one pass, longer ones in two jobs per step.

Forecasts put past forecasts in the place of values and zero in the place of e, so they are a recursion too: the product of the
lag and difference polynomials applied to y, which undoes the differences.  The same recursion on a unit shock gives the
weights whose squares, summed over the steps ahead, widen the interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators import series
from marketframe.operators.landing import land

RIDGE = 1e-6
STEPS = 30
TOLERANCE = 1e-9
NORMAL_95 = 1.96
ORDER = ["p", "d", "q", "season"]


class Terms(NamedTuple):
    ar: list[int]
    ma: list[int]
    diff: np.ndarray

    @property
    def depth(self) -> int:
        """Rows that a series needs before its first residual."""
        return len(self.diff) - 1 + max(self.ar, default=0)

    @property
    def memory(self) -> int:
        """Residuals that the next one reads."""
        return max(self.ma, default=0)


def terms(p: int, d: int, q: int, season: int) -> Terms:
    lags = lambda n: sorted({*range(1, n + 1), *(season * i for i in range(1, n + 1) if season)})
    diff = np.ones(1)
    for _ in range(d):
        diff = np.convolve(diff, [1.0, -1.0])
        if season:
            diff = np.convolve(diff, np.concatenate([[1.0], np.zeros(season - 1), [-1.0]]))
    return Terms(lags(p), lags(q), diff)


def recursion(inputs: np.ndarray, lags: list[int], weights: np.ndarray, state: np.ndarray) -> np.ndarray:
    """v[t] = inputs[t] + sum weights[l] v[t - lags[l]]; ``state`` holds the rows before the first."""
    if not lags:
        return inputs
    k, back = len(state), np.array(lags)
    v = np.concatenate([state, inputs])
    for t in range(k, len(v)):
        v[t] += weights @ v[t - back]
    return v[k:]


def last_rows(state: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The state after the rows ``v``."""
    return np.concatenate([state, v])[len(v):]


class Params(NamedTuple):
    linear: np.ndarray  # intercept, features, lagged z
    theta: np.ndarray


def design(y: np.ndarray, x: np.ndarray, use: np.ndarray, t: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Regressors [1, x, lagged z] and z of the rows ``use``, whose lags lie before them in ``y``."""
    def z(lag: int) -> np.ndarray:
        return sum(c * y[use - lag - i] for i, c in enumerate(t.diff) if c) if len(use) else np.zeros(0)
    return np.column_stack([np.ones(len(use)), x[use], *(z(lag) for lag in t.ar)]), z(0)


class Run(NamedTuple):
    """One chunk's sums of products of [derivatives, e], rows used, and the states after it."""
    sums: np.ndarray
    n: int
    one: np.ndarray
    two: np.ndarray


def run(r: np.ndarray, z: np.ndarray, t: Terms, at: Params, one: np.ndarray, two: np.ndarray) -> Run:
    """``one`` is the state of the filtered regressors and of e, ``two`` that of e filtered once more."""
    first = recursion(np.column_stack([r, z - r @ at.linear]), t.ma, -at.theta, one)
    second = recursion(first[:, -1:], t.ma, -at.theta, two)
    past = np.concatenate([two, second])
    k, n = len(two), len(z)
    j = np.column_stack([first[:, :-1], *(past[k - lag:k - lag + n] for lag in t.ma), first[:, -1:]])
    return Run(j.T @ j, n, last_rows(one, first), last_rows(two, second))


def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Gauss-Newton step from the sums of products of [derivatives, e]."""
    scale = np.sqrt(np.diag(sums)[:-1])
    scale[scale == 0] = 1.0
    a = sums[:-1, :-1] / np.outer(scale, scale) + ridge * np.eye(len(scale))
    return np.linalg.lstsq(a, sums[:-1, -1] / scale, rcond=None)[0] / scale


class Search:
    """The steps of one series' fit.  ``at`` is where the next run is wanted, until ``done``."""

    def __init__(self, t: Terms, features: int, ridge: float):
        self.t, self.ridge = t, ridge
        self.split = 1 + features + len(t.ar)
        self.at = self.best = Params(np.zeros(self.split), np.zeros(len(t.ma)))
        self.sse, self.n, self.steps, self.done = np.inf, 0, 0, False
        self.move, self.share = np.zeros(0), 1.0

    def told(self, sums: np.ndarray, n: int) -> None:
        sse, self.n, self.steps = float(sums[-1, -1]), n, self.steps + 1
        if n <= self.split + len(self.t.ma) or not np.isfinite(sums).all():
            self.share /= 2
            self.done = self.steps == 1 or self.share < 1e-6
        elif sse <= self.sse:
            # the first step solves for the linear terms alone, whose residuals start the moving average
            first = self.steps == 1
            self.done = not first and self.sse - sse <= TOLERANCE * sse
            self.best, self.sse, self.share = self.at, sse, 1.0
            if first:
                keep = [*range(self.split), len(sums) - 1]
                self.move = np.concatenate([solve(sums[np.ix_(keep, keep)], self.ridge), np.zeros(len(self.t.ma))])
            else:
                self.move = solve(sums, self.ridge)
        else:
            self.share /= 2
            self.done = self.share < 1e-6
        self.done = self.done or self.steps >= STEPS
        step = self.move * self.share if len(self.move) else np.zeros(self.split + len(self.t.ma))
        self.at = Params(self.best.linear + step[:self.split], self.best.theta + step[self.split:])


def _states(t: Terms, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((t.memory, width)), np.zeros((t.memory, 1))


def _chunk(pdf: pd.DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, Terms]:
    """Regressors, z and terms of a chunk's own rows that have all their lags."""
    pdf = pdf.sort_values(series.POS)
    first = pdf.iloc[0]
    t = terms(*(int(first[c]) for c in ORDER))
    use = np.flatnonzero(pdf[series.OWN].to_numpy() & (pdf[series.POS].to_numpy() >= t.depth))
    return *design(pdf[target].to_numpy(float), pdf[features].to_numpy(float), use, t), t


_FITTED = "n long, intercept double, coef array<double>, phi array<double>, theta array<double>, sigma double, tail_e array<double>, reason string"


def _fitted(pdf_keys: dict, s: Search, n: int, tail: np.ndarray, features: int) -> pd.DataFrame:
    need = s.split + len(s.t.ma)
    short = n <= need
    row = {**pdf_keys, "n": n, "intercept": None, "coef": None, "phi": None, "theta": None, "sigma": None, "tail_e": None,
           "reason": f"{n} rows for {need} terms" if short else None}
    if not short:
        row |= {"intercept": float(s.best.linear[0]), "coef": list(s.best.linear[1:1 + features]), "phi": list(s.best.linear[1 + features:]),
                "theta": list(s.best.theta), "sigma": float(np.sqrt(s.sse / n)), "tail_e": list(tail)}
    return pd.DataFrame([row]).astype({"n": "int64"})


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def order_fit(rows: DataFrame, orders: DataFrame, features: list[str], target: str, keys: list[str], order: str = "date",
              ridge: float = RIDGE, chunk_rows: int = series.CHUNK_ROWS) -> DataFrame:
    """One row per series of ``orders`` (keys, p, d, q, season): its order, rows used, intercept, coefficients by feature, by lag of z and
    by lag of e, residual deviation, the last residuals and values (oldest first), and the reason where it is too short.

    Rows with a NULL in a feature or the target are left out; a NULL key is a key like any other."""
    known = rows.select(*keys, order, target, *features).na.drop(subset=[order, target, *features])
    depth = (F.col("p") + F.col("d")) * F.greatest(F.col("season"), F.lit(1)) + F.col("d")
    reach = orders.agg(F.max(depth)).first()[0] or 0
    base = land(series._with_groups(series.with_position(known, keys, order), orders.select(*keys, *ORDER), keys))
    frames = series.chunked(base, keys, order, int(reach), 0, chunk_rows)
    group = [*keys, *ORDER]
    schema = f"{_types(base, group)}, {_FITTED}"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        r, z, t = _chunk(pdf, features, target)
        s = Search(t, len(features), ridge)
        states = _states(t, r.shape[1] + 1)
        while not s.done:
            got = run(r, z, t, s.at, *states)
            s.told(got.sums, got.n)
        tail = run(r, z, t, s.best, *states).one[:, -1]
        return _fitted({c: pdf[c].iloc[0] for c in group}, s, len(z), tail, len(features))

    long = F.col(series.SIZE) > chunk_rows
    columns = [*group, series.POS, series.OWN, series.CHUNK, target, *features]
    fits = frames.filter(~long).select(*columns).groupBy(*keys, series.CHUNK).applyInPandas(whole, schema)
    if not base.filter(long).isEmpty():
        fits = fits.unionByName(_fit_long(land(frames.filter(long).select(*columns)), features, target, keys, ridge, schema))
    held = F.greatest((F.col("p") + F.col("d")) * F.greatest("season", F.lit(1)) + F.col("d"), F.lit(1))
    tails = base.filter(F.col(series.POS) >= F.col(series.SIZE) - held).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(series.POS, F.col(target).cast("double").alias("y")))).alias("_t")).select(*keys, F.col("_t.y").alias("tail_y"))
    return series._with_groups(land(fits), tails, keys)


def _fit_long(frames: DataFrame, features: list[str], target: str, keys: list[str], ridge: float, schema: str) -> DataFrame:
    """The same fit for series of several chunks.  The searches are one small row per series, kept as bytes between steps."""
    import pickle
    group = [*keys, *ORDER]
    key_types = _types(frames, keys)
    joined = ", ".join(filter(None, [key_types, f"{series.CHUNK} long"]))
    searches = land(frames.groupBy(*group).agg(F.lit(None).cast("binary").alias("search")))
    chunks = land(frames.select(*keys, series.CHUNK).distinct())

    def loaded(value, t: Terms) -> Search:
        return pickle.loads(value) if value is not None else Search(t, len(features), ridge)

    def ahead(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """What a chunk makes of the state before it, and what it adds to it."""
        if not len(pdf) or not len(told):
            return pd.DataFrame()
        r, z, t = _chunk(pdf, features, target)
        s, k = loaded(told["search"].iloc[0], t), t.memory
        got = run(r, z, t, s.at, *_states(t, r.shape[1] + 1))
        unit = np.eye(k)
        passed = recursion(np.zeros((len(z), k)), t.ma, -s.at.theta, unit) if k else np.zeros((len(z), 0))
        twice = recursion(passed, t.ma, -s.at.theta, np.zeros((k, k)))
        out = pickle.dumps((got.one, got.two, last_rows(unit, passed), last_rows(np.zeros((k, k)), twice)))
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in keys}, series.CHUNK: int(pdf[series.CHUNK].iloc[0]), "map": out}])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        """The true state before every chunk of a series, and after the last, from the chunks' maps."""
        pdf, out, at = pdf.sort_values(series.CHUNK), [], None
        for chunk, value in zip(pdf[series.CHUNK], pdf["map"]):
            one, two, keeps, adds = pickle.loads(value)
            at = at or (np.zeros_like(one), np.zeros_like(two))
            out.append(pickle.dumps(at))
            at = keeps @ at[0] + one, keeps @ at[1] + adds @ at[0][:, -1:] + two
        end = pickle.dumps(at)
        return pdf[[*keys, series.CHUNK]].assign(state=out, end=[end] * len(out))

    def again(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(told):
            return pd.DataFrame()
        r, z, t = _chunk(pdf, features, target)
        got = run(r, z, t, loaded(told["search"].iloc[0], t).at, *pickle.loads(told["state"].iloc[0]))
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in keys}, "sums": list(got.sums.ravel()), "n": got.n}])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        s = loaded(first["search"], terms(*(int(first[c]) for c in ORDER)))
        if not s.done:
            size = int(len(first["sums"]) ** 0.5)
            s.told(np.sum(np.stack(list(pdf["sums"])), axis=0).reshape(size, size), int(pdf["n"].sum()))
        if s.done:  # the last pass gives the states of the fit itself
            s.at = s.best
        return pd.DataFrame([{**{c: first[c] for c in group}, "search": pickle.dumps(s), "done": s.done}])

    def passes(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
        told = series._with_groups(chunks, searches.select(*keys, "search"), keys)
        by = [*keys, series.CHUNK]
        maps = frames.groupBy(*by).cogroup(told.groupBy(*by)).applyInPandas(ahead, f"{joined}, map binary")
        before = maps.groupBy(*keys).applyInPandas(states, f"{joined}, state binary, end binary")
        return told, land(before)

    for _ in range(STEPS + 1):
        told, before = passes(searches)
        by = [*keys, series.CHUNK]
        both = series._with_groups(told, before.select(*by, "state"), by)
        sums = frames.groupBy(*by).cogroup(both.groupBy(*by)).applyInPandas(again, f"{', '.join(filter(None, [key_types]))}, sums array<double>, n long")
        searches = land(series._with_groups(sums, searches, keys).groupBy(*group).applyInPandas(step, f"{_types(frames, group)}, search binary, done boolean"))
        if searches.filter(~F.col("done")).isEmpty():
            break
    ends = passes(searches)[1].groupBy(*keys).agg(F.first("end").alias("end"))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                s = pickle.loads(row["search"])
                yield _fitted({c: row[c] for c in group}, s, s.n, pickle.loads(row["end"])[0][:, -1], len(features))

    return series._with_groups(searches, ends, keys).select(*group, "search", "end").mapInPandas(report, schema)


def ahead_weights(t: Terms, phi: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Lags and weights of earlier values of y in the next: one less the product of the lag and difference polynomials."""
    poly = np.zeros(max(t.ar, default=0) + 1)
    poly[0] = 1.0
    for lag, c in zip(t.ar, phi):
        poly[lag] -= c
    product = np.convolve(poly, t.diff)
    lags = [i for i in range(1, len(product)) if product[i]]
    return lags, -product[lags]


def _inputs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """A chunk's inputs to the recursions of forecast and unit shock, the state before the first step, lags and weights."""
    first = pdf.iloc[0]
    t = terms(*(int(first[c]) for c in ORDER))
    lags, weights = ahead_weights(t, np.asarray(first["phi"], float))
    step, theta, tail = pdf[series.POS].to_numpy(), np.asarray(first["theta"], float), np.asarray(first["tail_e"], float)
    g, shock = pdf["_g"].to_numpy(float).copy(), (step == 0).astype(float)
    for lag, c in zip(t.ma, theta):
        known = step < lag
        g[known] += c * tail[len(tail) + step[known] - lag]
        shock[step == lag] += c
    k = max(lags, default=0)
    y = np.asarray(first["tail_y"], float)
    state = np.column_stack([y[len(y) - k:], np.zeros(k)])
    return np.column_stack([g, shock]), state, lags, weights


def order_forecasts(rows: DataFrame, models: DataFrame, features: list[str], keys: list[str], order: str = "date", out: str = "pred",
                    z: float = NORMAL_95, chunk_rows: int = series.CHUNK_ROWS) -> DataFrame:
    """Forecasts of all ``rows`` of a series as the steps after its last training row, with the interval of each step.

    Adds ``step`` (from 1), the forecast, ``lower`` and ``upper``.  Series without a fit are left out; the models have their reasons."""
    import pickle
    fitted = models.filter(F.col("reason").isNull())
    value = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.col(f) * F.col("coef")[i]
    wanted = rows.na.drop(subset=[order, *features])
    placed = land(series.with_position(wanted, keys, order))
    model = fitted.select(*keys, *ORDER, "intercept", "coef", "phi", "theta", "sigma", "tail_e", "tail_y")
    steps = series._with_groups(placed.select(*keys, order, *features, series.POS, series.SIZE), model, keys).withColumn("_g", value) \
        .select(*keys, order, *ORDER, "phi", "theta", "tail_e", "tail_y", "sigma", "_g", series.POS, series.SIZE)
    frames = series.chunked(steps, keys, order, 0, 0, chunk_rows)
    kept = [*keys, order, series.POS, series.CHUNK, "sigma"]
    schema = f"{_types(frames, kept)}, pred double, shock double"

    def done(pdf: pd.DataFrame, state: np.ndarray | None) -> pd.DataFrame:
        pdf = pdf.sort_values(series.POS)
        inputs, start, lags, weights = _inputs(pdf)
        got = recursion(inputs, lags, weights, start if state is None else state)
        return pdf[kept].assign(pred=got[:, 0], shock=got[:, 1])

    long = F.col(series.SIZE) > chunk_rows
    by = [*keys, series.CHUNK]
    made = frames.filter(~long).groupBy(*by).applyInPandas(lambda pdf: done(pdf, None), schema)
    if not placed.filter(long).isEmpty():
        parts = land(frames.filter(long))

        def ahead(pdf: pd.DataFrame) -> pd.DataFrame:
            inputs, start, lags, weights = _inputs(pdf.sort_values(series.POS))
            k = len(start)
            added = last_rows(np.zeros((k, 2)), recursion(inputs, lags, weights, np.zeros((k, 2))))
            passed = last_rows(np.eye(k), recursion(np.zeros((len(inputs), k)), lags, weights, np.eye(k))) if k else np.zeros((0, 0))
            return pdf[by].iloc[:1].assign(map=[pickle.dumps((start, added, passed))])

        def states(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, at, before = pdf.sort_values(series.CHUNK), None, []
            for value in pdf["map"]:
                start, added, passed = pickle.loads(value)
                at = start if at is None else at
                before.append(pickle.dumps(at))
                at = passed @ at + added
            return pdf[by].assign(state=before)

        told = ", ".join(filter(None, [_types(frames, by)]))
        before = parts.groupBy(*by).applyInPandas(ahead, f"{told}, map binary").groupBy(*keys).applyInPandas(states, f"{told}, state binary")
        made = made.unionByName(parts.groupBy(*by).cogroup(land(before).groupBy(*by)).applyInPandas(
            lambda pdf, told: done(pdf, pickle.loads(told["state"].iloc[0])), schema))
    spread = series.running(land(made), keys, [series.CHUNK], [series.POS], {"_var": F.col("shock") * F.col("shock")})
    half = z * F.col("sigma") * F.sqrt("_var")
    told = spread.select(*keys, F.col(order), (F.col(series.POS) + 1).alias("step"), F.col("pred").alias(out),
                         (F.col("pred") - half).alias("lower"), (F.col("pred") + half).alias("upper"))
    return series._with_groups(placed.drop(series.POS, series.SIZE), told, [*keys, order])


def next_value(last: DataFrame, models: DataFrame, features: list[str], keys: list[str], out: str = "pred") -> DataFrame:
    """The first step after the training rows with the features of ``last`` (one row per series), as the reference flow gives its future point."""
    return order_forecasts(last, models, features, keys, out=out)

