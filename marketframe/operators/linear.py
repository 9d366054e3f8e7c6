"""Per-symbol linear models with lagged terms, fitted from sums of products."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.scalars import price_from_return, scoring_dates
from marketframe.operators import series
from marketframe.operators.asof import asof_join
from marketframe.operators.gram import gram, moments
from marketframe.operators.landing import land
from marketframe.operators.reports import actual_movement
from marketframe.operators.select import fold_block

KEYS = ["symbol"]
RIDGE = 1e-6
NORMAL_95 = 1.96

# Largest order tried per tuning level.
MAX_ORDER = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
SEASON_DAYS = 7
# terms of the first regression whose residuals stand in for the moving-average part
LONG_AR = 5


def solve(g: np.ndarray, ridge: float) -> tuple[np.ndarray, float, float]:
    """Coefficients, intercept and residual deviation from the sums of [1, features, target]."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    dev[dev <= 1e-12 * (1 + np.abs(mean[:-1]))] = 1.0
    corr = cov[:-1, :-1] / np.outer(dev, dev)
    rhs = cov[:-1, -1] / dev
    beta = np.linalg.lstsq(corr + ridge * np.eye(len(dev)), rhs, rcond=None)[0] / dev
    left = cov[-1, -1] - 2 * beta @ cov[:-1, -1] + beta @ cov[:-1, :-1] @ beta
    return beta, float(mean[-1] - beta @ mean[:-1]), float(np.sqrt(max(left, 0.0)))


def fit(rows: DataFrame, features: list[str], target: str, keys: list[str] = KEYS, ridge: float = RIDGE) -> DataFrame:
    """One row per group: coefficients in feature order, intercept, residual deviation, rows used."""
    k = len(features) + 1
    fitted = moments(rows, [*features, target], keys)

    def solve_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [solve(gram(n, np.asarray(m), k), ridge) for n, m in zip(pdf["n"], pdf["m"])]
            yield pdf[[*keys, "n"]].assign(coef=[list(b) for b, _, _ in out], intercept=[c for _, c, _ in out],
                                           sigma=[s for _, _, s in out])
    types = ", ".join(f"{k} {fitted.schema[k].dataType.simpleString()}" for k in keys)
    return fitted.mapInPandas(solve_rows, f"{types}{', ' if types else ''}n long, coef array<double>, intercept double, sigma double")


def coefficients(models: DataFrame, features: list[str], keys: list[str] = KEYS) -> DataFrame:
    """One row per group and feature."""
    names = F.array(*[F.lit(f) for f in features])
    return models.select(*keys, F.inline(F.arrays_zip(names.alias("feature"), F.col("coef").alias("coef"))))


def predict(rows: DataFrame, models: DataFrame, features: list[str], keys: list[str] = KEYS, out: str = "pred", how: str = "inner") -> DataFrame:
    value = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.col(f) * F.col("coef")[i]
    return rows.join(models.select(*keys, "coef", "intercept", "sigma"), keys, how).withColumn(out, value).drop("coef", "intercept")


def with_interval(predicted: DataFrame, pred: str = "pred", z: float = NORMAL_95) -> DataFrame:
    """95 % interval from the residual deviation of the fit."""
    half = z * F.col("sigma")
    return predicted.withColumns({"lower": F.col(pred) - half, "upper": F.col(pred) + half})


def _orders(tuning: str, seasons: list[int]) -> list[tuple[int, int, int, int]]:
    if tuning not in MAX_ORDER:
        raise ValueError(f"Invalid hyperparameter_tuning: {tuning}")
    span = range(MAX_ORDER[tuning] + 1)
    return [(p, d, q, s) for p, d, q in itertools.product(span, span, span) for s in seasons]


def _difference(d: int, s: int) -> dict[int, float]:
    """Weights by lag of d ordinary and d seasonal differences."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
        seasonal = np.zeros(s + 1)
        seasonal[0], seasonal[s] = 1.0, -1.0
        poly = np.convolve(poly, seasonal)
    return {i: float(c) for i, c in enumerate(poly) if c}


def _terms(order: tuple[int, int, int, int]) -> tuple[list[dict[int, float]], list[int]]:
    """The differenced target and its lagged terms as weights on lags of y, and the residual lags."""
    p, d, q, s = order
    base = _difference(d, s)
    lags = sorted({0, *range(1, p + 1), *[s * i for i in range(1, p + 1)]})
    return ([{lag + j: c for j, c in base.items()} for lag in lags],
            sorted({*range(1, q + 1), *[s * i for i in range(1, q + 1)]}))


def order_search(rows: DataFrame, features: list[str], target: str, horizon: int, tuning: str = "MEDIUM",
                 splits: int = 3, keys: list[str] = KEYS, order: str = "date") -> DataFrame:
    """Mean RMSE over expanding folds of every order (p, d, q) and season, per symbol; ``best`` marks the winner.

    An order is fitted on the rows that have its own lags, whatever deeper lags other orders want.  Every symbol has a
    row for every order; ``rmse`` is NULL, with the reason, where some fold is too short for it.

    All orders are linear in the same lags, so one pass adds up the products per symbol
    and fold block; every fit is then a small solve on those sums.  The moving-average
    part uses lagged residuals of a first regression with a few lags.
    """
    seasons = list(dict.fromkeys([SEASON_DAYS, horizon]))
    orders = _orders(tuning, seasons)
    y_lags = sorted({lag for o in orders for term in _terms(o)[0] for lag in term})
    e_lags = sorted({lag for o in orders for lag in _terms(o)[1]})
    need = [*keys, order, target, *features]
    base = land(series.with_position(rows.select(*need).na.drop(), keys, order))
    w = series.chunk_window(keys)
    reach = max([*y_lags, *e_lags, LONG_AR])
    if e_lags:
        ar = series.chunked(base, keys, order, LONG_AR).withColumns(
            {f"_ar{i}": F.lag(target, i).over(w) for i in range(1, LONG_AR + 1)})
        ar = land(series.own_rows(ar, keep=(series.POS, series.SIZE)))
        first = [*features, *[f"_ar{i}" for i in range(1, LONG_AR + 1)]]
        head = ar.filter(F.col(series.POS) < F.col(series.SIZE) / (splits + 1))
        models = fit(head, first, target, keys)
        base = predict(ar, models, first, keys, "_fit", "left").withColumn("_e", F.coalesce(F.col(target) - F.col("_fit"), F.lit(0.0)))
        base = base.drop("_fit", "sigma", *[f"_ar{i}" for i in range(1, LONG_AR + 1)])
    depth = {o: max([0, *(lag for term in _terms(o)[0] for lag in term), *_terms(o)[1]]) for o in orders}
    depths = sorted(set(depth.values()))
    # a row serves the orders no deeper than its place in the series; a lag it lacks is not read by these
    lagged = series.chunked(base, keys, order, reach).withColumns({
        **{f"_y{i}": (F.coalesce(F.lag(target, i).over(w), F.lit(0.0)) if i else F.col(target)) for i in y_lags},
        **{f"_e{i}": F.coalesce(F.lag("_e", i).over(w), F.lit(0.0)) for i in e_lags}, "_fold": fold_block(splits),
        "_serves": sum((F.col(series.POS) >= d).cast("int") for d in depths)})
    columns = [*features, *[f"_y{i}" for i in y_lags], *[f"_e{i}" for i in e_lags]]
    sums = moments(series.own_rows(lagged), columns, [*keys, "_fold", "_serves"])
    at = {c: i + 1 for i, c in enumerate(columns)}
    size = len(columns)

    def matrix(o):
        """Rows of [1, features, AR terms, residual lags, target] over the summed columns."""
        y_terms, e_terms = _terms(o)
        out = [np.eye(size + 1)[0], *[np.eye(size + 1)[at[f]] for f in features]]
        lin = []
        for term in y_terms:
            r = np.zeros(size + 1)
            for lag, c in term.items():
                r[at[f"_y{lag}"]] += c
            lin.append(r)
        return np.array([*out, *lin[1:], *[np.eye(size + 1)[at[f"_e{i}"]] for i in e_terms], lin[0]])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        """A few rows of sums come in per fold, whatever the length of the series."""
        found = [(int(f), int(s), gram(n, np.asarray(m), size)) for f, s, n, m in zip(pdf["_fold"], pdf["_serves"], pdf["n"], pdf["m"])]
        result = []
        for o in orders:
            t, errors, reason = matrix(o), [], None
            usable = [(f, g) for f, s, g in found if s > depths.index(depth[o])]
            for fold in range(1, splits + 1):
                train = sum((g for f, g in usable if f < fold), np.zeros((size + 1, size + 1)))
                test = sum((g for f, g in usable if f == fold), np.zeros((size + 1, size + 1)))
                if train[0, 0] < len(t) or not test[0, 0]:
                    reason = f"fold {fold} has {int(train[0, 0])} training and {int(test[0, 0])} test rows for {len(t) - 1} terms"
                    break
                beta, const, _ = solve(t @ train @ t.T, RIDGE)
                a = np.array([-const, *(-beta), 1.0])
                test = t @ test @ t.T
                errors.append(float(np.sqrt(max(a @ test @ a, 0.0) / test[0, 0])))
            result.append((*o, None if reason else float(np.mean(errors)), reason))
        out = pd.DataFrame(result, columns=["p", "d", "q", "season", "rmse", "reason"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        best = out["rmse"].astype(float).idxmin() if out["rmse"].notna().any() else -1
        return out.assign(best=out.index == best)
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    found = sums.groupBy(*keys).applyInPandas(search, f"{types}, p int, d int, q int, season int, rmse double, reason string, best boolean")
    names = ["p", "d", "q", "season"]
    every = rows.select(*keys).distinct().select(*keys, F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, o)]) for o in orders])))
    return every.join(found, [*keys, *names], "left").select(
        *keys, *names, "rmse", F.when(F.col("best").isNull(), F.lit("no complete rows")).otherwise(F.col("reason")).alias("reason"),
        F.coalesce("best", F.lit(False)).alias("best"))


def score_dates(predicted: DataFrame, requests: DataFrame, horizon: int, mode: str = "reference") -> DataFrame:
    """Prices for the last ``horizon`` weekdays before each request's date and the days after it.

    ``predicted`` has one forecast return per bar, made once.  A date is scored from the bar at or
    before ``horizon`` days earlier; in ``reference`` mode with the forecast ``horizon`` rows before that bar.
    """
    rows = _with_usable_forecast(predicted, horizon, mode).select(
        "symbol", F.col("date").alias("_bar"), F.col("close").alias("last_known_price"), "_usable")
    probes = requests.select("symbol", "input_date", F.explode(scoring_dates(F.col("input_date"), F.lit(horizon))).alias("date"))
    probes = probes.withColumn("_due", F.date_sub("date", horizon))
    out = asof_join(probes, rows, ["symbol"], "_due", "_bar", ["last_known_price", "_usable"])
    return out.withColumn("predicted_price", price_from_return(F.col("last_known_price"), F.col("_usable"))).drop("_due", "_usable")


def score_classes(scored: DataFrame, bars: DataFrame, requests: DataFrame, horizon: int, mode: str = "reference") -> DataFrame:
    """Direction and probability for the dates of ``score_dates``, with the price and the movement that followed.

    ``scored`` has ``pred_label`` and ``proba`` per bar.  A date without a bar has no price and no movement, and the movement is
    NULL while no bar lies ``horizon`` days later."""
    told = scored.select("symbol", "date", F.struct("pred_label", "proba").alias("pred"))
    rows = _with_usable_forecast(told, horizon, mode).select(
        "symbol", F.col("date").alias("_bar"), F.col("_usable.pred_label").alias("predicted_movement"), F.col("_usable.proba").alias("prediction_probability"))
    probes = requests.select("symbol", "input_date", F.explode(scoring_dates(F.col("input_date"), F.lit(horizon))).alias("date"))
    out = asof_join(probes.withColumn("_due", F.date_sub("date", horizon)), rows, ["symbol"], "_due", "_bar", ["predicted_movement", "prediction_probability"])
    followed = actual_movement(bars, horizon).select("symbol", "date", F.col("close").alias("actual_price"), "actual_movement")
    return out.drop("_due").join(followed, ["symbol", "date"], "left")


def _with_usable_forecast(predicted: DataFrame, horizon: int, mode: str) -> DataFrame:
    if mode == "corrected":
        return predicted.withColumn("_usable", F.col("pred"))
    if mode != "reference":
        raise ValueError(f"mode {mode!r}")
    c = series.chunked(predicted, KEYS, "date", horizon)
    return series.own_rows(c.withColumn("_usable", F.lag("pred", horizon).over(series.chunk_window(KEYS))))


def future_point(predicted: DataFrame, horizon: int, mode: str = "reference") -> DataFrame:
    """Each symbol's next price, ``horizon`` days after its last bar."""
    rows = _with_usable_forecast(predicted, horizon, mode)
    last = rows.groupBy("symbol").agg(F.max("date").alias("_d"), F.max_by(F.struct("close", "_usable"), "date").alias("_r"))
    return last.select("symbol", F.date_add("_d", horizon).alias("date"), F.col("_r.close").alias("last_known_price"),
                       price_from_return(F.col("_r.close"), F.col("_r._usable")).alias("predicted_price"))


def naive_forecast(bars: DataFrame, factor: float = 1.05) -> DataFrame:
    """Last close of each symbol, 5 % up."""
    return bars.groupBy("symbol").agg((F.max_by("close", "date") * factor).alias("predicted_price"))


def future_class(scored: DataFrame, horizon: int, probability: Column) -> DataFrame:
    """Each symbol's next direction and its probability, from its last scored row."""
    last = scored.withColumn("_p", probability).groupBy("symbol").agg(
        F.max("date").alias("_d"), F.max_by(F.struct("close", "_p"), "date").alias("_r"))
    return last.select("symbol", F.date_add("_d", horizon).alias("date"), F.col("_r.close").alias("last_known_price"),
                       F.col("_r._p").alias("prediction_probability"),
                       F.when(F.col("_r._p") > 0.5, "Up").otherwise("Down").alias("predicted_movement"))
