"""Feature selection, model fitting, scoring and forecasts as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.functions import text
from marketframe.operators import linear, select, trees
from marketframe.operators.enrich import basic_stock_data
from marketframe.operators.evaluate import classification_metrics, regression_metrics, roc_auc
from marketframe.operators.landing import land
from marketframe.plans.catalog import query, rnd, sql_rnd
from marketframe.plans.features import feature_table
from marketframe.plans.indicator_queries import T20_FLAGS, T20_NAMES
from marketframe.plans.inputs import CTES, HORIZON
from marketframe.sources import tables

FEATURES = T20_NAMES
_PAIR = ["momentum_30", "rsi"]
_LOW = trees.grid("LOW")

CTES["t20_rows"] = f"""
SELECT * FROM feat_all JOIN ({T20_FLAGS}) f USING (symbol)
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in T20_NAMES + ['log_return_1', 'log_return_future'])} AND t_stat < -2.86"""


def _rows(t):
    """The feature table, landed once for the passes of a fit."""
    return land(feature_table(land(basic_stock_data(t.bars, t.index_bars, t.macro)), HORIZON))


def _scaled_split(rows):
    """Features scaled by the training rows of their symbol, with the split flag."""
    named = rows.select("symbol", "date", F.col("close").alias("price"), *FEATURES, "log_return_future", "target")
    split = select.chronological_split(named)
    fitted = select.scaler(split.filter("is_train"), FEATURES)
    return land(select.scaled(split, fitted, FEATURES))


def _with_price(scored):
    """The bars' own close in the place of the scaled feature."""
    return scored.withColumn("close", F.col("price")).drop("price")


# a symbol with one row has no correlation; corr() there is NaN, which DuckDB orders above every number
@query("m6_correlated_features", f"""
WITH c AS (SELECT symbol, {', '.join(f'corr({a}, {b}) AS c_{a}__{b}' for j, b in enumerate(FEATURES) for a in FEATURES[:j])} FROM t20_rows GROUP BY symbol)
""" + " UNION ALL ".join(
    f"SELECT symbol, '{b}' AS feature, {' OR '.join(f'coalesce(abs(c_{a}__{b}) > 0.95 AND NOT isnan(c_{a}__{b}), false)' for a in FEATURES[:j])} AS dropped FROM c"
    for j, b in enumerate(FEATURES) if j))
def _m6(t):
    return select.correlated_features(_rows(t), FEATURES)


@query("m7_oversample")
def _m7(t):
    s = _scaled_split(_rows(t)).filter("is_train")
    return trees.oversample(s, FEATURES)


@query("m8_regression_importance")
def _m8(t):
    return trees.regression_importance(_rows(t), FEATURES)


@query("m9_classification_importance")
def _m9(t):
    return trees.classification_importance(_rows(t), FEATURES)


@query("m10_classifier")
def _m10(t):
    s = _scaled_split(_rows(t))
    model = trees.train_classifier(s.filter("is_train"), FEATURES, _LOW[0])
    scored = trees.classify(model, s.filter(~F.col("is_train")), FEATURES)
    return classification_metrics(scored, ["symbol"], "target", "pred_label")


@query("m11_grid_search")
def _m11(t):
    return trees.grid_search(_scaled_split(_rows(t)).filter("is_train").drop("is_train"), FEATURES, _LOW)


# three unknowns: with fewer than three rows no fit is the one solution, so none is shown
@query("m12_linear_two_features", f"""
WITH s AS (SELECT symbol, count(*) AS n, avg(log_return_future) AS my, avg(momentum_30) AS m1, avg(rsi) AS m2, var_pop(momentum_30) AS v1, var_pop(rsi) AS v2,
    covar_pop(momentum_30, rsi) AS c12, covar_pop(momentum_30, log_return_future) AS c1y, covar_pop(rsi, log_return_future) AS c2y FROM t20_rows GROUP BY symbol),
 b AS (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM s)
SELECT symbol, n, CASE WHEN n > 2 THEN {sql_rnd('b1')} END AS b1, CASE WHEN n > 2 THEN {sql_rnd('b2')} END AS b2,
  CASE WHEN n > 2 THEN {sql_rnd('my - b1 * m1 - b2 * m2')} END AS intercept FROM b""")
def _m12(t):
    m = linear.fit(_rows(t), ["momentum_30", "rsi"], "log_return_future", ridge=0.0)
    unique = F.col("n") > 2
    return m.select("symbol", "n", F.when(unique, rnd(F.col("coef")[0])).alias("b1"), F.when(unique, rnd(F.col("coef")[1])).alias("b2"),
                    F.when(unique, rnd("intercept")).alias("intercept"))


def _fitted(t):
    s = _scaled_split(_rows(t))
    return s, linear.fit(s.filter("is_train"), FEATURES, "log_return_future")


@query("m12_linear_coefficients")
def _m12c(t):
    return linear.coefficients(_fitted(t)[1], FEATURES)


@query("m13_order_search")
def _m13(t):
    return linear.order_search(_scaled_split(_rows(t)).filter("is_train"), FEATURES, "log_return_future", 30, "MEDIUM")


def _forecasts(t):
    s, models = _fitted(t)
    return _with_price(linear.predict(s, models, FEATURES))


@query("m14_batch_scoring")
def _m14(t):
    requests = t.bars.groupBy("symbol").agg(F.max("date").alias("input_date"))
    return linear.score_dates(_forecasts(t), requests, HORIZON)


@query("m15_future_price")
def _m15(t):
    return linear.future_point(_forecasts(t), HORIZON)


@query("m15_future_class")
def _m15c(t):
    s = _scaled_split(_rows(t))
    model = trees.train_classifier(s.filter("is_train"), FEATURES, _LOW[0])
    return linear.future_class(_with_price(trees.classify(model, s, FEATURES)), HORIZON, F.col("proba"))


# -- two features: the closed solution tells what scoring must give ---------------------------------

CTES["pair_rows"] = """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) <= floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS is_train FROM t20_rows"""
CTES["pair_fit"] = """
WITH s AS (SELECT symbol, count(*) AS n, avg(log_return_future) AS my, avg(momentum_30) AS m1, avg(rsi) AS m2, var_pop(momentum_30) AS v1, var_pop(rsi) AS v2,
    covar_pop(momentum_30, rsi) AS c12, covar_pop(momentum_30, log_return_future) AS c1y, covar_pop(rsi, log_return_future) AS c2y
  FROM pair_rows WHERE is_train GROUP BY symbol HAVING count(*) > 3),
 b AS (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM s)
SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM b"""
CTES["pair_scored"] = """
SELECT r.*, b0 + b1 * momentum_30 + b2 * rsi AS pred FROM pair_rows r JOIN pair_fit USING (symbol)"""
CTES["pair_usable"] = f"""
SELECT *, lag(pred, {HORIZON}) OVER (PARTITION BY symbol ORDER BY date) AS usable FROM pair_scored"""


def _pair(t):
    """Rows with the forecast of a fit of two features on the first 80 % of each symbol."""
    split = land(select.chronological_split(_rows(t)))
    models = linear.fit(split.filter("is_train"), _PAIR, "log_return_future", ridge=0.0).filter("n > 3")
    return land(linear.predict(split, models, _PAIR)), models


@query("m12_pair_coefficients", f"""
SELECT symbol, 'momentum_30' AS feature, {sql_rnd('b1')} AS coef FROM pair_fit UNION ALL SELECT symbol, 'rsi', {sql_rnd('b2')} FROM pair_fit""")
def _m12p(t):
    return linear.coefficients(_pair(t)[1], _PAIR).withColumn("coef", rnd("coef"))


@query("m14_pair_scoring", f"""
WITH d AS (SELECT symbol, max(date) AS input_date FROM bars GROUP BY symbol),
 days AS (SELECT symbol, input_date, CAST(unnest(generate_series(CAST(input_date - 60 AS TIMESTAMP), CAST(input_date + {HORIZON} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
 work AS (SELECT * FROM days WHERE isodow(date) < 6),
 probes AS (SELECT symbol, input_date, date FROM work WHERE date > input_date
   UNION SELECT symbol, input_date, date FROM work WHERE date <= input_date QUALIFY row_number() OVER (PARTITION BY symbol, input_date ORDER BY date DESC) <= {HORIZON}
   UNION SELECT symbol, input_date, date FROM work WHERE date = input_date)
SELECT p.symbol, p.input_date, p.date, u.close AS last_known_price, {sql_rnd('u.close * exp(u.usable)', 4)} AS predicted_price
FROM probes p ASOF LEFT JOIN pair_usable u ON p.symbol = u.symbol AND p.date - {HORIZON} >= u.date""")
def _m14p(t):
    requests = t.bars.groupBy("symbol").agg(F.max("date").alias("input_date"))
    out = linear.score_dates(_pair(t)[0], requests, HORIZON)
    return out.select("symbol", "input_date", "date", "last_known_price", rnd("predicted_price", 4).alias("predicted_price"))


@query("m15_pair_price", f"""
SELECT symbol, max(date) + {HORIZON} AS date, arg_max(close, date) AS last_known_price, {sql_rnd('arg_max(close * exp(usable), date)', 4)} AS predicted_price
FROM pair_usable GROUP BY symbol""")
def _m15p(t):
    return linear.future_point(_pair(t)[0], HORIZON).withColumn("predicted_price", rnd("predicted_price", 4))


@query("m17_pair_interval", f"""
WITH e AS (SELECT symbol, sqrt(avg((log_return_future - pred) ** 2)) AS sigma FROM pair_scored WHERE is_train GROUP BY symbol)
SELECT symbol, date, {sql_rnd('pred')} AS pred, {sql_rnd('pred - 1.96 * sigma')} AS lower, {sql_rnd('pred + 1.96 * sigma')} AS upper
FROM pair_scored JOIN e USING (symbol) WHERE NOT is_train""")
def _m17p(t):
    rows = linear.with_interval(_pair(t)[0].filter(~F.col("is_train")))
    return rows.select("symbol", "date", *[rnd(c).alias(c) for c in ("pred", "lower", "upper")])


@query("e1_pair_metrics", f"""
SELECT symbol, count(*) AS n, {sql_rnd('sqrt(avg((log_return_future - pred) ** 2))')} AS rmse, {sql_rnd('avg(abs(log_return_future - pred))')} AS mae
FROM pair_scored WHERE NOT is_train GROUP BY symbol""")
def _e1p(t):
    """The metrics of a model's own forecasts."""
    got = regression_metrics(_pair(t)[0].filter(~F.col("is_train")), ["symbol"], "log_return_future", "pred")
    return got.select("symbol", "n", rnd("rmse").alias("rmse"), rnd("mae").alias("mae"))


# -- training as one flow ----------------------------------------------------------------------------

@query("m10_training_flow")
def _m10f(t):
    """Split, scale, search, oversample, fit again, score the held-out rows, and the registry with each symbol's model row put in."""
    s = _scaled_split(_rows(t))
    train = s.filter("is_train")
    best = trees.grid_search(train.drop("is_train"), FEATURES, _LOW).filter("best").first()
    made = trees.oversample(train, FEATURES).select("symbol", *FEATURES, "target")
    model = trees.train_classifier(train.select("symbol", *FEATURES, "target").unionByName(made), FEATURES, best.asDict())
    scored = land(_with_price(trees.classify(model, s, FEATURES)))
    test = scored.filter(~F.col("is_train"))
    figures = classification_metrics(test, ["symbol"], "target", "pred_label").join(roc_auc(test, ["symbol"], "target", "proba"), "symbol")
    points = test.select("symbol", "date", F.col("pred_label").alias("predicted_movement"), F.col("target").alias("actual_movement"), "proba")
    rows = figures.join(text.predictions_json(points, ["symbol"], "date", ["predicted_movement", "actual_movement", "proba"]), "symbol") \
        .join(linear.future_class(scored, HORIZON, F.col("proba")).withColumnRenamed("date", "prediction_date"), "symbol") \
        .withColumn("model_key", F.concat(F.lit("GBT_"), "symbol"))
    known = rows.filter("symbol < 'Brand#3'").withColumn("f1", F.lit(-1.0))
    return tables.upsert(known, rows, ["model_key"], ["prediction_date"])


@query("m16_naive_forecast", f"SELECT symbol, {sql_rnd('arg_max(close, date) * 1.05')} AS predicted_price FROM bars GROUP BY symbol")
def _m16(t):
    return linear.naive_forecast(t.bars).withColumn("predicted_price", rnd("predicted_price"))


@query("m17_prediction_interval")
def _m17(t):
    return linear.with_interval(_forecasts(t).filter(~F.col("is_train"))).select("symbol", "date", "pred", "lower", "upper")
