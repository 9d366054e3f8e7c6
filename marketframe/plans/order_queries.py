"""Fits at an order, their forecasts, and price training as registered queries.

The order (1, 0, 0) without features is a regression on the value before, whose fit, forecasts and intervals have closed forms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.operators import select
from marketframe.operators.landing import land
from marketframe.plans import price_training as pt
from marketframe.plans.catalog import query, rnd, sql_rnd
from marketframe.plans.inputs import CTES, HORIZON
from marketframe.plans.model_queries import FEATURES, _rows, _scaled_split
from marketframe.sources import tables

CTES["order_lag"] = """
SELECT *, lag(log_return_future) OVER (PARTITION BY symbol ORDER BY date) AS y1 FROM pair_rows WHERE is_train"""
CTES["order_coef"] = """
SELECT symbol, count(*) AS n, regr_slope(log_return_future, y1) AS phi, regr_intercept(log_return_future, y1) AS c,
  sqrt(greatest(regr_syy(log_return_future, y1) - regr_slope(log_return_future, y1) * regr_sxy(log_return_future, y1), 0) / count(*)) AS sigma
FROM order_lag WHERE y1 IS NOT NULL GROUP BY symbol HAVING count(*) > 2"""
CTES["order_path"] = """
WITH t AS (SELECT symbol, arg_max(log_return_future, date) AS y0 FROM pair_rows WHERE is_train GROUP BY symbol),
 s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS step FROM pair_rows WHERE NOT is_train)
SELECT s.symbol, s.date, s.close, s.log_return_future, s.step, c * (1 - pow(phi, step)) / (1 - phi) + pow(phi, step) * y0 AS pred,
  1.96 * sigma * sqrt((1 - pow(phi, 2 * step)) / (1 - phi * phi)) AS half
FROM s JOIN order_coef USING (symbol) JOIN t USING (symbol)"""
CTES["order_figures"] = """
SELECT symbol, count(*) AS n, sqrt(avg((log_return_future - pred) ** 2)) AS rmse, avg(abs(log_return_future - pred)) AS mae FROM order_path GROUP BY symbol"""
CTES["order_next"] = f"""
WITH l AS (SELECT symbol, max(date) AS last_date, arg_max(close, date) AS price FROM pair_rows GROUP BY symbol),
 t AS (SELECT symbol, arg_max(log_return_future, date) AS y0 FROM pair_rows WHERE is_train GROUP BY symbol)
SELECT symbol, last_date + {HORIZON} AS prediction_date, price, price * exp(c + phi * y0) AS predicted FROM l JOIN t USING (symbol) JOIN order_coef USING (symbol)"""


def _closed(t) -> pt.Trained:
    """Price training at the order (1, 0, 0), without features."""
    rows = land(select.chronological_split(_rows(t)).withColumn("price", F.col("close")))
    return pt.price_training(rows, pt.same_order(rows, 1, 0, 0, 0), [], HORIZON, "LOW", ridge=0.0)


@query("m12_order_fit", f"""
SELECT symbol, n, {sql_rnd('c')} AS intercept, {sql_rnd('phi')} AS phi, {sql_rnd('sigma')} AS sigma FROM order_coef""")
def _m12o(t):
    return _closed(t).models.filter("reason IS NULL").select(
        "symbol", "n", rnd("intercept").alias("intercept"), rnd(F.col("phi")[0]).alias("phi"), rnd("sigma").alias("sigma"))


@query("m17_order_interval", f"""
SELECT symbol, date, step, {sql_rnd('pred')} AS pred, {sql_rnd('pred - half')} AS lower, {sql_rnd('pred + half')} AS upper FROM order_path""")
def _m17o(t):
    return _closed(t).forecasts.select("symbol", "date", "step", *[rnd(c).alias(c) for c in ("pred", "lower", "upper")])


@query("e1_order_metrics", f"""
SELECT symbol, n, {sql_rnd('rmse')} AS rmse, {sql_rnd('mae')} AS mae FROM order_figures""")
def _e1o(t):
    return _closed(t).figures.select("symbol", "n", rnd("rmse").alias("rmse"), rnd("mae").alias("mae"))


@query("f13_order_predictions", f"""
SELECT symbol, date, {sql_rnd('close * exp(log_return_future)', 4)} AS actual_price, {sql_rnd('close * exp(pred)', 4)} AS predicted_price FROM order_path
UNION ALL SELECT symbol, prediction_date, NULL, {sql_rnd('predicted', 4)} FROM order_next SEMI JOIN order_figures USING (symbol)""")
def _f13o(t):
    """What the registry's JSON holds, read back."""
    read = F.from_json("predictions_json", "map<string, struct<actual_price: double, predicted_price: double>>")
    return _closed(t).registry.select("symbol", F.explode(read).alias("date", "p")).select(
        "symbol", F.col("date").cast("date").alias("date"), *[rnd(F.col(f"p.{c}"), 4).alias(c) for c in ("actual_price", "predicted_price")])


@query("r1_order_registry", f"""
SELECT 'ARX_' || symbol || '_basic_LOW_{HORIZON}' AS model_key, symbol, prediction_date, {sql_rnd('rmse')} AS prediction_rmse, {sql_rnd('1 / (1 + rmse)')} AS confidence,
  price AS last_known_price, {sql_rnd('predicted', 4)} AS predicted_amount FROM order_figures JOIN order_next USING (symbol)""")
def _r1o(t):
    """The registry after a batch that brings some models anew."""
    rows = land(_closed(t).registry.select("model_key", "symbol", "prediction_date", rnd("prediction_rmse").alias("prediction_rmse"),
                                           rnd("prediction_confidence_score").alias("confidence"), "last_known_price", rnd("predicted_amount", 4).alias("predicted_amount")))
    known = rows.filter("symbol < 'Brand#3'").withColumn("prediction_rmse", F.lit(-1.0))
    return tables.upsert(known, rows, ["model_key"], ["prediction_date"])


@query("m13_price_flow")
def _m13f(t):
    """Search, fit at the winner, forecasts, metrics and registry rows with all features."""
    rows = _scaled_split(_rows(t))
    orders = land(pt.chosen_orders(rows.filter("is_train"), FEATURES, 30, "MEDIUM"))
    return pt.price_training(rows, orders, FEATURES, HORIZON, "MEDIUM").registry
