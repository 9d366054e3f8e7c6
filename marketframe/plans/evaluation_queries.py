"""Aggregates, metrics, back-tests and splits as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.operators import backtest as bt
from marketframe.operators import evaluate as ev
from marketframe.operators import reports, select
from marketframe.operators.landing import land
from marketframe.functions import text
from marketframe.plans.catalog import query, rnd, sql_rnd
from marketframe.plans.inputs import CTES, HORIZON
from marketframe.plans.join_queries import outcomes

CTES["trades_up"] = "SELECT * FROM move_returns WHERE movement = 'Up'"
CTES["move_returns"] = """
SELECT *, CAST(pd = ad AS INT) AS correct_direction FROM (
  SELECT *, CASE WHEN movement = 'Up' THEN 1 ELSE -1 END AS pd, CASE WHEN actual_price >= start_price THEN 1 ELSE -1 END AS ad,
    CASE WHEN movement = 'Up' THEN (actual_price - start_price) / nullif(start_price, 0) ELSE (start_price - actual_price) / nullif(start_price, 0) END AS ret
  FROM outcomes)"""


def _returns(t):
    return bt.movement_returns(outcomes(t))


def _up_trades(t):
    return bt.trade_results(bt.up_calls(_returns(t)))


# -- aggregates ------------------------------------------------------------------------------------

@query("a4_class_ratio", f"""
SELECT model_key, {sql_rnd("CASE WHEN count(*) FILTER (label = 1) = 0 THEN 1 ELSE count(*) FILTER (label = 0) / count(*) FILTER (label = 1) END")} AS ratio
FROM predictions GROUP BY model_key""")
def _a4(t):
    return ev.class_ratio(t.predictions, ["model_key"], "label").select("model_key", rnd("ratio").alias("ratio"))


@query("a5_accuracy", f"SELECT count(*) AS total, sum(correct_direction) AS correct, {sql_rnd('sum(correct_direction) / count(*) * 100')} AS accuracy FROM move_returns")
def _a5(t):
    return ev.accuracy(_returns(t), "correct_direction").select("total", "correct", rnd("accuracy").alias("accuracy"))


@query("a6_value_counts", """
SELECT 'label' AS kind, CASE WHEN correct_direction = 1 THEN 'Correct' ELSE 'Incorrect' END AS value, count(*) AS n FROM move_returns GROUP BY ALL
UNION ALL (SELECT 'symbol', symbol, count(*) AS n FROM move_returns GROUP BY symbol ORDER BY n DESC, symbol LIMIT 3)""")
def _a6(t):
    r = _returns(t).withColumn("label", F.when(F.col("correct_direction") == 1, "Correct").otherwise("Incorrect"))
    return ev.value_counts(r, "label").select(F.lit("label").alias("kind"), F.col("label").alias("value"), "n").unionByName(
        ev.value_counts(r, "symbol", 3).select(F.lit("symbol").alias("kind"), F.col("symbol").alias("value"), "n"))


@query("a7_return_histogram", """
WITH s AS (SELECT min(ret) AS lo, max(ret) AS hi FROM move_returns)
SELECT CAST(least(20, floor((ret - lo) / ((hi - lo) / 20)) + 1) AS INT) AS bin, count(*) AS n FROM move_returns, s GROUP BY ALL""")
def _a7(t):
    return ev.histogram(_returns(t), "strategy_return")


@query("a8_totals", f"""
SELECT count(*) AS trades, 1000 * count(*) AS invested, {sql_rnd('sum(1000 * (1 + ret))', 3)} AS final,
  {sql_rnd('(sum(1000 * (1 + ret)) - 1000 * count(*)) / (1000 * count(*)) * 100')} AS roi FROM trades_up""")
def _a8(t):
    return bt.totals(_up_trades(t)).select("trades", "invested", rnd("final", 3).alias("final"), rnd("roi").alias("roi"))


_USAGE = " UNION ALL ".join(
    f"SELECT '{n}' AS parameter, CAST({e} AS VARCHAR) AS value, count(*) AS n, {sql_rnd('avg(CAST(f1 > 0.82 AS INT)) * 100')} AS rate FROM registry GROUP BY ALL"
    for n, e in (("horizon", "horizon // 5 * 5"), ("lookback", "lookback // 100 * 100"), ("feature_set", "feature_set"), ("tuning", "tuning")))


@query("a9_usage_rates", _USAGE)
def _a9(t):
    return ev.usage_rates(t.registry, F.col("f1") > 0.82).select("parameter", "value", "n", rnd("rate").alias("rate"))


@query("a10_feature_scores", f"SELECT feature, count(*) AS n, {sql_rnd('avg(importance)')} AS score FROM importance_rows WHERE f1 > 0.82 GROUP BY feature")
def _a10(t):
    return reports.feature_scores(text.importance_rows(t.importance_json.filter("f1 > 0.82"))).select(
        "feature", "n", rnd("score").alias("score"))


@query("a11_coverage", "SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM bars GROUP BY symbol")
def _a11(t):
    return reports.coverage(t.bars)


@query("a12_series_extremes", "SELECT symbol, min(close) AS low, max(close) AS high, max(date) AS last_date, arg_max(close, date) AS last_close FROM bars GROUP BY symbol")
def _a12(t):
    return t.bars.groupBy("symbol").agg(F.min("close").alias("low"), F.max("close").alias("high"),
                                        F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))


@query("a13_confusion_cells", f"""
SELECT model_key, label AS actual, pred_label AS predicted, count(*) AS n, {sql_rnd('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY model_key)')} AS share,
  label = pred_label AS correct FROM predictions WHERE label IS NOT NULL GROUP BY model_key, label, pred_label""")
def _a13(t):
    return ev.confusion_cells(t.predictions, ["model_key"], "label", "pred_label").withColumn("share", rnd("share"))


# -- metrics ---------------------------------------------------------------------------------------

@query("e1_regression_metrics", f"""
SELECT model_key, count(*) AS n, {sql_rnd('sqrt(avg((actual - predicted) ** 2))', 4)} AS rmse, {sql_rnd('avg(abs(actual - predicted))', 4)} AS mae,
  {sql_rnd('avg(abs((actual - predicted) / nullif(actual, 0))) * 100', 4)} AS mape FROM predictions WHERE actual IS NOT NULL GROUP BY model_key""")
def _e1(t):
    return ev.regression_metrics(t.predictions, ["model_key"], "actual", "predicted").select(
        "model_key", "n", *[rnd(c, 4).alias(c) for c in ("rmse", "mae", "mape")])


@query("e2_classification_metrics", f"""
SELECT model_key, tp, fp, fn, tn, {sql_rnd('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {sql_rnd('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision,
  {sql_rnd('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {sql_rnd('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1
FROM (SELECT model_key, count(*) FILTER (label = 1 AND pred_label = 1) AS tp, count(*) FILTER (label = 0 AND pred_label = 1) AS fp,
        count(*) FILTER (label = 1 AND pred_label = 0) AS fn, count(*) FILTER (label = 0 AND pred_label = 0) AS tn
      FROM predictions WHERE label IS NOT NULL GROUP BY model_key)""")
def _e2(t):
    m = ev.classification_metrics(t.predictions, ["model_key"], "label", "pred_label")
    return m.withColumns({c: rnd(c) for c in ("accuracy", "precision", "recall", "f1")})


@query("e3_roc_auc", f"""
WITH r AS (SELECT model_key, label, rank() OVER (PARTITION BY model_key ORDER BY proba)
             + (count(*) OVER (PARTITION BY model_key, proba) - 1) / 2 AS avg_rank FROM predictions WHERE label IS NOT NULL),
     g AS (SELECT model_key, sum(avg_rank) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM r GROUP BY model_key)
SELECT model_key, {sql_rnd('(s - p * (p + 1) / 2) / (p * q)')} AS roc_auc FROM g""")
def _e3(t):
    return ev.roc_auc(t.predictions, ["model_key"], "label", "proba").select("model_key", rnd("roc_auc").alias("roc_auc"))


@query("e4_with_future_row", f"""
SELECT model_key, date, actual, {sql_rnd('predicted')} AS predicted FROM predictions
UNION ALL SELECT model_key, max(date) + {HORIZON}, NULL, {sql_rnd('arg_max(predicted, date)')} FROM predictions GROUP BY model_key""")
def _e4(t):
    return ev.with_future_rows(t.predictions, HORIZON).withColumn("predicted", rnd("predicted"))


@query("e5_prediction_status", """
SELECT model_key, date, CASE WHEN label IS NULL THEN 'No Data' WHEN label = pred_label THEN 'Correct' ELSE 'Incorrect' END AS status FROM predictions""")
def _e5(t):
    return t.predictions.select("model_key", "date", ev.prediction_status(F.col("label"), F.col("pred_label")).alias("status"))


# -- back-test -------------------------------------------------------------------------------------

@query("b1_movement_returns", f"SELECT model_key, pd AS predicted_direction, ad AS actual_direction, correct_direction, {sql_rnd('ret')} AS strategy_return FROM move_returns")
def _b1(t):
    return _returns(t).select("model_key", "predicted_direction", "actual_direction", "correct_direction",
                              rnd("strategy_return").alias("strategy_return"))


CTES["amount_rows"] = "SELECT *, start_price * (1 + (CAST(substr(model_key, 2) AS BIGINT) % 21 - 10) / 200) AS predicted_amount FROM outcomes"


@query("b2_amount_returns", f"""
SELECT model_key, CAST(sign(predicted_amount - start_price) AS INT) AS predicted_direction, CAST(sign(actual_price - start_price) AS INT) AS actual_direction,
  CAST(sign(predicted_amount - start_price) = sign(actual_price - start_price) AS INT) AS correct_direction,
  {sql_rnd("CASE WHEN predicted_amount > start_price THEN (actual_price - start_price) / nullif(start_price, 0) WHEN predicted_amount < start_price THEN (start_price - actual_price) / nullif(start_price, 0) ELSE 0 END")} AS strategy_return
FROM amount_rows""")
def _b2(t):
    o = outcomes(t).withColumn("predicted_amount", F.col("start_price") * (
        1 + (F.substring("model_key", 2, 20).cast("long") % 21 - 10) / F.lit(200.0)))
    return bt.amount_returns(o).select("model_key", "predicted_direction", "actual_direction", "correct_direction",
                                       rnd("strategy_return").alias("strategy_return"))


@query("b3_trade_results", f"""
SELECT model_key, {sql_rnd('1000 * (1 + ret)')} AS final_money, {sql_rnd('abs(ret)')} AS abs_roi, CASE WHEN ret < 0 THEN 'Negative' ELSE 'Positive' END AS roi_sign FROM trades_up""")
def _b3(t):
    return _up_trades(t).select("model_key", rnd("final_money").alias("final_money"), rnd("abs_roi").alias("abs_roi"), "roi_sign")


@query("b4_cumulative_roi", f"""
SELECT model_key, end_date, trade_index, 1000 * trade_index AS cumulative_invested, {sql_rnd('cf', 2)} AS cumulative_final,
  {sql_rnd('(cf - 1000 * trade_index) / (1000 * trade_index) * 100', 4)} AS cumulative_roi
FROM (SELECT *, row_number() OVER w AS trade_index, sum(1000 * (1 + ret)) OVER (w ROWS UNBOUNDED PRECEDING) AS cf FROM trades_up
      WINDOW w AS (ORDER BY end_date, md5(model_key), model_key))""")
def _b4(t):
    return bt.cumulative(land(_up_trades(t))).select(
        "model_key", "end_date", "trade_index", "cumulative_invested", rnd("cumulative_final", 2).alias("cumulative_final"),
        rnd("cumulative_roi", 4).alias("cumulative_roi"))


@query("o4_winners_losers", f"""
(SELECT 'winner' AS kind, model_key, {sql_rnd('ret')} AS strategy_return FROM trades_up ORDER BY ret DESC, model_key LIMIT 3)
UNION ALL (SELECT 'loser', model_key, {sql_rnd('ret')} FROM trades_up ORDER BY ret, model_key LIMIT 3)""")
def _o4(t):
    return reports.winners_and_losers(bt.up_calls(_returns(t))).select("kind", "model_key", rnd("strategy_return").alias("strategy_return"))


def _signals(t):
    return bt.signals(t.predictions.select("model_key", "date", F.col("close").alias("price"), "predicted"), HORIZON)


CTES["sig"] = f"""
SELECT model_key, date, price, ahead / nullif(price, 0) - 1 AS expected_return, CASE WHEN ahead / nullif(price, 0) - 1 > 0.01 THEN 'Buy Signal' ELSE 'No Action' END AS signal
FROM (SELECT model_key, date, close AS price, lead(predicted, {HORIZON}) OVER (PARTITION BY model_key ORDER BY date) AS ahead FROM predictions) WHERE ahead IS NOT NULL"""
CTES["trade_rows"] = f"""
SELECT b.model_key, b.date AS buy_date, b.price AS buy_price, CASE WHEN s.price IS NOT NULL THEN s.date ELSE l.d END AS sell_date, coalesce(s.price, l.p) AS sell_price,
  (coalesce(s.price, l.p) - b.price) / b.price AS ret
FROM sig b LEFT JOIN sig s ON s.model_key = b.model_key AND s.date = b.date + {HORIZON}
JOIN (SELECT model_key, max(date) AS d, arg_max(price, date) AS p FROM sig GROUP BY model_key) l ON l.model_key = b.model_key WHERE b.signal = 'Buy Signal'"""


@query("j16_trade_pairs", "SELECT model_key, buy_date, sell_date, sell_price FROM trade_rows")
def _j16(t):
    return bt.trades(_signals(t), HORIZON).select("model_key", "buy_date", "sell_date", "sell_price")


@query("b5_signals", f"SELECT model_key, date, {sql_rnd('expected_return')} AS expected_return, signal FROM sig")
def _b5(t):
    return _signals(t).select("model_key", "date", rnd("expected_return").alias("expected_return"), "signal")


@query("b5_trades", f"SELECT model_key, buy_date, buy_price, sell_date, sell_price, {sql_rnd('ret')} AS trade_return, {sql_rnd('1000 * ret', 4)} AS pnl FROM trade_rows")
def _b5t(t):
    return bt.trades(_signals(t), HORIZON).withColumns({"trade_return": rnd("trade_return"), "pnl": rnd("pnl", 4)})


@query("b6_trade_statistics", f"""
SELECT model_key, count(*) AS trades, count(*) FILTER (ret > 0) AS wins, {sql_rnd('count(*) FILTER (ret > 0) / count(*)')} AS hit_rate,
  {sql_rnd('sum(1000 * ret)', 3)} AS pnl, {sql_rnd('CASE WHEN count(*) > 1 THEN avg(ret) / nullif(stddev_pop(ret), 0) END')} AS sharpe FROM trade_rows GROUP BY model_key""")
def _b6(t):
    return bt.trade_statistics(bt.trades(_signals(t), HORIZON)).withColumns(
        {"hit_rate": rnd("hit_rate"), "pnl": rnd("pnl", 3), "sharpe": rnd("sharpe")})


CTES["equity"] = """
SELECT model_key, date, capital, (capital - peak) / peak AS drawdown FROM (
  SELECT *, greatest(max(capital) OVER (PARTITION BY model_key ORDER BY date ROWS UNBOUNDED PRECEDING), 10000) AS peak FROM (
    SELECT model_key, date, 10000 + sum(pnl) OVER (PARTITION BY model_key ORDER BY date ROWS UNBOUNDED PRECEDING) AS capital FROM (
      SELECT model_key, sell_date AS date, sum(1000 * ret) AS pnl FROM trade_rows GROUP BY ALL)))"""


@query("b7_equity_curve", f"SELECT model_key, date, {sql_rnd('capital', 3)} AS capital, {sql_rnd('drawdown')} AS drawdown FROM equity")
def _b7(t):
    return bt.equity_curve(bt.trades(_signals(t), HORIZON)).select(
        "model_key", "date", rnd("capital", 3).alias("capital"), rnd("drawdown").alias("drawdown"))


@query("b7_strategy_summary", f"""
SELECT h.model_key, {sql_rnd('h.hold_roi')} AS hold_roi, {sql_rnd('h.hold_dd')} AS hold_max_drawdown, {sql_rnd('s.roi')} AS roi, {sql_rnd('least(s.dd, 0)')} AS max_drawdown
FROM (SELECT model_key, arg_max(price, date) / arg_min(price, date) - 1 AS hold_roi, min((price - peak) / peak) AS hold_dd FROM
        (SELECT *, max(price) OVER (PARTITION BY model_key ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM sig) GROUP BY model_key) h
LEFT JOIN (SELECT model_key, arg_max(capital, date) / 10000 - 1 AS roi, min(drawdown) AS dd FROM equity GROUP BY model_key) s USING (model_key)""")
def _b7s(t):
    rows = _signals(t)
    out = bt.strategy_summary(bt.trades(rows, HORIZON), rows.select("model_key", "date", "price"))
    return out.select("model_key", *[rnd(c).alias(c) for c in ("hold_roi", "hold_max_drawdown", "roi", "max_drawdown")])


# -- splits, folds, scaling ------------------------------------------------------------------------

_SEQ = "row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS size"


@query("m2_chronological_split", f"SELECT symbol, date, pos < floor(size * CAST(0.8 AS DOUBLE)) AS is_train FROM (SELECT symbol, date, {_SEQ} FROM bars)")
def _m2(t):
    return select.chronological_split(t.bars).select("symbol", "date", "is_train")


@query("m3_expanding_folds", f"""
SELECT symbol, date, fold, role FROM (
  SELECT symbol, date, fold, CASE WHEN pos < size - (4 - fold) * (size // 4) THEN 'train' WHEN pos < size - (4 - fold) * (size // 4) + size // 4 THEN 'test' END AS role
  FROM (SELECT symbol, date, {_SEQ} FROM bars), (VALUES (1), (2), (3)) f(fold)) WHERE role IS NOT NULL""")
def _m3(t):
    return select.expanding_folds(t.bars).select("symbol", "date", "fold", "role")


_SCALED = ["open", "close", "volume"]


@query("m4_scaled_features", "SELECT symbol, date, " + ", ".join(
    sql_rnd(f"({c} - avg({c}) OVER (PARTITION BY symbol)) / CASE WHEN stddev_pop({c}) OVER (PARTITION BY symbol) > 0 THEN stddev_pop({c}) OVER (PARTITION BY symbol) ELSE 1 END") + f" AS {c}"
    for c in _SCALED) + " FROM bars")
def _m4(t):
    b = t.bars.select("symbol", "date", *_SCALED)
    return select.scaled(b, select.scaler(b, _SCALED), _SCALED).withColumns({c: rnd(c) for c in _SCALED})


@query("m5_category_codes", """
SELECT b.symbol, b.date, coalesce(c.code, -1) AS symbol_code FROM bars b LEFT JOIN (
  SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS code FROM (SELECT DISTINCT symbol FROM bars WHERE date < DATE '1998-01-01')) c USING (symbol)""")
def _m5(t):
    codes = select.category_codes(t.bars.filter(F.col("date") < F.lit("1998-01-01").cast("date")), "symbol")
    return select.with_category_code(t.bars, codes, "symbol", "symbol_code").select("symbol", "date", "symbol_code")
