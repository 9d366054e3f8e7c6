"""Returns of following the models: per trade, in total, over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators import series
from marketframe.operators.asof import require_date

STAKE = 1000.0
CAPITAL = 10000.0


def movement_returns(rows: DataFrame) -> DataFrame:
    """Long on "Up", short otherwise; a price that has not moved counts as up."""
    start, actual = F.col("start_price"), F.col("actual_price")
    up = F.col("movement") == "Up"
    return rows.withColumns({
        "predicted_direction": F.when(up, 1).otherwise(-1), "actual_direction": F.when(actual >= start, 1).otherwise(-1),
        "strategy_return": F.when(up, F.try_divide(actual - start, start)).otherwise(F.try_divide(start - actual, start)),
    }).withColumn("correct_direction", (F.col("predicted_direction") == F.col("actual_direction")).cast("int"))


def amount_returns(rows: DataFrame) -> DataFrame:
    """Long, short or flat by the sign of the forecast change."""
    start, actual = F.col("start_price"), F.col("actual_price")
    rows = rows.withColumns({
        "predicted_direction": F.signum(F.col("predicted_amount") - start).cast("int"),
        "actual_direction": F.signum(actual - start).cast("int")})
    side = F.col("predicted_direction")
    change = F.try_divide(actual - start, start)
    return rows.withColumns({
        "correct_direction": (side == F.col("actual_direction")).cast("int"),
        "strategy_return": F.when(side > 0, change).when(side < 0, F.try_divide(start - actual, start)).otherwise(0.0)})


def up_calls(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("movement") == "Up")


def trade_results(rows: DataFrame) -> DataFrame:
    r = F.col("strategy_return")
    return rows.withColumns({"final_money": STAKE * (1 + r), "abs_roi": F.abs(r),
                             "roi_sign": F.when(r < 0, "Negative").otherwise("Positive")})


def totals(trades: DataFrame) -> DataFrame:
    invested = STAKE * F.count(F.lit(1))
    final = F.sum("final_money")
    return trades.agg(F.count(F.lit(1)).alias("trades"), invested.alias("invested"), final.alias("final"),
                      (F.try_divide(final - invested, invested) * 100).alias("roi"))


def cumulative(trades: DataFrame, date: str = "end_date", key: str = "model_key") -> DataFrame:
    """Invested, final money and ROI after each trade, by end date and then by a hash of the key.

    The hash order spreads a day with very many trades over ranges of the hash.
    """
    t = trades.withColumn("_hash", F.md5(key)).withColumn("_range", F.substring("_hash", 1, 3))
    run = series.running(t, [], [date, "_range"], ["_hash", key],
                         {"trade_index": F.lit(1), "cumulative_final": F.col("final_money")})
    invested = STAKE * F.col("trade_index")
    return run.withColumns({"cumulative_invested": invested,
                            "cumulative_roi": (F.col("cumulative_final") - invested) / invested * 100}).drop("_hash", "_range")


def signals(predictions: DataFrame, horizon: int, threshold: float = 0.01) -> DataFrame:
    """Expected return of each row from the forecast ``horizon`` rows on; rows without one are left out."""
    keys = ["model_key"]
    c = series.chunked(predictions, keys, "date", before=0, after=horizon)
    ahead = F.lead("predicted", horizon).over(series.chunk_window(keys))
    out = series.own_rows(c.withColumn("_ahead", ahead)).filter(F.col("_ahead").isNotNull())
    return out.withColumn("expected_return", F.try_divide(F.col("_ahead"), "price") - 1).withColumn(
        "signal", F.when(F.col("expected_return") > threshold, "Buy Signal").otherwise("No Action")).drop("_ahead")


def trades(rows: DataFrame, horizon_days: int) -> DataFrame:
    """Buy on each signal with a fixed stake; sell ``horizon_days`` later if that is a row of the
    series, else on the last row."""
    buys = rows.filter(F.col("signal") == "Buy Signal").select(
        "model_key", F.col("date").alias("buy_date"), F.col("price").alias("buy_price"),
        F.date_add("date", horizon_days).alias("_due"))
    sells = rows.select("model_key", F.col("date").alias("_due"), F.col("price").alias("_due_price"))
    last = rows.groupBy("model_key").agg(F.max("date").alias("_last"), F.max_by("price", "date").alias("_last_price"))
    out = buys.join(sells, ["model_key", "_due"], "left").join(last, "model_key")
    due = F.col("_due_price").isNotNull()
    out = out.withColumns({"sell_date": F.when(due, F.col("_due")).otherwise(F.col("_last")),
                           "sell_price": F.coalesce("_due_price", "_last_price")})
    ret = F.try_divide(F.col("sell_price") - F.col("buy_price"), "buy_price")
    return out.withColumns({"trade_return": ret, "pnl": STAKE * ret}).drop("_due", "_due_price", "_last", "_last_price")


def trade_statistics(trade_rows: DataFrame) -> DataFrame:
    n, wins = F.count(F.lit(1)), F.count_if(F.col("pnl") > 0)
    mean, dev = F.avg("trade_return"), F.stddev_pop("trade_return")
    # a deviation that is rounding noise counts as none
    return trade_rows.groupBy("model_key").agg(
        n.alias("trades"), wins.alias("wins"), F.try_divide(wins, n).alias("hit_rate"), F.sum("pnl").alias("pnl"),
        F.when((n > 1) & (dev > 1e-15), mean / dev).alias("sharpe"))


def drawdown(value: Column, peak: Column) -> Column:
    return F.try_divide(value - peak, peak)


def equity_curve(trade_rows: DataFrame) -> DataFrame:
    """Capital and its drawdown after each day with sales.

    Sales are summed per model and day first, so a model has at most one row per calendar day.
    """
    require_date(trade_rows, "sell_date")
    daily = trade_rows.groupBy("model_key", F.col("sell_date").alias("date")).agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy("model_key").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = daily.withColumn("capital", CAPITAL + F.sum("pnl").over(w))
    curve = curve.withColumn("peak", F.greatest(F.max("capital").over(w), F.lit(CAPITAL)))
    return curve.withColumn("drawdown", drawdown(F.col("capital"), F.col("peak")))


def strategy_summary(trade_rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Return and worst drawdown of the strategy next to buying on the first day and holding."""
    strategy = equity_curve(trade_rows).groupBy("model_key").agg(
        (F.sum("pnl") / CAPITAL).alias("roi"), F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"))
    require_date(prices, "date")
    w = Window.partitionBy("model_key").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = prices.withColumn("_dd", drawdown(F.col("price"), F.max("price").over(w))).groupBy("model_key").agg(
        (F.try_divide(F.max_by("price", "date"), F.min_by("price", "date")) - 1).alias("hold_roi"),
        F.min("_dd").alias("hold_max_drawdown"))
    return held.join(strategy, "model_key", "left")
