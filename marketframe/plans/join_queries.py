"""Joins and enrichments as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.operators import enrich, reports
from marketframe.operators import indicators as ind
from marketframe.operators.asof import HOUR, asof_join
from marketframe.operators.landing import land
from marketframe.plans.catalog import query, rnd, sql_rnd
from marketframe.plans.features import feature_table
from marketframe.plans.inputs import CTES, HORIZON

KEY = ["symbol", "date"]
_EPS = ["reported_eps", "estimated_eps", "eps_surprise", "eps_surprise_percentage"]

CTES["vendor_ind"] = """
SELECT symbol, date, high - low AS vendor_range, CASE WHEN day(date) % 10 <> 0 THEN close END AS vendor_macd
FROM bars WHERE volume > 10"""
CTES["earn_events"] = """
SELECT symbol, event_date, arg_max({'r': r, 'e': e, 's': s, 'p': p}, pri) AS v FROM (
  SELECT symbol, fiscal_date AS event_date, reported AS r, estimated AS e, surprise AS s, surprise_pct AS p, 1 AS pri FROM earnings
  UNION ALL SELECT symbol, report_date, NULL, estimate, NULL, NULL, 0 FROM earnings_calendar) GROUP BY ALL"""
CTES["earn_rows"] = """
SELECT b.symbol, b.date, l.event_date AS last_earnings_date, l.v.r AS reported_eps, l.v.e AS estimated_eps, l.v.s AS eps_surprise,
       l.v.p AS eps_surprise_percentage, n.event_date AS next_earnings_date,
       CASE WHEN c.symbol IS NOT NULL THEN c.estimate ELSE n.v.e END AS next_earnings_estimated_eps
FROM bars b ASOF LEFT JOIN earn_events l ON b.symbol = l.symbol AND b.date >= l.event_date
ASOF LEFT JOIN earn_events n ON b.symbol = n.symbol AND b.date < n.event_date
LEFT JOIN (SELECT symbol, report_date, max(estimate) AS estimate FROM earnings_calendar GROUP BY ALL) c
  ON c.symbol = b.symbol AND c.report_date = n.event_date"""
CTES["option_rows"] = """
SELECT symbol, date, CASE WHEN sum(CASE WHEN type = 'call' THEN volume END) > 0 THEN
         coalesce(sum(CASE WHEN type = 'put' THEN volume END), 0) / sum(CASE WHEN type = 'call' THEN volume END) END AS put_call_ratio,
       avg(try_cast(implied_volatility AS DOUBLE)) AS implied_volatility
FROM options WHERE expiration BETWEEN date + 20 AND date + 40 GROUP BY ALL"""
CTES["news_days"] = "SELECT DISTINCT symbol, CAST(ts AS DATE) AS date FROM news"


def _sentiment_sql(days, news="news"):
    return f"""
    SELECT d.symbol, d.date, coalesce(avg(score), 0) AS sentiment_score FROM {days} d LEFT JOIN (
      SELECT d.symbol, d.date, n.score, row_number() OVER (PARTITION BY d.symbol, d.date ORDER BY n.ts DESC, n.article_id DESC) AS rn
      FROM {days} d JOIN {news} n ON n.symbol = d.symbol AND n.ts BETWEEN CAST(d.date AS TIMESTAMP) - INTERVAL 7 DAY AND CAST(d.date AS TIMESTAMP)
    ) x ON x.symbol = d.symbol AND x.date = d.date AND x.rn <= 100 GROUP BY ALL"""


def _news_days(t):
    return t.news.select("symbol", F.to_date("ts").alias("date")).distinct()


@query("j1_indicator_join", "SELECT b.symbol, b.date, b.close, i.vendor_range, i.vendor_macd FROM bars b LEFT JOIN vendor_ind i USING (symbol, date)")
def _j1(t):
    vendor = t.bars.filter("volume > 10").select(
        *KEY, (F.col("high") - F.col("low")).alias("vendor_range"),
        F.when(F.day("date") % 10 != 0, F.col("close")).alias("vendor_macd"))
    return enrich.join_indicators(t.bars, vendor).select(*KEY, "close", "vendor_range", "vendor_macd")


@query("j2_company_overview", f"SELECT symbol, date, close, {sql_rnd('market_capitalization', 2)} AS market_capitalization, {sql_rnd('pe_ratio')} AS pe_ratio, dividend_yield, beta FROM bars JOIN overview USING (symbol)")
def _j2(t):
    return enrich.join_overview(t.bars, t.overview).select(
        *KEY, "close", rnd("market_capitalization", 2).alias("market_capitalization"), rnd("pe_ratio").alias("pe_ratio"),
        "dividend_yield", "beta")


@query("j3_index_return", f"SELECT symbol, date, {sql_rnd('sp500_return')} AS sp500_return, {sql_rnd('nasdaq_return')} AS nasdaq_return FROM bars LEFT JOIN index_ret USING (date)")
def _j3(t):
    return enrich.join_index_returns(t.bars, t.index_bars).select(
        *KEY, rnd("sp500_return").alias("sp500_return"), rnd("nasdaq_return").alias("nasdaq_return"))


@query("j4_sector_performance", f"""
SELECT b.symbol, b.date, {sql_rnd('sector_performance')} AS sector_performance
FROM bars b LEFT JOIN sector s USING (symbol) LEFT JOIN etf_ret r ON r.etf = s.etf AND r.date = b.date""")
def _j4(t):
    return enrich.join_sector_performance(t.bars, t.sector, t.etf_bars).select(
        *KEY, rnd("sector_performance").alias("sector_performance"))


_MACRO = ["gdp_growth", "inflation_rate", "unemployment_rate"]


@query("j5_macro_asof", f"SELECT symbol, date, {', '.join(f'{sql_rnd(c)} AS {c}' for c in _MACRO)} FROM bars LEFT JOIN macro_days USING (date)")
def _j5(t):
    return enrich.join_macro(t.bars, t.macro).select(*KEY, *[rnd(c).alias(c) for c in _MACRO])


@query("j6_earnings_asof", f"SELECT symbol, date, last_earnings_date, next_earnings_date, {', '.join(f'{sql_rnd(c)} AS {c}' for c in _EPS)} FROM earn_rows")
def _j6(t):
    return enrich.join_earnings(t.bars, t.earnings, t.earnings_calendar).select(
        *KEY, "last_earnings_date", "next_earnings_date", *[rnd(c).alias(c) for c in _EPS])


_J7 = """
SELECT r.model_key, r.symbol, r.prediction_date AS end_date, r.start_price, r.movement,
       b.close AS actual_price FROM registry r ASOF JOIN bars b ON b.symbol = r.symbol AND b.date >= r.prediction_date
WHERE b.date <= r.prediction_date + 7 AND r.prediction_date <= DATE '2001-01-01'"""
CTES["outcomes"] = _J7


def outcomes(t):
    """Registered models with the close that came true."""
    return reports.actual_close(
        t.registry.withColumnRenamed("prediction_date", "end_date"), t.bars, F.lit("2001-01-01").cast("date")).select(
        "model_key", "symbol", "end_date", "start_price", "movement", "actual_price")


@query("j7_actual_close", "SELECT * FROM outcomes")
def _j7(t):
    return outcomes(t)


# -- by time: buckets of an hour, whatever the key ---------------------------------------------------

@query("j5_event_asof", f"""
SELECT e.event_id, r.ts AS error_ts, {sql_rnd('r.value')} AS error_value FROM events e ASOF LEFT JOIN
  (SELECT ts, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY ts) r ON e.ts > r.ts""")
def _j5_events(t):
    """The last error strictly before each event: without a key, all rows are one series."""
    events = t.table("events")
    errors = events.where("event_type = 'error'").select(F.col("ts").alias("error_ts"), F.col("value").alias("error_value"))
    out = asof_join(events.select("event_id", "ts"), errors, [], "ts", "error_ts", ["error_value"], strict=True, matched="found", bucket=HOUR)
    return out.select("event_id", F.col("found").alias("error_ts"), rnd("error_value").alias("error_value"))


@query("j8_next_purchase", f"""
SELECT e.event_id, p.ts AS purchase_ts, {sql_rnd('p.value')} AS purchase_value FROM events e LEFT JOIN
  (SELECT e.event_id, p.ts, p.value FROM events e ASOF JOIN
    (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON p.user_id = e.user_id AND p.ts >= e.ts
   WHERE p.ts <= e.ts + INTERVAL 12 HOURS) p USING (event_id)""")
def _j8_events(t):
    """Each user's first purchase from an event on, at most half a day later."""
    events = t.table("events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("purchase_ts"), F.col("value").alias("purchase_value"))
    out = asof_join(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "purchase_ts", ["purchase_value"],
                    direction="forward", tolerance_days=0.5, matched="found", bucket=HOUR)
    return out.select("event_id", F.col("found").alias("purchase_ts"), rnd("purchase_value").alias("purchase_value"))


@query("j8_first_trading_day", f"""
SELECT b.symbol, b.date, f.date AS future_date, CAST(f.close > b.close AS INT) AS actual_movement
FROM (SELECT *, date + {HORIZON} AS due FROM bars) b ASOF LEFT JOIN bars f ON f.symbol = b.symbol AND f.date >= b.due""")
def _j8(t):
    return reports.actual_movement(t.bars, HORIZON).select(*KEY, "future_date", "actual_movement")


@query("j9_trailing_window", f"""
SELECT r.model_key, count(b.close) AS n, min(b.date) AS first_day, max(b.date) AS last_day, {sql_rnd('avg(b.close)', 4)} AS mean_close
FROM registry r LEFT JOIN bars b ON b.symbol = r.symbol AND b.date BETWEEN r.input_date - r.lookback AND r.input_date GROUP BY ALL""")
def _j9(t):
    p = t.registry.select("model_key", "symbol", F.col("input_date").alias("end"),
                          F.date_sub("input_date", F.col("lookback")).alias("start"))
    return reports.window_summary(p, t.bars).select(
        "model_key", "n", "first_day", "last_day", rnd("mean_close", 4).alias("mean_close"))


@query("j10_prediction_difference", f"""
SELECT p.model_key, p.date, p.predicted AS predicted_price, b.close AS actual_price, {sql_rnd('b.close - p.predicted')} AS difference
FROM (SELECT model_key, symbol, date + {HORIZON} AS date, predicted FROM predictions) p
LEFT JOIN bars b ON b.symbol = p.symbol AND b.date = p.date""")
def _j10(t):
    p = t.predictions.select("model_key", "symbol", F.date_add("date", HORIZON).alias("date"),
                             F.col("predicted").alias("predicted_price"))
    return reports.prediction_difference(p, t.bars).select(
        "model_key", "date", "predicted_price", "actual_price", rnd("difference").alias("difference"))


@query("j11_next_estimate", f"SELECT symbol, date, {sql_rnd('next_earnings_estimated_eps')} AS next_earnings_estimated_eps FROM earn_rows")
def _j11(t):
    return enrich.join_earnings(t.bars, t.earnings, t.earnings_calendar).select(
        *KEY, rnd("next_earnings_estimated_eps").alias("next_earnings_estimated_eps"))


CTES["merged_predictions"] = """
SELECT model_key, date, p.actual, CASE WHEN l.has_predicted THEN l.predicted ELSE p.predicted END AS predicted, l.last_known_price
FROM predictions p FULL JOIN (SELECT * FROM pred_log QUALIFY row_number() OVER (PARTITION BY model_key, date ORDER BY record DESC) = 1) l
  USING (model_key, date)"""


@query("j12_merged_predictions", "SELECT * FROM merged_predictions")
def _j12(t):
    return reports.merged_predictions(t.predictions, t.pred_log)


_KEYED = """
SELECT symbol || '_' || date AS model_key, symbol, date FROM bars"""


def _requests(t):
    """One request per bar: a model for that symbol, trained up to that day."""
    return t.bars.select("symbol", F.col("date").alias("input_date"), "close")


@query("j13_missing_models", """
SELECT b.symbol, b.date AS input_date, 'missing' AS state FROM bars b ANTI JOIN registry r ON r.symbol = b.symbol AND r.input_date = b.date
UNION ALL SELECT b.symbol, b.date, 'present' FROM bars b SEMI JOIN registry r ON r.symbol = b.symbol AND r.input_date = b.date""")
def _j13(t):
    missing, present = reports.split_requests(_requests(t), t.registry, ["symbol", "input_date"])
    return missing.select("symbol", "input_date", F.lit("missing").alias("state")).unionByName(
        present.select("symbol", "input_date", F.lit("present").alias("state")))


@query("j14_data_status", """
WITH cover AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY symbol)
SELECT r.symbol, count(*) AS requests, bool_and(coalesce(r.input_date - r.lookback >= c.lo AND r.input_date <= c.hi, false)) AS complete,
       count(*) FILTER (coalesce(r.input_date - r.lookback >= c.lo AND r.input_date <= c.hi, false)) AS covered
FROM registry r LEFT JOIN cover c USING (symbol) GROUP BY r.symbol""")
def _j14(t):
    r = t.registry.select("symbol", F.date_sub("input_date", F.col("lookback")).alias("start"), F.col("input_date").alias("end"))
    return reports.data_status(r, t.bars)


@query("j15_explained_models", """
SELECT r.model_key, r.symbol, r.f1, e.explanation FROM registry r LEFT JOIN explanation_text e USING (model_key)""")
def _j15(t):
    return reports.with_explanation(
        t.registry.select("model_key", "symbol", "f1"), t.explanation_text)


# -- enrichment aggregates -------------------------------------------------------------------------

@query("p8_option_window", "SELECT symbol, type, count(*) AS n, sum(volume) AS volume FROM options WHERE expiration BETWEEN date + 20 AND date + 40 GROUP BY ALL")
def _p8(t):
    return enrich.options_in_window(t.options).groupBy("symbol", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("a1_put_call_ratio", f"SELECT symbol, date, {sql_rnd('put_call_ratio')} AS put_call_ratio FROM option_rows")
def _a1(t):
    return enrich.option_metrics(t.options).select(*KEY, rnd("put_call_ratio").alias("put_call_ratio"))


@query("a2_implied_volatility", f"SELECT symbol, date, {sql_rnd('implied_volatility')} AS implied_volatility FROM option_rows")
def _a2(t):
    return enrich.option_metrics(t.options).select(*KEY, rnd("implied_volatility").alias("implied_volatility"))


@query("a3_news_sentiment", f"SELECT symbol, date, {sql_rnd('sentiment_score')} AS sentiment_score FROM ({_sentiment_sql('news_days')})")
def _a3(t):
    return enrich.news_sentiment(_news_days(t), t.news).select(*KEY, rnd("sentiment_score").alias("sentiment_score"))


@query("u1_earnings_union", f"SELECT symbol, event_date, {sql_rnd('v.r')} AS reported_eps, {sql_rnd('v.e')} AS estimated_eps FROM earn_events")
def _u1(t):
    return enrich.earnings_events(t.earnings, t.earnings_calendar).select(
        "symbol", "event_date", rnd("reported_eps").alias("reported_eps"), rnd("estimated_eps").alias("estimated_eps"))


@query("u2_all_symbols", f"""
SELECT e.symbol, count(*) AS rows, {sql_rnd('avg(b.sp500_return)', 4)} AS mean_index, {sql_rnd('avg(b.gdp_growth)', 2)} AS mean_gdp,
  {sql_rnd('avg(r.sector_performance)', 4)} AS mean_sector, {sql_rnd('avg(o.put_call_ratio)', 4)} AS mean_ratio,
  {sql_rnd('avg(e.reported_eps)')} AS mean_eps, max(e.next_earnings_date) AS last_next
FROM basic_rows b JOIN earn_rows e USING (symbol, date) JOIN overview v USING (symbol) LEFT JOIN sector s USING (symbol)
LEFT JOIN etf_ret r ON r.etf = s.etf AND r.date = b.date LEFT JOIN option_rows o ON o.symbol = b.symbol AND o.date = b.date
GROUP BY ALL""")
def _u2(t):
    rows = enrich.enriched_stock_data(t.bars, t.index_bars, t.macro, t.overview, t.sector, t.etf_bars, t.options,
                                      t.news, t.earnings, t.earnings_calendar)
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.avg("sp500_return"), 4).alias("mean_index"),
        rnd(F.avg("gdp_growth"), 2).alias("mean_gdp"), rnd(F.avg("sector_performance"), 4).alias("mean_sector"),
        rnd(F.avg("put_call_ratio"), 4).alias("mean_ratio"), rnd(F.avg("reported_eps")).alias("mean_eps"),
        F.max("next_earnings_date").alias("last_next"))


_TECHNICAL = {"rsi": 4, "macd": 6, "macd_signal": 6, "macd_hist": 6, "adx": 4, "upper_band": 6, "lower_band": 6}
_ENRICHED = {"sp500_return": 4, "gdp_growth": 4, "market_capitalization": 2, "put_call_ratio": 4, "implied_volatility": 6, "sector_performance": 4,
             "sentiment_score": 6, "reported_eps": 6, **_TECHNICAL}


def enriched(t):
    """The enriched table whole; our own indicators stand for the vendor's."""
    technical = ind.over_series(t.bars, ind.rsi, ind.macd, ind.adx, ind.bands).select(*KEY, *_TECHNICAL)
    return enrich.enriched_stock_data(t.bars, t.index_bars, t.macro, t.overview, t.sector, t.etf_bars, t.options, t.bar_news, t.earnings,
                                      t.earnings_calendar, technical)


@query("u2_enriched_rows", f"""
SELECT b.symbol, b.date, b.open, b.close, v.beta, {', '.join(f"{sql_rnd(p + '.' + c, n)} AS {c}" for c, n, p in [
    (c, n, {"sp500_return": "b", "gdp_growth": "b", "market_capitalization": "v", "put_call_ratio": "o", "implied_volatility": "o",
            "sector_performance": "r", "sentiment_score": "n", "reported_eps": "e"}.get(c, "i")) for c, n in _ENRICHED.items()])},
  e.next_earnings_date
FROM basic_rows b JOIN earn_rows e USING (symbol, date) JOIN overview v USING (symbol) JOIN ind_all i USING (symbol, date) LEFT JOIN sector s USING (symbol)
LEFT JOIN etf_ret r ON r.etf = s.etf AND r.date = b.date LEFT JOIN option_rows o ON o.symbol = b.symbol AND o.date = b.date
JOIN ({_sentiment_sql('basic_rows', 'bar_news')}) n ON n.symbol = b.symbol AND n.date = b.date""")
def _u2r(t):
    return enriched(t).select(*KEY, "open", "close", "beta", *[rnd(c, n).alias(c) for c, n in _ENRICHED.items()], "next_earnings_date")


@query("t20_advanced_features")
def _t20a(t):
    """The advanced set with its lagged columns."""
    return feature_table(land(enriched(t)), HORIZON, "advanced", lags=True)
