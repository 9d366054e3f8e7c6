"""Landed vendor files as typed rows.

Each reader takes a frame of (symbol, body), one whole response per row, and gives one row per
date or record.  Text that is no number becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of the vendor's responses.
BARS_ROOT = "Time Series (Daily)"
BAR_FIELDS = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "6. volume",
              "split_coef": "8. split coefficient"}
INDICATOR_FIELDS = {
    "RSI": {"rsi": "RSI"}, "MACD": {"macd": "MACD", "macd_signal": "MACD_Signal", "macd_hist": "MACD_Hist"},
    "ADX": {"adx": "ADX"}, "BBANDS": {"upper_band": "Real Upper Band", "lower_band": "Real Lower Band"},
}
OVERVIEW_FIELDS = {"market_capitalization": "MarketCapitalization", "pe_ratio": "PERatio",
                   "dividend_yield": "DividendYield", "beta": "Beta"}
EARNINGS_FIELDS = {"reported": "reportedEPS", "estimated": "estimatedEPS", "surprise": "surprise",
                   "surprise_pct": "surprisePercentage"}
CALENDAR_COLUMNS = "symbol string, name string, reportDate date, fiscalDateEnding date, estimate double, currency string"


def _dated(df: DataFrame, root: str) -> DataFrame:
    """One row per date of {root: {date: {field: text}}}; the fields as a map ``f``."""
    # the schema names the one field, since a root may hold characters a path would need quoted
    body = F.from_json("body", f"`{root}` map<string,map<string,string>>")
    days = df.select("symbol", F.explode(body[root]).alias("_d", "f"))
    return days.select("symbol", F.col("_d").try_cast("date").alias("date"), "f").filter("date IS NOT NULL")


def _number(field: str, source: str = "f") -> Column:
    return F.try_element_at(F.col(source), F.lit(field)).try_cast("double")


def daily_bars(df: DataFrame) -> DataFrame:
    out = _dated(df, BARS_ROOT).select("symbol", "date", *[_number(f).alias(c) for c, f in BAR_FIELDS.items()])
    return out.withColumn("split_coef", F.coalesce("split_coef", F.lit(1.0)))


def indicator(df: DataFrame, name: str) -> DataFrame:
    return _dated(df, f"Technical Analysis: {name}").select(
        "symbol", "date", *[_number(f).alias(c) for c, f in INDICATOR_FIELDS[name].items()])


def indicators_long(df: DataFrame, name: str) -> DataFrame:
    """(symbol, date, indicator, value) rows."""
    cols = list(INDICATOR_FIELDS[name])
    return indicator(df, name).unpivot(["symbol", "date"], cols, "indicator", "value")


def overview(df: DataFrame) -> DataFrame:
    """One row per symbol that has one; numbers that are missing count as 0."""
    f = F.from_json("body", "map<string,string>")
    out = df.select("symbol", f.alias("f")).filter(F.map_contains_key("f", "MarketCapitalization"))
    return out.select("symbol", F.upper(F.try_element_at("f", F.lit("Sector"))).alias("sector"),
                      *[F.coalesce(_number(v), F.lit(0.0)).alias(c) for c, v in OVERVIEW_FIELDS.items()])


def earnings(df: DataFrame) -> DataFrame:
    body = F.from_json("body", "quarterlyEarnings array<map<string,string>>")
    rows = df.select("symbol", F.explode(body["quarterlyEarnings"]).alias("f"))
    return rows.select("symbol", F.try_element_at("f", F.lit("fiscalDateEnding")).try_cast("date").alias("fiscal_date"),
                       *[_number(v).alias(c) for c, v in EARNINGS_FIELDS.items()]).filter("fiscal_date IS NOT NULL")


def earnings_calendar(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=CALENDAR_COLUMNS, mode="PERMISSIVE")
    return rows.select("symbol", F.col("reportDate").alias("report_date"), F.coalesce("estimate", F.lit(0.0)).alias("estimate")).filter(
        "report_date IS NOT NULL")


def macro_series(df: DataFrame) -> DataFrame:
    """(series, body) rows of {"data": [{"date", "value"}]}."""
    body = F.from_json("body", "data array<struct<date:string,value:string>>")
    return df.select("series", F.inline(body["data"])).select(
        "series", F.col("date").try_cast("date").alias("date"), F.col("value").try_cast("double").alias("value"))


def options_chain(df: DataFrame) -> DataFrame:
    """(symbol, date, body) rows of {"data": [contract, ...]}."""
    body = F.from_json("body", "data array<struct<expiration:date,type:string,volume:string,implied_volatility:string>>")
    return df.select("symbol", "date", F.inline(body["data"])).withColumn("volume", F.col("volume").try_cast("double"))


def news(df: DataFrame) -> DataFrame:
    """(body) rows of {"feed": [{time_published, ticker_sentiment: [{ticker, ticker_sentiment_score}]}]}."""
    shape = "feed array<struct<url:string,time_published:string,ticker_sentiment:array<struct<ticker:string,ticker_sentiment_score:string>>>>"
    articles = df.select(F.inline(F.from_json("body", shape)["feed"]))
    return articles.select(F.try_to_timestamp("time_published", F.lit("yyyyMMdd'T'HHmmss")).alias("ts"),
                           F.col("url").alias("article_id"), F.inline("ticker_sentiment")).select(
        F.col("ticker").alias("symbol"), "ts", "article_id",
        F.coalesce(F.col("ticker_sentiment_score").try_cast("double"), F.lit(0.0)).alias("score"))
