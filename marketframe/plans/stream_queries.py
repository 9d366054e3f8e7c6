"""Streaming operators run to the end of the given event files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators.landing import land, scratch_path
from marketframe.plans.catalog import query, rnd, sql_rnd
from marketframe.plans.inputs import CTES
from marketframe.streaming import live

CTES["event_bars"] = """
SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_min(value, {'ts': ts, 'value': value}) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, {'ts': ts, 'value': value}) AS close, count(*) AS volume FROM events GROUP BY ALL"""


PARTS = 4


def _events(t) -> DataFrame:
    """The event table as a stream of ``PARTS`` files, one per micro-batch, in the order of time."""
    root = scratch_path(t.spark)
    events = t.table("events")
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / PARTS for i in range(1, PARTS)])).first()[0] or []
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events if low is None else events.where(at >= low)
        (part if high is None else part.where(at < high)).coalesce(1).write.mode("append").parquet(f"{root}/events")
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")


def _ticks(t) -> DataFrame:
    return _events(t).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).alias("size"))


def _upserted(t, stream: DataFrame) -> DataFrame:
    """Drain a stream of daily rows into a table, batch by batch, each replacing the days it changes."""
    root = scratch_path(t.spark)
    rows = stream.withColumn("month", F.trunc("date", "month"))
    live.keep_upserting(rows, f"{root}/rows", f"{root}/state", ["symbol", "date"], "month", mode="update").awaitTermination()
    return t.spark.read.parquet(f"{root}/rows").drop("month")


def _with_state(t, stream: DataFrame) -> DataFrame:
    """``_upserted`` for streams that keep maps and lists as state."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(setting)
    t.spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _upserted(t, stream)
    finally:
        t.spark.conf.set(setting, before)


@query("st1_streamed_bars", "SELECT symbol, date, open, high, low, close, volume FROM event_bars")
def _st1(t):
    return _upserted(t, live.daily_bars(_ticks(t)))


@query("st2_streamed_upsert", "SELECT symbol, date, open, high, low, close, volume FROM event_bars")
def _st2(t):
    """Into a table that already holds each symbol's first days, wrongly."""
    root = scratch_path(t.spark)
    ticks = t.table("events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).alias("size"))
    wrong = live.daily_bars(ticks).withColumns({"close": F.lit(-1.0), "month": F.trunc("date", "month")})
    wrong.where(F.day("date") <= 10).write.partitionBy("month").parquet(f"{root}/rows")
    bars = live.daily_bars(_ticks(t)).withColumn("month", F.trunc("date", "month"))
    live.keep_upserting(bars, f"{root}/rows", f"{root}/state", ["symbol", "date"], "month", mode="update").awaitTermination()
    return t.spark.read.parquet(f"{root}/rows").drop("month")


@query("st3_streamed_sentiment", f"""
SELECT n.symbol, d.date, {sql_rnd('avg(n.score)')} AS sentiment_score, count(*) AS n FROM news n,
  (SELECT DISTINCT CAST(unnest(generate_series(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM news) d
WHERE n.ts >= CAST(d.date AS TIMESTAMP) - INTERVAL 7 DAY AND n.ts < CAST(d.date AS TIMESTAMP) GROUP BY ALL""")
def _st3(t):
    news = _events(t).select(F.col("event_type").alias("symbol"), "ts", (F.col("value") / 100).alias("score"))
    return _upserted(t, live.sentiment(news)).withColumn("sentiment_score", rnd("sentiment_score"))


@query("st4_live_averages", f"""
WITH src AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM event_bars),
rec AS (SELECT symbol, date, rn, close AS e50, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig FROM src WHERE rn = 1
  UNION ALL SELECT s.symbol, s.date, s.rn, r.e50 + (s.close - r.e50) * 2 / 51, r.e12 + (s.close - r.e12) * 2 / 13, r.e26 + (s.close - r.e26) * 2 / 27,
    r.sig + ((r.e12 + (s.close - r.e12) * 2 / 13) - (r.e26 + (s.close - r.e26) * 2 / 27) - r.sig) * 2 / 10
  FROM rec r JOIN src s ON s.symbol = r.symbol AND s.rn = r.rn + 1)
SELECT symbol, date, {sql_rnd('e50')} AS ema_50, {sql_rnd('e12 - e26')} AS macd, {sql_rnd('sig')} AS macd_signal, {sql_rnd('e12 - e26 - sig')} AS macd_hist FROM rec""")
def _st4(t):
    """Bars arrive in the order of their day of the month, so that most batches are late for what is there."""
    root = scratch_path(t.spark)
    ticks = t.table("events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).alias("size"))
    bars = land(live.daily_bars(ticks).select("symbol", "date", "close"))
    for part in (1, 0, 2):
        bars.where(F.day("date") % 3 == part).coalesce(1).write.mode("append").parquet(f"{root}/bars")
    stream = t.spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/bars")
    out = _with_state(t, live.live_averages(stream).where("status IN ('new', 'changed')").drop("status"))
    return out.select("symbol", "date", *[rnd(c).alias(c) for c in ("ema_50", "macd", "macd_signal", "macd_hist")])


@query("st3_latest_sentiment", f"""
SELECT symbol, date, {sql_rnd('avg(score)')} AS sentiment_score, count(*) AS n FROM (
  SELECT n.symbol, d.date, n.score, row_number() OVER (PARTITION BY n.symbol, d.date ORDER BY n.ts DESC, n.article_id DESC) AS rn FROM news n,
    (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) + 8, INTERVAL 1 DAY)) AS DATE) AS date FROM news) d
  WHERE n.ts BETWEEN CAST(d.date AS TIMESTAMP) - INTERVAL 7 DAY AND CAST(d.date AS TIMESTAMP)) WHERE rn <= 100 GROUP BY ALL""")
def _st3_latest(t):
    news = _events(t).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("article_id"), (F.col("value") / 100).alias("score"))
    return _with_state(t, live.latest_sentiment(news)).withColumn("sentiment_score", rnd("sentiment_score"))
