"""Averages as scans: any span over whole series, and over the window of each registered model."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.operators import scan
from marketframe.plans.catalog import query, rnd, sql_rnd

SPANS = (2, 50, 5000)


@query("w7_ema_scan", f"""
WITH src AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars),
rec AS (SELECT symbol, date, rn, {', '.join(f'close AS ema_{s}' for s in SPANS)} FROM src WHERE rn = 1
  UNION ALL SELECT s.symbol, s.date, s.rn, {', '.join(f'r.ema_{s} + (s.close - r.ema_{s}) * 2 / {s + 1}' for s in SPANS)}
  FROM rec r JOIN src s ON s.symbol = r.symbol AND s.rn = r.rn + 1)
SELECT symbol, date, {', '.join(f'{sql_rnd(f"ema_{s}", 4)} AS ema_{s}' for s in SPANS)} FROM rec""")
def _w7_scan(t):
    out = scan.ema(t.bars, ["symbol"], "date", {f"ema_{s}": ("close", s) for s in SPANS})
    return out.select("symbol", "date", *[rnd(f"ema_{s}", 4).alias(f"ema_{s}") for s in SPANS])


_LINES = {"ema_50": "e50", "macd": "e12 - e26", "macd_signal": "sig", "macd_hist": "e12 - e26 - sig"}


@query("m14_window_averages", f"""
WITH asked AS (SELECT DISTINCT symbol, input_date - lookback AS first_day, input_date AS last_day FROM registry),
src AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars),
cut AS (SELECT a.symbol, a.first_day, a.last_day, min(s.rn) AS one, max(s.rn) AS stop FROM asked a JOIN src s
  ON s.symbol = a.symbol AND s.date BETWEEN a.first_day AND a.last_day GROUP BY ALL),
rec AS (SELECT c.*, s.rn, s.close AS e50, s.close AS e12, s.close AS e26, CAST(0 AS DOUBLE) AS sig FROM cut c JOIN src s ON s.symbol = c.symbol AND s.rn = c.one
  UNION ALL SELECT r.symbol, r.first_day, r.last_day, r.one, r.stop, s.rn,
    r.e50 + (s.close - r.e50) * 2 / 51, r.e12 + (s.close - r.e12) * 2 / 13, r.e26 + (s.close - r.e26) * 2 / 27,
    r.sig + ((r.e12 + (s.close - r.e12) * 2 / 13) - (r.e26 + (s.close - r.e26) * 2 / 27) - r.sig) * 2 / 10
  FROM rec r JOIN src s ON s.symbol = r.symbol AND s.rn = r.rn + 1 WHERE r.rn < r.stop)
SELECT g.model_key, g.symbol, {', '.join(f'{sql_rnd(e)} AS {c}' for c, e in _LINES.items())} FROM registry g
LEFT JOIN (SELECT * FROM rec WHERE rn = stop) r ON r.symbol = g.symbol AND r.first_day = g.input_date - g.lookback AND r.last_day = g.input_date""")
def _m14_windows(t):
    asked = t.registry.select("model_key", "symbol", F.date_sub("input_date", F.col("lookback")).alias("start"), F.col("input_date").alias("end"))
    return scan.window_averages(t.bars, asked).select("model_key", "symbol", *[rnd(c).alias(c) for c in _LINES])
