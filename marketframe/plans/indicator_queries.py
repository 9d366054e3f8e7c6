"""Window functions and technical indicators as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketframe.operators import indicators as ind
from marketframe.operators import series, windows
from marketframe.operators.enrich import basic_stock_data, join_index_returns
from marketframe.operators.landing import land
from marketframe.operators.select import differenced, stationarity
from marketframe.operators.unit_root import augmented_stationarity
from marketframe.plans.catalog import query, rnd, sql_rnd
from marketframe.plans.features import feature_table
from marketframe.plans.inputs import CTES, HORIZON
from marketframe.schemas import BASIC_FEATURES

KEY = ["symbol", "date"]
_W = "PARTITION BY symbol ORDER BY date"


def _over(n):
    return f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(how, x, n, test=None):
    return f"CASE WHEN count({test or x}) {_over(n)} = {n} THEN {how}({x}) {_over(n)} END"


def _lag(x, n=1):
    return f"lag({x}, {n}) OVER ({_W})"


def _corr(x, y, n):
    pair = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"
    return (f"CASE WHEN count({pair}) {_over(n)} = {n} THEN covar_samp({x}, {y}) {_over(n)} "
            f"/ nullif(stddev_samp({x}) {_over(n)} * stddev_samp({y}) {_over(n)}, 0) END")


def _ret(key, tol):
    w = f"PARTITION BY {key} ORDER BY date"
    return (f"CASE WHEN date - lag(date) OVER ({w}) <= {tol} THEN (close - lag(close) OVER ({w})) "
            f"/ nullif(lag(close) OVER ({w}), 0) * 100 END")


CTES["index_ret"] = f"""
SELECT date, max(CASE WHEN idx = 'SPY' THEN ret END) AS sp500_return, max(CASE WHEN idx = 'QQQ' THEN ret END) AS nasdaq_return
FROM (SELECT idx, date, {_ret('idx', 6)} AS ret FROM index_bars) GROUP BY date"""
CTES["etf_ret"] = f"SELECT etf, date, {_ret('etf', 5)} AS sector_performance FROM etf_bars"
CTES["macro_days"] = """
SELECT c.date, g.value AS gdp_growth, i.value AS inflation_rate, u.value AS unemployment_rate FROM calendar c
ASOF LEFT JOIN (SELECT * FROM macro WHERE series = 'gdp') g ON c.date >= g.date
ASOF LEFT JOIN (SELECT * FROM macro WHERE series = 'inflation') i ON c.date >= i.date
ASOF LEFT JOIN (SELECT * FROM macro WHERE series = 'unemployment') u ON c.date >= u.date"""
CTES["basic_rows"] = """
SELECT b.*, r.sp500_return, r.nasdaq_return, m.gdp_growth, m.inflation_rate, m.unemployment_rate
FROM bars b LEFT JOIN index_ret r USING (date) LEFT JOIN macro_days m USING (date)"""
# gaps filled from the row before
CTES["filled_rows"] = "SELECT symbol, date, open, high, low, close, volume, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS {c}" for c in
    ("sp500_return", "nasdaq_return", "gdp_growth", "inflation_rate", "unemployment_rate")) + " FROM basic_rows"


def _indicator_ctes(prefix: str, source: str) -> None:
    """Indicators over ``source`` as CTEs <prefix>_1 .. <prefix>_4 and <prefix>_ema, <prefix>_all."""
    c = CTES
    tp = "((high + low + close) / 3)"
    c[f"{prefix}_1"] = f"""
    SELECT *, {_roll('avg', 'close', 50)} AS sma_50, {_roll('avg', 'close', 100)} AS sma_100,
      close / nullif({_lag('close', 30)}, 0) - 1 AS momentum_30, close / nullif({_lag('close', 60)}, 0) - 1 AS momentum_60,
      greatest(high, close) - least(low, close) AS tr, high - {_lag('high')} AS up_move, {_lag('low')} - low AS down_move,
      close - {_lag('close')} AS delta, {_roll('avg', 'close', 20)} AS mid, {_roll('stddev_samp', 'close', 20)} AS dev,
      {_roll('min', 'low', 14)} AS low14, {_roll('max', 'high', 14)} AS high14, {tp} AS tp,
      {_lag('sp500_return')} AS sp_before, {_lag('nasdaq_return')} AS nq_before,
      lead(close, {HORIZON}) OVER ({_W}) AS later, row_number() OVER ({_W}) AS rn, {_lag('close')} AS before FROM {source}"""
    c[f"{prefix}_2"] = f"""
    SELECT *, CASE WHEN up_move > down_move AND up_move > 0 THEN up_move ELSE 0 END AS plus_dm,
      CASE WHEN down_move > up_move AND down_move > 0 THEN down_move ELSE 0 END AS minus_dm,
      CASE WHEN delta > 0 THEN delta WHEN delta <= 0 THEN 0 END AS gain, CASE WHEN delta < 0 THEN -delta WHEN delta >= 0 THEN 0 END AS loss,
      mid + dev * 2 AS upper_band, mid - dev * 2 AS lower_band,
      CASE WHEN before > 0 AND close > 0 THEN ln(close / before) END AS log_return_1,
      CASE WHEN later > 0 AND close > 0 THEN ln(later / close) END AS log_return_future,
      (close - low14) / nullif(high14 - low14, 0) * 100 AS pct_k,
      {_roll('avg', 'tp', 20)} AS tp_mean, {_roll('list', 'tp', 20)} AS tp_list FROM {prefix}_1"""
    c[f"{prefix}_3"] = f"""
    SELECT *, {_roll('avg', 'plus_dm', 14)} / nullif({_roll('avg', 'tr', 14)}, 0) * 100 AS pdi,
      {_roll('avg', 'minus_dm', 14)} / nullif({_roll('avg', 'tr', 14)}, 0) * 100 AS mdi,
      {_roll('avg', 'gain', 14)} AS up14, {_roll('avg', 'loss', 14)} AS down14,
      {_roll('stddev_samp', 'log_return_1', 60)} AS rolling_volatility_60,
      {_corr('log_return_1', 'sp_before', 60)} AS corr_sp500_60, {_corr('log_return_1', 'nq_before', 60)} AS corr_nasdaq_60,
      {_roll('avg', 'pct_k', 3)} AS pct_d,
      (tp - tp_mean) / nullif(CAST(0.015 AS DOUBLE) * (list_sum(list_transform(tp_list, lambda v: abs(v - tp_mean))) / 20), 0) AS cci
    FROM {prefix}_2"""
    c[f"{prefix}_ema"] = f"""
    SELECT symbol, date, rn, close AS e50, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig FROM {prefix}_1 WHERE rn = 1
    UNION ALL
    SELECT i.symbol, i.date, i.rn, r.e50 + (i.close - r.e50) * 2 / 51, r.e12 + (i.close - r.e12) * 2 / 13, r.e26 + (i.close - r.e26) * 2 / 27,
      r.sig + ((r.e12 + (i.close - r.e12) * 2 / 13) - (r.e26 + (i.close - r.e26) * 2 / 27) - r.sig) * 2 / 10
    FROM {prefix}_ema r JOIN {prefix}_1 i ON i.symbol = r.symbol AND i.rn = r.rn + 1"""
    c[f"{prefix}_all"] = f"""
    SELECT x.*, {_roll('avg', 'dx', 14)} AS adx, e50 AS ema_50, e12 - e26 AS macd, sig AS macd_signal, e12 - e26 - sig AS macd_hist FROM
     (SELECT *, abs(pdi - mdi) / nullif(pdi + mdi, 0) * 100 AS dx,
        CASE WHEN down14 > 0 THEN 100 - 100 / (1 + up14 / down14) WHEN up14 > 0 THEN 100 END AS rsi FROM {prefix}_3) x
     JOIN (SELECT symbol, date, e50, e12, e26, sig FROM {prefix}_ema) e USING (symbol, date)"""


_indicator_ctes("ind", "basic_rows")
_indicator_ctes("feat", "filled_rows")


def _pick(cols, n=6, table="ind_all"):
    return f"SELECT symbol, date, {', '.join(f'{sql_rnd(c, n)} AS {c}' for c in cols)} FROM {table}"


def _ind_query(name, cols, *steps, n=6, table="ind_all", before=ind.REACH, after=0, source=None):
    def run(t):
        rows = ind.over_series(source(t) if source else t.bars, *steps, before=before, after=after)
        return rows.select(*KEY, *[rnd(c, n).alias(c) for c in cols])
    query(name, _pick(cols, n, table))(run)


def _with_index(t):
    return join_index_returns(t.bars, t.index_bars)


# -- generic windows -------------------------------------------------------------------------------

@query("w1_forward_fill", f"""
SELECT symbol, date, last_value(nasdaq_return IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS nasdaq_return
FROM (SELECT symbol, date, CASE WHEN day(date) % 3 = 0 THEN nasdaq_return END AS nasdaq_return FROM bars LEFT JOIN index_ret USING (date))""")
def _w1(t):
    gappy = _with_index(t).select(*KEY, F.when(F.day("date") % 3 == 0, F.col("nasdaq_return")).alias("nasdaq_return"))
    return series.forward_fill(gappy, ["symbol"], "date", ["nasdaq_return"])


@query("w2_lead_lag", f"""
SELECT symbol, date, {_lag('close', 1)} AS lag_1, {_lag('close', 30)} AS lag_30, lead(close, 5) OVER ({_W}) AS lead_5 FROM bars""")
def _w2(t):
    rows = ind.over_series(t.bars, lambda w: [{
        "lag_1": F.lag("close", 1).over(w), "lag_30": F.lag("close", 30).over(w), "lead_5": F.lead("close", 5).over(w)}],
        before=30, after=5)
    return rows.select(*KEY, "lag_1", "lag_30", "lead_5")


@query("w3_rolling", f"SELECT symbol, date, {', '.join(sql_rnd(_roll(f, 'close', 20)) + ' AS ' + n for f, n in (('avg', 'r_mean'), ('stddev_samp', 'r_std'), ('min', 'r_min'), ('max', 'r_max'), ('sum', 'r_sum')))} FROM bars")
def _w3(t):
    names = ("mean", "std", "min", "max", "sum")
    rows = ind.over_series(t.bars, lambda w: [
        {f"r_{h}": windows.rolling(h, F.col("close"), 20, w) for h in names}], before=19)
    return rows.select(*KEY, *[rnd(f"r_{h}").alias(f"r_{h}") for h in names])


@query("w4_rolling_corr", f"SELECT symbol, date, {sql_rnd(_corr('close', 'volume', 60))} AS corr_60 FROM bars")
def _w4(t):
    rows = ind.over_series(t.bars, lambda w: windows.rolling_corr(
        ["symbol"], w, 60, {"corr_60": ("close", "volume")}, ind.BLOCK), before=60)
    return rows.select(*KEY, rnd("corr_60").alias("corr_60"))


@query("w5_rolling_abs_dev", f"""
SELECT symbol, date, {sql_rnd("CASE WHEN n = 20 THEN list_sum(list_transform(l, lambda v: abs(v - m))) / 20 END")} AS mad_20
FROM (SELECT symbol, date, count(close) {_over(20)} AS n, list(close) {_over(20)} AS l, avg(close) {_over(20)} AS m FROM bars)""")
def _w5(t):
    rows = ind.over_series(t.bars, lambda w: [
        {"mad_20": windows.rolling_abs_dev(F.col("close"), 20, w)}], before=19)
    return rows.select(*KEY, rnd("mad_20").alias("mad_20"))


@query("w6_running", f"""
SELECT symbol, date, sum(volume) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS volume_to_date,
       max(close) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS high_to_date FROM bars""")
def _w6(t):
    b = t.bars.withColumn("bucket", series.time_bucket(t.bars, "date"))
    total = series.running(b, ["symbol"], ["bucket"], ["date"], {"volume_to_date": F.col("volume")})
    # the running maximum of earlier buckets comes from one row per bucket
    ends = b.groupBy("symbol", "bucket").agg(F.max("close").alias("m"))
    earlier = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "bucket", F.max("m").over(earlier).alias("m"))
    inner = Window.partitionBy("symbol", "bucket").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return total.join(ends, ["symbol", "bucket"]).select(
        *KEY, "volume_to_date", F.greatest(F.max("close").over(inner), "m").alias("high_to_date"))


_ema_cols = ["ema_2", "ema_9", "ema_50"]


@query("w7_ema", f"""
WITH src AS (SELECT symbol, date, close, row_number() OVER ({_W}) AS rn FROM bars),
rec AS (SELECT symbol, date, rn, close AS ema_2, close AS ema_9, close AS ema_50 FROM src WHERE rn = 1
  UNION ALL SELECT s.symbol, s.date, s.rn, r.ema_2 + (s.close - r.ema_2) * 2 / 3, r.ema_9 + (s.close - r.ema_9) * 2 / 10,
    r.ema_50 + (s.close - r.ema_50) * 2 / 51 FROM rec r JOIN src s ON s.symbol = r.symbol AND s.rn = r.rn + 1)
SELECT symbol, date, {', '.join(f'{sql_rnd(c)} AS {c}' for c in _ema_cols)} FROM rec""")
def _w7(t):
    rows = ind.over_series(t.bars, lambda w: windows.ema(
        ["symbol"], {c: (F.col("close"), int(c[4:])) for c in _ema_cols}, ind.BLOCK))
    return rows.select(*KEY, *[rnd(c).alias(c) for c in _ema_cols])


@query("w8_position", f"SELECT symbol, date, row_number() OVER ({_W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars")
def _w8(t):
    p = series.with_position(t.bars, ["symbol"], "date", pos="pos", size="n")
    return p.select(*KEY, (F.col("pos") + 1).alias("rn"), "n")


@query("w9_trailing_days", f"""
SELECT symbol, date, {sql_rnd(f"avg(close) OVER ({_W} RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)")} AS mean_7d,
       count(*) OVER ({_W} RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS n_7d FROM bars""")
def _w9(t):
    # a calendar frame of 7 days holds at most 8 daily rows
    w = series.chunk_window(["symbol"]).rowsBetween(-7, Window.currentRow)
    c = series.chunked(t.bars, ["symbol"], "date", before=7)
    seen = c.withColumn("near", F.filter(
        F.collect_list(F.struct("date", "close")).over(w), lambda x: x["date"] >= F.date_sub(F.col("date"), 7)))
    total = F.aggregate("near", F.lit(0.0), lambda acc, x: acc + x["close"])
    return series.own_rows(seen).select(*KEY, rnd(total / F.size("near")).alias("mean_7d"), F.size("near").alias("n_7d"))


# -- indicators ------------------------------------------------------------------------------------

_ind_query("t1_moving_averages", ["sma_50", "sma_100"], ind.moving_averages, before=100)
_ind_query("t2_ema_50", ["ema_50"], ind.ema_50)
_ind_query("t3_momentum", ["momentum_30", "momentum_60"], ind.momentum, before=60)
_ind_query("t4_macd", ["macd", "macd_signal", "macd_hist"], ind.macd)
_ind_query("t5_directional_moves", ["tr", "up_move", "down_move", "plus_dm", "minus_dm"], ind.directional_moves,
           before=1, table="ind_2")
_ind_query("t6_adx", ["adx"], ind.adx, before=28, n=4)
_ind_query("t7_rsi", ["rsi"], ind.rsi, before=15, n=4)
_ind_query("t8_bands", ["upper_band", "lower_band"], ind.bands, before=19)
_ind_query("t9_volatility", ["rolling_volatility_60"], ind.log_return, ind.volatility, before=61)
_ind_query("t10_index_correlation", ["corr_sp500_60", "corr_nasdaq_60"], ind.log_return, ind.index_correlation,
           before=61, source=_with_index)
_ind_query("t11_stochastic", ["pct_k", "pct_d"], ind.stochastic, before=16)
_ind_query("t12_cci", ["cci"], ind.cci, before=19, n=4)
_ind_query("t13_log_return", ["log_return_1"], ind.log_return, before=1)


@query("t14_future_return", f"SELECT symbol, date, {sql_rnd('log_return_future')} AS log_return_future FROM ind_2 WHERE log_return_future IS NOT NULL")
def _t14(t):
    rows = ind.over_series(t.bars, ind.future_return(HORIZON), before=0, after=HORIZON)
    return rows.filter("log_return_future IS NOT NULL").select(*KEY, rnd("log_return_future").alias("log_return_future"))


@query("t15_target", "SELECT symbol, date, CAST(log_return_future > 0 AS INT) AS target FROM ind_2 WHERE log_return_future IS NOT NULL")
def _t15(t):
    rows = ind.over_series(t.bars, ind.future_return(HORIZON), before=0, after=HORIZON)
    return ind.with_target(rows.filter("log_return_future IS NOT NULL")).select(*KEY, "target")


@query("t16_index_and_sector_return", f"""
SELECT 'index' AS kind, idx AS name, date, {sql_rnd('ret')} AS ret FROM (SELECT idx, date, {_ret('idx', 6)} AS ret FROM index_bars)
UNION ALL SELECT 'sector', etf, date, {sql_rnd('sector_performance')} FROM etf_ret""")
def _t16(t):
    i = ind.with_percent_return(t.index_bars, ["idx"], 6, "ret").select(
        F.lit("index").alias("kind"), F.col("idx").alias("name"), "date", rnd("ret").alias("ret"))
    s = ind.with_percent_return(t.etf_bars, ["etf"], 5, "ret").select(
        F.lit("sector").alias("kind"), F.col("etf").alias("name"), "date", rnd("ret").alias("ret"))
    return i.unionByName(s)


@query("t17_split_adjusted", """
WITH last AS (SELECT symbol, max(date) AS day, arg_max(split_coef, date) AS coef FROM bars_split WHERE split_coef <> 1 GROUP BY symbol)
SELECT symbol, date, open / f AS open, high / f AS high, low / f AS low, close / f AS close, volume * f AS volume
FROM (SELECT b.*, CASE WHEN date < day THEN coef ELSE 1 END AS f FROM bars_split b LEFT JOIN last USING (symbol))""")
def _t17(t):
    return ind.split_adjusted(t.bars_split).select(*KEY, "open", "high", "low", "close", "volume")


@query("t17_split_adjusted_cumulative", f"""
SELECT symbol, date, open / f AS open, high / f AS high, low / f AS low, close / f AS close, volume * f AS volume
FROM (SELECT *, coalesce(product(split_coef) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS f FROM bars_split)""")
def _t17c(t):
    return ind.split_adjusted(t.bars_split, "corrected").select(*KEY, "open", "high", "low", "close", "volume")


_DF = """
SELECT symbol, n, (sxy / sxx) / sqrt(((syy - (sxy / sxx) * sxy) / (n - 2)) / sxx) AS t_stat FROM (
  SELECT symbol, regr_count(dy, x) AS n, regr_sxx(dy, x) AS sxx, regr_sxy(dy, x) AS sxy, regr_syy(dy, x) AS syy
  FROM (SELECT symbol, {y} - {lag} AS dy, {lag} AS x FROM {src}) WHERE x IS NOT NULL GROUP BY symbol)"""
# closes wander less steadily than returns, so both outcomes occur
CTES["level_rows"] = f"""
SELECT symbol, date, sum(log_return_1) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS level FROM
 (SELECT symbol, date, CASE WHEN symbol > 'Brand#2' THEN CASE WHEN day(date) % 2 = 0 THEN 1 ELSE -1 END * (close / 10000) ELSE log_return_1 END AS log_return_1
  FROM ind_2 WHERE log_return_1 IS NOT NULL)"""


def _level_rows(t):
    """For symbols past Brand#2 a random walk, for the others the sum of returns, which stays near the log price."""
    r = ind.over_series(t.bars, ind.log_return, before=1).filter("log_return_1 IS NOT NULL")
    walk = F.when(F.day("date") % 2 == 0, 1).otherwise(-1) * (F.col("close") / 10000)
    r = r.withColumn("step", F.when(F.col("symbol") > "Brand#2", walk).otherwise(F.col("log_return_1")))
    r = r.withColumn("bucket", series.time_bucket(r, "date"))
    return series.running(r, ["symbol"], ["bucket"], ["date"], {"level": F.col("step")}).select(*KEY, "level")


@query("t18_differenced", f"""
WITH flags AS ({_DF.format(y='level', lag=_lag('level'), src='level_rows')})
SELECT symbol, date, {sql_rnd(f"CASE WHEN t_stat < -2.86 THEN level ELSE level - {_lag('level')} END")} AS level
FROM level_rows JOIN flags USING (symbol)""")
def _t18(t):
    return differenced(_level_rows(t), "level").select(*KEY, rnd("level").alias("level"))


@query("m1_stationarity", f"""
SELECT symbol, n, {sql_rnd('t_stat')} AS t_stat, t_stat < -2.86 AS stationary
FROM ({_DF.format(y='level', lag=_lag('level'), src='level_rows')})""")
def _m1(t):
    return stationarity(_level_rows(t), "level").select("symbol", "n", rnd("t_stat").alias("t_stat"), "stationary")


def _augmented_sql(lags: int) -> str:
    """The test with one or two lagged changes: covariances, from which each lagged change in turn takes what it explains."""
    w = "OVER (PARTITION BY symbol ORDER BY date)"
    names = ["x", *(f"d{i}" for i in range(1, lags + 1)), "y"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    steps = [f"c0 AS (SELECT symbol, count(*) AS n, {', '.join(f'covar_pop({a}, {b}) AS {a}_{b}' for a, b in pairs)} FROM v GROUP BY symbol)"]
    of = lambda a, b: f"{a}_{b}" if (a, b) in pairs else f"{b}_{a}"
    for i in range(1, lags + 1):
        d = f"d{i}"
        left = ", ".join(f"{a}_{b} - {of(a, d)} * {of(b, d)} / {d}_{d} AS {a}_{b}" for a, b in pairs)
        steps.append(f"c{i} AS (SELECT symbol, n, {left} FROM c{i - 1})")
    return f"""
WITH e AS (SELECT symbol, date, lag(level) {w} AS x, level - lag(level) {w} AS y FROM level_rows WHERE level IS NOT NULL),
 v AS (SELECT * FROM (SELECT *, {', '.join(f'lag(y, {i}) {w} AS d{i}' for i in range(1, lags + 1))} FROM e) WHERE d{lags} IS NOT NULL),
 {', '.join(steps)}
SELECT symbol, n, CAST({lags} AS INT) AS lags, {sql_rnd(f'x_y / x_x / sqrt((y_y - x_y * x_y / x_x) / (n - {lags + 2}) / x_x)')} AS t_stat FROM c{lags} WHERE n > {lags + 2}"""


def _augmented(t, lags):
    return augmented_stationarity(_level_rows(t), "level", ["symbol"], lags=lags).where(f"n > {lags + 2}").select("symbol", "n", "lags", rnd("t_stat").alias("t_stat"))


@query("m1_one_lag", _augmented_sql(1))
def _m1a(t):
    return _augmented(t, 1)


@query("m1_two_lags", _augmented_sql(2))
def _m1b(t):
    return _augmented(t, 2)


@query("m1_lag_by_aic")
def _m1c(t):
    return augmented_stationarity(_level_rows(t), "level", ["symbol"])


_lag_cols = ["sp500_return", "nasdaq_return", "gdp_growth"]


@query("t19_lagged_features", "SELECT symbol, date, " + ", ".join(
    f"{sql_rnd(_lag(c, n))} AS {c}_lag_{n}" for c in _lag_cols for n in (1, 7, 30)) + " FROM basic_rows")
def _t19(t):
    rows = ind.over_series(basic_stock_data(t.bars, t.index_bars, t.macro),
                           ind.lags(_lag_cols), before=30)
    return rows.select(*KEY, *[rnd(f"{c}_lag_{n}").alias(f"{c}_lag_{n}") for c in _lag_cols for n in (1, 7, 30)])


T20_NAMES = [c for c in BASIC_FEATURES if "_lag_" not in c]
T20_FLAGS = _DF.format(y="log_return_1", lag=_lag("log_return_1"), src="(SELECT * FROM feat_2 WHERE log_return_future IS NOT NULL)")


# returns of all symbols pass the test, so log_return_1 stays as it is; the flags are still computed
@query("t20_feature_table", f"""
SELECT symbol, date, {', '.join(f'{sql_rnd(c, 4)} AS {c}' for c in T20_NAMES + ['log_return_1', 'log_return_future'])},
  CAST(log_return_future > 0 AS INT) AS target FROM feat_all JOIN ({T20_FLAGS}) f USING (symbol)
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in T20_NAMES + ['log_return_1', 'log_return_future'])} AND t_stat < -2.86""")
def _t20(t):
    rows = feature_table(land(basic_stock_data(t.bars, t.index_bars, t.macro)), HORIZON)
    return rows.select(*KEY, *[rnd(c, 4).alias(c) for c in T20_NAMES + ["log_return_1", "log_return_future"]], "target")
