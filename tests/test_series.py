"""Windows and indicators against pandas, at several chunk sizes and in any input order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import indicators as ind
from marketframe.operators import series, windows
from marketframe.plans.features import feature_table


def ordered(df, cols):
    return df.select("symbol", "date", *cols).orderBy("symbol", "date").toPandas()


def expected(walk):
    """The reference formulas in pandas, one symbol at a time."""
    out = []
    for _, g in walk.groupby("symbol"):
        g = g.sort_values("date").copy()
        c, h, lo = g["close"], g["high"], g["low"]
        g["sma_50"], g["sma_100"] = c.rolling(50).mean(), c.rolling(100).mean()
        g["ema_50"] = c.ewm(span=50, adjust=False).mean()
        g["momentum_30"] = c.pct_change(30)
        g["macd"] = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        g["macd_signal"] = g["macd"].ewm(span=9, adjust=False).mean()
        tr = np.maximum(h, c) - np.minimum(lo, c)
        up, down = h - h.shift(1), lo.shift(1) - lo
        pdm = pd.Series(np.where((up > down) & (up > 0), up, 0), index=g.index)
        mdm = pd.Series(np.where((down > up) & (down > 0), down, 0), index=g.index)
        atr = tr.rolling(14).mean()
        pdi, mdi = 100 * pdm.rolling(14).mean() / atr, 100 * mdm.rolling(14).mean() / atr
        g["adx"] = ((pdi - mdi).abs() / (pdi + mdi) * 100).rolling(14).mean()
        d = c.diff()
        rs = d.clip(lower=0).rolling(14).mean() / (-d.clip(upper=0)).rolling(14).mean()
        g["rsi"] = 100 - 100 / (1 + rs)
        g["upper_band"] = c.rolling(20).mean() + 2 * c.rolling(20).std()
        g["log_return_1"] = np.log(c / c.shift(1))
        g["rolling_volatility_60"] = g["log_return_1"].rolling(60).std()
        g["corr_sp500_60"] = g["log_return_1"].rolling(60).corr(g["sp500_return"].shift(1))
        low, high = lo.rolling(14).min(), h.rolling(14).max()
        g["pct_k"] = (c - low) / (high - low) * 100
        g["pct_d"] = g["pct_k"].rolling(3).mean()
        tp = (h + lo + c) / 3
        mad = tp.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)
        g["cci"] = (tp - tp.rolling(20).mean()) / (0.015 * mad)
        out.append(g)
    return pd.concat(out).sort_values(["symbol", "date"]).reset_index(drop=True)


COLS = ["sma_50", "sma_100", "ema_50", "momentum_30", "macd", "macd_signal", "adx", "rsi", "upper_band", "log_return_1",
        "rolling_volatility_60", "corr_sp500_60", "pct_k", "pct_d", "cci"]


@pytest.mark.parametrize("chunk_rows", [64, 300, 8192])
def test_indicators_match_pandas_at_any_chunk_size(spark, walk, chunk_rows):
    df = spark.createDataFrame(walk).repartition(7)
    got = ind.over_series(
        df, ind.moving_averages, ind.ema_50, ind.macd, ind.momentum, ind.adx, ind.rsi, ind.bands, ind.log_return,
        ind.volatility, ind.index_correlation, ind.stochastic, ind.cci,
        chunk_rows=chunk_rows)
    got, want = ordered(got, COLS), expected(walk)
    assert len(got) == len(want)
    for c in COLS:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_position_does_not_depend_on_partitions_or_bucket_width(spark, walk):
    want = walk.sort_values(["symbol", "date"]).groupby("symbol").cumcount().tolist()
    for width in (10, 512):
        p = series.with_position(spark.createDataFrame(walk).repartition(5), ["symbol"], "date", width)
        assert ordered(p, [series.POS])[series.POS].tolist() == want


def test_forward_fill_reaches_over_buckets(spark, walk):
    gappy = walk.copy()
    gappy.loc[gappy.index % 97 != 3, "volume"] = np.nan
    df = spark.createDataFrame(gappy).withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))
    got = ordered(series.forward_fill(df, ["symbol"], "date", ["volume"], width=30), ["volume"])["volume"]
    want = gappy.sort_values(["symbol", "date"]).groupby("symbol")["volume"].ffill().reset_index(drop=True)
    np.testing.assert_array_equal(got.astype(float), want)


def test_running_totals_over_levels(spark):
    rows = [(d, i, float((d * 31 + i) % 7)) for d in range(9) for i in range(d % 4 * 5)]
    df = spark.createDataFrame(rows, "day int, i int, x double").withColumn("r", F.floor(F.col("i") / 3))
    got = series.running(df, [], ["day", "r"], ["i"], {"s": F.col("x"), "n": F.lit(1)}).orderBy("day", "i").toPandas()
    np.testing.assert_allclose(got["s"], np.cumsum([r[2] for r in rows]))
    assert got["n"].tolist() == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("span", [2, 9, 200])
def test_ema_of_any_span(spark, walk, span):
    block = windows.block_rows([span])
    c = series.chunked(spark.createDataFrame(walk), ["symbol"], "date", windows.ema_reach(span), rows=128, block=block)
    got = series.own_rows(windows.with_layers(c, windows.ema(["symbol"], {"e": (F.col("close"), span)}, block)))
    want = walk.sort_values(["symbol", "date"]).groupby("symbol")["close"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
    np.testing.assert_allclose(ordered(got, ["e"])["e"], want, rtol=1e-12)
    with pytest.raises(ValueError):
        windows.ema(["symbol"], {"e": (F.col("close"), 1)}, block)


def test_constant_prices_give_null_not_errors(spark):
    rows = [("K", i, 5.0) for i in range(130)]
    df = spark.createDataFrame(rows, "symbol string, i int, close double").selectExpr(
        "symbol", "date_add(date'2020-01-01', i) AS date", "close", "close AS open", "close AS high", "close AS low",
        "1D AS volume", "CAST(i AS DOUBLE) AS sp500_return", "0D AS nasdaq_return")
    got = ind.over_series(df, ind.rsi, ind.adx, ind.stochastic, ind.cci, ind.log_return,
                          ind.index_correlation, ind.bands)
    last = got.orderBy(F.desc("date")).first()
    assert all(last[c] is None for c in ("rsi", "adx", "pct_k", "cci", "corr_sp500_60", "corr_nasdaq_60"))
    assert last["upper_band"] == last["lower_band"] == 5.0


def test_true_range_from_previous_close(spark, walk):
    got = ind.over_series(spark.createDataFrame(walk), lambda w: ind.directional_moves(w, previous_close=True))
    g = walk.sort_values(["symbol", "date"])
    before = g.groupby("symbol")["close"].shift(1)
    want = np.fmax(g["high"], before) - np.fmin(g["low"], before)
    np.testing.assert_allclose(ordered(got, ["tr"])["tr"], want)


def test_feature_table_same_for_any_chunk(spark, walk):
    df = spark.createDataFrame(walk)
    a = feature_table(df, 5, chunk_rows=100).orderBy("symbol", "date").toPandas()
    b = feature_table(df, 5).orderBy("symbol", "date").toPandas()
    assert len(a) == (700 - 99 - 5) + (260 - 99 - 5)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)
    with pytest.raises(ValueError):
        feature_table(df, 5, "other")


def test_nonstationary_symbol_is_differenced(spark):
    # returns that wander: the log price is a double sum
    rng = np.random.default_rng(3)
    n = 400
    close = np.exp(5 + np.cumsum(np.cumsum(rng.normal(0, 0.0005, n))))
    days = pd.date_range("2020-01-01", periods=n).date
    pdf = pd.DataFrame({"symbol": "N", "date": days, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close,
                        "volume": 1.0, "sp500_return": rng.normal(0, 1, n), "nasdaq_return": rng.normal(0, 1, n)})
    got = feature_table(spark.createDataFrame(pdf), 5).orderBy("date").toPandas()
    want = pdf.set_index("date")["close"].pipe(lambda c: np.log(c / c.shift(1)).diff()).loc[got["date"]]
    np.testing.assert_allclose(got["log_return_1"], want, atol=1e-12)


def test_split_modes(spark):
    rows = [("S", f"2020-01-0{i}", 8.0, 10.0, 1.0 if i not in (3, 5) else float(i - 1)) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "symbol string, d string, close double, volume double, split_coef double").selectExpr(
        "symbol", "CAST(d AS DATE) AS date", "close AS open", "close AS high", "close AS low", "close", "volume", "split_coef")
    ref = [r.close for r in ind.split_adjusted(df).orderBy("date").collect()]
    cor = [r.close for r in ind.split_adjusted(df, "corrected").orderBy("date").collect()]
    assert ref == [2.0] * 4 + [8.0] * 3
    assert cor == [1.0] * 2 + [2.0] * 2 + [8.0] * 3
    with pytest.raises(ValueError):
        ind.split_adjusted(df, "x")


def test_ema_of_mixed_spans(spark, walk):
    spans = {"e2": 2, "e9": 9, "e200": 200}
    block = windows.block_rows(list(spans.values()))
    long = pd.concat([walk.assign(symbol=s, date=walk.date) for s in ("Q",)]).drop_duplicates(["symbol", "date"])
    df = spark.createDataFrame(long[["symbol", "date", "close"]])
    rows = series.chunked(df, ["symbol"], "date", windows.ema_reach(200) + block, rows=512, block=block)
    out = series.own_rows(windows.with_layers(rows, windows.ema(["symbol"], {c: (F.col("close"), s) for c, s in spans.items()}, block))).toPandas().sort_values("date")
    close = long.sort_values("date").close
    for c, s in spans.items():
        assert np.allclose(out[c], close.ewm(span=s, adjust=False).mean(), rtol=1e-9)


def test_correlation_of_level_series(spark):
    draw = np.random.default_rng(3)
    n = 400
    x = 100 + draw.uniform(-5e-5, 5e-5, n)
    y = (x - 100) * 3 + draw.normal(0, 3e-5, n) + 7
    pdf = pd.DataFrame({"symbol": "A", "date": pd.date_range("2020-01-01", periods=n).date, "x": x, "y": y, "c": 5.0})
    out = ind.over_series(spark.createDataFrame(pdf), lambda w: windows.rolling_corr(["symbol"], w, 60, {"xy": ("x", "y"), "xc": ("x", "c")}, ind.BLOCK), before=60)
    got = out.toPandas().sort_values("date")
    want = [np.corrcoef(x[i - 59:i + 1], y[i - 59:i + 1])[0, 1] for i in range(59, n)]
    assert got.xy[:59].isna().all() and np.allclose(got.xy[59:].astype(float), want, atol=1e-8) and got.xc.isna().all()


def test_null_keys_and_dates_keep_their_rows(spark):
    df = spark.createDataFrame([("A", "2020-01-01", 1), (None, "2020-01-01", 2), (None, "2020-01-03", 3), ("A", None, 4)], "symbol string, date string, v int") \
        .withColumn("date", F.to_date("date"))
    got = {r.v: (r["_pos"], r["_size"]) for r in series.with_position(df, ["symbol"], "date").collect()}
    assert got == {1: (1, 2), 2: (0, 2), 3: (1, 2), 4: (0, 2)}
    total = series.running(df.withColumn("b", F.lit(None).cast("long")), ["symbol"], ["b"], ["date"], {"s": F.col("v")})
    assert {r.v: r.s for r in total.collect()} == {4: 4, 1: 5, 2: 2, 3: 5}


def test_category_codes_with_shared_prefixes(spark):
    from marketframe.operators.select import category_codes
    values = [f"https://example.org/a/long/common/prefix/{i:04d}" for i in range(500)] + ["a", None, "a"]
    got = {r.v: r.code for r in category_codes(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v}))}


def test_feature_table_moves_rows_by_symbol_and_chunk_only(spark, walk):
    one = walk[walk.symbol == "A"].assign(gdp_growth=1.0, inflation_rate=2.0, unemployment_rate=3.0)
    plan = feature_table(spark.createDataFrame(one), 5)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moves and all("_chunk" in line for line in moves)
