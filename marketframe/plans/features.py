"""The full feature table: bars in, one row of features and targets per symbol and date out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators import indicators as ind
from marketframe.operators import series
from marketframe.operators.landing import land
from marketframe.operators.select import differenced_unless, stationarity_of_pairs
from marketframe.operators.windows import with_layers
from marketframe.schemas import FEATURE_SETS

LAGGED = {
    "basic": ["gdp_growth", "inflation_rate", "unemployment_rate"],
    "advanced": ["gdp_growth", "inflation_rate", "unemployment_rate", "sector_performance", "sp500_return", "nasdaq_return"],
}


def clean_bars(stock: DataFrame, keys: list[str] = ind.KEYS, order: str = ind.ORDER) -> DataFrame:
    """Infinite numbers to NULL, rows without a close left out, gaps filled from the row before,
    and each row's position in its series."""
    numbers = [f.name for f in stock.schema.fields if f.dataType.typeName() in ("double", "float")]
    finite = stock.withColumns({
        c: F.when((F.abs(c) != float("inf")) & ~F.isnan(c), F.col(c)) for c in numbers})
    rest = [c for c in stock.columns if c not in (*keys, order, "close")]
    return series.with_position(finite.filter(F.col("close").isNotNull()), keys, order, fill=rest)


def feature_table(stock: DataFrame, horizon_rows: int, feature_set: str = "basic", lags: bool = False,
                  difference: bool = True, chunk_rows: int = series.CHUNK_ROWS) -> DataFrame:
    """All indicators, returns and targets of ``stock``, complete rows only.

    ``lags`` adds the lagged macro, index and sector columns.  ``difference`` replaces
    log_return_1 by its change for symbols whose returns fail the stationarity test.
    """
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"Invalid feature_set: {feature_set}")
    keys = ind.KEYS
    rows = land(clean_bars(stock)) if difference else clean_bars(stock)
    w = series.chunk_window(keys)
    if difference:
        # the test reads three columns; its one row per symbol joins the rows before they are cut into chunks, so
        # that nothing below moves them again
        closes = rows.select(*keys, ind.ORDER, "close", series.POS, series.SIZE)
        tested = series.chunked(closes, keys, ind.ORDER, 2, horizon_rows, chunk_rows, ind.BLOCK)
        tested = with_layers(tested, ind.future_return(horizon_rows)(w), ind.log_return(w)).withColumn("_before", F.lag("log_return_1").over(w))
        closed = tested.filter(F.col(series.OWN) & F.col("log_return_future").isNotNull())
        rows = rows.join(land(stationarity_of_pairs(closed, "log_return_1", "_before").select(*keys, "stationary")), keys, "left")
    out = series.chunked(rows, keys, ind.ORDER, ind.REACH, horizon_rows, chunk_rows, ind.BLOCK)
    out = with_layers(out, ind.future_return(horizon_rows)(w), ind.log_return(w))
    if difference:
        out = out.withColumn("_before", F.lag("log_return_1").over(w)).withColumn(
            "log_return_1", differenced_unless("stationary", "log_return_1", "_before")).drop("stationary", "_before")
    parts = [ind.moving_averages, ind.ema_50, ind.macd, ind.momentum, ind.adx, ind.rsi, ind.bands, ind.volatility,
             ind.index_correlation, ind.stochastic, ind.cci]
    if lags:
        parts.append(ind.lags([c for c in LAGGED[feature_set] if c in out.columns]))
        if feature_set == "advanced" and "sentiment_score" in out.columns:
            parts.append(ind.lags(["sentiment_score"], (1,)))
    out = with_layers(out, *[p(w) for p in parts])
    # rows whose future is still open lie at the end of a series, so no frame of a kept row reaches them
    out = ind.with_target(series.own_rows(out))
    names = [c for c in FEATURE_SETS[feature_set] if c in out.columns]
    return out.select(*keys, ind.ORDER, *names, "log_return_1", "log_return_future", "target").na.drop()
