"""Technical indicators, returns and targets of daily bars, for all symbols at once.

An indicator is a function of the shared window and gives its columns in layers;
:func:`over_series` runs any number of them on one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketframe.operators import series
from marketframe.operators.asof import require_date
from marketframe.operators.windows import (
    Layers, abs_dev, block_rows, change, ema, ema_reach, frame, log_ratio, long_mean, long_std, rolling, rolling_corr,
    running_sums, with_layers)

KEYS = ["symbol"]
ORDER = "date"

# spans of the exponential averages
EMA_SPAN, MACD_FAST, MACD_SLOW, MACD_SIGNAL = 50, 12, 26, 9
# longest reach of any indicator: the averages' tails, plus the rows in front of them
REACH = ema_reach(EMA_SPAN) + 64
BLOCK = block_rows([EMA_SPAN])

Indicator = Callable[[WindowSpec], Layers]


def over_series(df: DataFrame, *indicators: Indicator, before: int = REACH, after: int = 0, keys: list[str] = KEYS,
                order: str = ORDER, chunk_rows: int = series.CHUNK_ROWS) -> DataFrame:
    """Add the indicators to each symbol's bars in date order."""
    rows = series.chunked(df, keys, order, before, after, chunk_rows, BLOCK)
    w = series.chunk_window(keys)
    return series.own_rows(with_layers(rows, *[i(w) for i in indicators]))


def moving_averages(w: WindowSpec) -> Layers:
    return [running_sums(KEYS, {"close": F.col("close")}),
            {f"sma_{n}": long_mean("close", n, KEYS, BLOCK, w) for n in (50, 100)}]


def ema_50(w: WindowSpec) -> Layers:
    return ema(KEYS, {"ema_50": (F.col("close"), EMA_SPAN)}, BLOCK)


def macd(w: WindowSpec) -> Layers:
    close = F.col("close")
    averages = ema(KEYS, {"_fast": (close, MACD_FAST), "_slow": (close, MACD_SLOW)}, BLOCK)
    line = F.col("_fast") - F.col("_slow")
    local, signal = ema(KEYS, {"macd_signal": (line, MACD_SIGNAL)}, BLOCK)
    return [*averages, {"macd": line, **local}, signal, {"macd_hist": F.col("macd") - F.col("macd_signal")}]


def momentum(w: WindowSpec) -> Layers:
    return [{f"momentum_{n}": change(F.col("close"), n, w) for n in (30, 60)}]


def directional_moves(w: WindowSpec, previous_close: bool = False, prefix: str = "") -> Layers:
    """Range and directional moves.  By default the range is that of the row alone;
    ``previous_close`` measures it from the close before."""
    anchor = F.lag("close").over(w) if previous_close else F.col("close")
    up, down, zero = F.col(f"{prefix}up_move"), F.col(f"{prefix}down_move"), F.lit(0.0)
    return [{
        f"{prefix}tr": F.greatest("high", anchor) - F.least("low", anchor),
        f"{prefix}up_move": F.col("high") - F.lag("high").over(w),
        f"{prefix}down_move": F.lag("low").over(w) - F.col("low"),
    }, {
        # the first row has no move and counts as 0
        f"{prefix}plus_dm": F.when((up > down) & (up > 0), up).otherwise(zero),
        f"{prefix}minus_dm": F.when((down > up) & (down > 0), down).otherwise(zero),
    }]


def adx(w: WindowSpec, period: int = 14, previous_close: bool = False) -> Layers:
    """Average directional index from plain rolling means of the directional moves."""
    moves = directional_moves(w, previous_close, "_")
    means = {f"_mean{c}": rolling("mean", F.col(c), period, w) for c in ("_tr", "_plus_dm", "_minus_dm")}
    plus, minus = (100 * F.try_divide(f"_mean_{c}", "_mean_tr") for c in ("plus_dm", "minus_dm"))
    dx = F.try_divide(F.abs(plus - minus), plus + minus) * 100
    return [*moves, means, {"_dx": dx}, {"adx": rolling("mean", F.col("_dx"), period, w)}]


def rsi(w: WindowSpec, period: int = 14) -> Layers:
    """Relative strength from plain rolling means; 100 without losses, NULL without any move."""
    delta, up, down = F.col("_delta"), F.col("_up"), F.col("_down")
    gain, loss = (F.when(delta.isNotNull(), F.greatest(d, F.lit(0.0))) for d in (delta, -delta))
    value = F.when(down > 0, 100.0 - 100.0 / (1.0 + F.try_divide(up, down))).when(up > 0, F.lit(100.0))
    return [{"_delta": F.col("close") - F.lag("close").over(w)},
            {"_up": rolling("mean", gain, period, w), "_down": rolling("mean", loss, period, w)}, {"rsi": value}]


def bands(w: WindowSpec, n: int = 20) -> Layers:
    close, mid, dev = F.col("close"), F.col("_mid"), F.col("_dev")
    return [{"_mid": rolling("mean", close, n, w), "_dev": rolling("std", close, n, w)},
            {"upper_band": mid + dev * 2, "lower_band": mid - dev * 2}]


def log_return(w: WindowSpec) -> Layers:
    return [{"log_return_1": log_ratio(F.col("close"), F.lag("close").over(w))}]


def future_return(horizon_rows: int) -> Indicator:
    return lambda w: [{"log_return_future": log_ratio(F.lead("close", horizon_rows).over(w), F.col("close"))}]


def with_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", (F.col("log_return_future") > 0).cast("int"))


def volatility(w: WindowSpec) -> Layers:
    """Needs log_return_1 as a column, from the layer before at the latest."""
    return [{}, *long_std("log_return_1", 60, KEYS, BLOCK, w), {"rolling_volatility_60": F.col("_std_log_return_1")}]


def index_correlation(w: WindowSpec) -> Layers:
    """Correlation of log_return_1 with the index returns one row earlier."""
    names = ("sp500", "nasdaq")
    return [{f"_{i}": F.lag(f"{i}_return").over(w) for i in names},
            *rolling_corr(KEYS, w, 60, {f"corr_{i}_60": ("log_return_1", f"_{i}") for i in names}, BLOCK)]


def stochastic(w: WindowSpec) -> Layers:
    low, high = F.col("_low_14"), F.col("_high_14")
    return [{"_low_14": rolling("min", F.col("low"), 14, w), "_high_14": rolling("max", F.col("high"), 14, w)},
            {"pct_k": F.try_divide(F.col("close") - low, high - low) * 100},
            {"pct_d": rolling("mean", F.col("pct_k"), 3, w)}]


def cci(w: WindowSpec, n: int = 20) -> Layers:
    typical, mean = (F.col("high") + F.col("low") + F.col("close")) / 3, F.col("_tp_mean")
    dev = abs_dev(F.col("_tps"), mean) / n
    return [{"_tp_mean": rolling("mean", typical, n, w), "_tps": F.collect_list(typical).over(frame(w, n))},
            {"cci": F.try_divide(typical - mean, F.lit(0.015) * dev)}]


def lags(cols: list[str], steps: tuple[int, ...] = (1, 7, 30)) -> Indicator:
    return lambda w: [{f"{c}_lag_{n}": F.lag(c, n).over(w) for c in cols for n in steps}]


def with_percent_return(df: DataFrame, keys: list[str], tolerance_days: int, out: str) -> DataFrame:
    """Percent change of close against the row before, if that is at most ``tolerance_days`` old.

    For index and sector series: one row per key and calendar day, so a key is small.
    """
    require_date(df, "date")
    w = Window.partitionBy(*keys).orderBy("date")
    prev = F.lag("close").over(w)
    near = F.date_diff(F.col("date"), F.lag("date").over(w)) <= tolerance_days
    return df.withColumn(out, F.when(near, F.try_divide(F.col("close") - prev, prev) * 100))


def split_adjusted(df: DataFrame, mode: str = "reference", keys: list[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Scale prices and volume of the days before a split.

    ``reference`` uses each symbol's latest split only and leaves its day as it is;
    ``corrected`` multiplies all later splits.  Splits are few: they are joined as a small
    table of coefficients in force, not windowed over the bars.
    """
    prices = ["open", "high", "low", "close"]
    if mode not in ("reference", "corrected"):
        raise ValueError(f"mode {mode!r}")
    splits = df.filter(F.col("split_coef") != 1.0)
    if mode == "reference":
        last = splits.groupBy(*keys).agg(F.max_by("split_coef", order).alias("_coef"), F.max(order).alias("_day"))
        factor = F.when(F.col(order) < F.col("_day"), F.col("_coef")).otherwise(1.0)
        out = df.join(last, keys, "left").withColumn("_f", F.coalesce(factor, F.lit(1.0)))
    else:
        events = splits.groupBy(*keys).agg(
            F.collect_list(F.struct(F.col(order).alias("d"), F.col("split_coef").alias("c"))).alias("_splits"))
        later = F.aggregate(F.col("_splits"), F.lit(1.0),
                            lambda acc, s: acc * F.when(s["d"] > F.col(order), s["c"]).otherwise(F.lit(1.0)))
        out = df.join(events, keys, "left").withColumn("_f", F.coalesce(later, F.lit(1.0)))
    scaled: dict[str, Column] = {c: F.col(c) / F.col("_f") for c in prices}
    return out.withColumns({**scaled, "volume": F.col("volume") * F.col("_f")}).drop("_f", "_coef", "_day", "_splits")
