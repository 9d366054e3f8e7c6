"""Bars joined with indices, sectors, macro series, earnings, options, news and company data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators.asof import asof_join
from marketframe.operators.indicators import with_percent_return
from marketframe.schemas import ENRICHED_STOCK_DATA, columns

INDEX_TOLERANCE_DAYS = 6
SECTOR_TOLERANCE_DAYS = 5
OPTION_WINDOW_DAYS = (20, 40)
NEWS_WINDOW_DAYS = 7
NEWS_LIMIT = 100


def join_indicators(bars: DataFrame, indicators: DataFrame) -> DataFrame:
    return bars.join(indicators, ["symbol", "date"], "left")


def join_overview(bars: DataFrame, overview: DataFrame) -> DataFrame:
    """Company figures per symbol; bars of symbols without an overview are left out."""
    return bars.join(overview, "symbol")


def index_returns(index_bars: DataFrame) -> DataFrame:
    """One row per calendar day: percent returns of the two index funds."""
    r = with_percent_return(index_bars, ["idx"], INDEX_TOLERANCE_DAYS, "ret")
    return r.groupBy("date").agg(
        F.max(F.when(F.col("idx") == "SPY", F.col("ret"))).alias("sp500_return"),
        F.max(F.when(F.col("idx") == "QQQ", F.col("ret"))).alias("nasdaq_return"))


def join_index_returns(bars: DataFrame, index_bars: DataFrame) -> DataFrame:
    return bars.join(index_returns(index_bars), "date", "left")


def join_sector_performance(bars: DataFrame, sector: DataFrame, etf_bars: DataFrame) -> DataFrame:
    """Percent return of the fund that tracks the symbol's sector."""
    r = with_percent_return(etf_bars, ["etf"], SECTOR_TOLERANCE_DAYS, "sector_performance")
    r = r.select("etf", "date", "sector_performance")
    return bars.join(sector.select("symbol", "etf"), "symbol", "left").join(r, ["etf", "date"], "left").drop("etf")


# Macro series and the column each one fills.
MACRO_COLUMNS = {"gdp": "gdp_growth", "inflation": "inflation_rate", "unemployment": "unemployment_rate"}


def macro_by_day(days: DataFrame, macro: DataFrame) -> DataFrame:
    """Latest value of each macro series at or before each day.

    The series have no key: they are resolved on distinct days, in one ordered pass over at most
    a calendar of rows.  A missing value counts as the latest one.
    """
    def latest(name):
        return F.max(F.when(F.col("series") == name, F.struct("value")))
    known = macro.groupBy("date").agg(*[latest(s).alias(c) for s, c in MACRO_COLUMNS.items()]).withColumn("_probe", F.lit(0))
    probes = days.select("date").distinct().withColumn("_probe", F.lit(1))
    w = Window.orderBy("date", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = known.unionByName(probes, allowMissingColumns=True).select(
        "date", "_probe", *[F.last(c, True).over(w).alias(c) for c in MACRO_COLUMNS.values()])
    return seen.filter("_probe = 1").select("date", *[F.col(f"{c}.value").alias(c) for c in MACRO_COLUMNS.values()])


def join_macro(bars: DataFrame, macro: DataFrame) -> DataFrame:
    return bars.join(macro_by_day(bars, macro), "date", "left")


def earnings_events(history: DataFrame, calendar: DataFrame) -> DataFrame:
    """History and calendar as one series per symbol; history wins where both name a date."""
    h = history.select("symbol", F.col("fiscal_date").alias("event_date"), F.col("reported").alias("reported_eps"),
                       F.col("estimated").alias("estimated_eps"), F.col("surprise").alias("eps_surprise"),
                       F.col("surprise_pct").alias("eps_surprise_percentage"), F.lit(1).alias("_first"))
    none = F.lit(None).cast("double")
    c = calendar.select("symbol", F.col("report_date").alias("event_date"), none.alias("reported_eps"),
                        F.col("estimate").alias("estimated_eps"), none.alias("eps_surprise"),
                        none.alias("eps_surprise_percentage"), F.lit(0).alias("_first"))
    cols = ["reported_eps", "estimated_eps", "eps_surprise", "eps_surprise_percentage"]
    both = h.unionByName(c).groupBy("symbol", "event_date").agg(F.max_by(F.struct(*cols), "_first").alias("e"))
    return both.select("symbol", "event_date", "e.*")


def join_earnings(bars: DataFrame, history: DataFrame, calendar: DataFrame) -> DataFrame:
    """Last earnings at or before the bar, next ones after it, and the next estimate."""
    events = earnings_events(history, calendar)
    cols = ["reported_eps", "estimated_eps", "eps_surprise", "eps_surprise_percentage"]
    out = asof_join(bars, events, ["symbol"], "date", "event_date", cols, matched="last_earnings_date")
    upcoming = events.select("symbol", "event_date", F.col("estimated_eps").alias("_own_estimate"))
    out = asof_join(out, upcoming, ["symbol"], "date", "event_date", ["_own_estimate"], "forward", strict=True,
                    matched="next_earnings_date")
    return next_estimate(out, calendar)


def next_estimate(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """The calendar's estimate for the next earnings date, else the one of the event itself."""
    est = calendar.groupBy("symbol", F.col("report_date").alias("next_earnings_date")).agg(
        F.max("estimate").alias("_estimate"), F.lit(True).alias("_listed"))
    return rows.join(est, ["symbol", "next_earnings_date"], "left").withColumn(
        "next_earnings_estimated_eps",
        F.when(F.col("_listed"), F.col("_estimate")).otherwise(F.col("_own_estimate"))
    ).drop("_estimate", "_listed", "_own_estimate")


def options_in_window(options: DataFrame) -> DataFrame:
    lo, hi = OPTION_WINDOW_DAYS
    return options.filter(F.col("expiration").between(F.date_add("date", lo), F.date_add("date", hi)))


def option_metrics(options: DataFrame) -> DataFrame:
    """Put/call volume ratio and mean implied volatility per symbol and date."""
    def volume(kind):
        return F.sum(F.when(F.col("type") == kind, F.coalesce("volume", F.lit(0.0))))
    calls, puts = volume("call"), F.coalesce(volume("put"), F.lit(0.0))
    return options_in_window(options).groupBy("symbol", "date").agg(
        F.when(calls > 0, F.try_divide(puts, calls)).alias("put_call_ratio"),
        F.avg(F.expr("try_cast(implied_volatility AS DOUBLE)")).alias("implied_volatility"))


def news_sentiment(days: DataFrame, news: DataFrame, window_days: int = NEWS_WINDOW_DAYS,
                   limit: int = NEWS_LIMIT) -> DataFrame:
    """Mean score of the ``limit`` latest articles in the ``window_days`` before each day's start; 0 without any.

    No window can use more than the ``limit`` latest articles of one day, so each day is cut to
    those before it is copied to the days whose window it falls in.
    """
    day = news.withColumn("_day", F.to_date("ts"))
    # an article at midnight sharp still counts for its own day; any other starts with the next day
    day = day.withColumn("_first", F.when(
        F.col("ts") == F.col("_day").cast(news.schema["ts"].dataType), F.col("_day")).otherwise(F.date_add("_day", 1)))
    newest = [F.col("ts").desc(), F.col("article_id").desc()]
    kept = day.withColumn("_rn", F.row_number().over(
        Window.partitionBy("symbol", "_day", "_first").orderBy(*newest))).filter(F.col("_rn") <= limit)
    seen = kept.select("symbol", "ts", "article_id", "score", F.explode(
        F.sequence(F.col("_first"), F.date_add("_day", window_days))).alias("date"))
    wanted = days.select("symbol", "date").distinct()
    latest = Window.partitionBy("symbol", "date").orderBy(*newest)
    scores = seen.join(wanted, ["symbol", "date"], "left_semi").withColumn("_rn", F.row_number().over(latest)).filter(
        F.col("_rn") <= limit).groupBy("symbol", "date").agg(F.avg("score").alias("sentiment_score"))
    return wanted.join(scores, ["symbol", "date"], "left").withColumn(
        "sentiment_score", F.coalesce("sentiment_score", F.lit(0.0)))


def basic_stock_data(bars: DataFrame, index_bars: DataFrame, macro: DataFrame) -> DataFrame:
    return join_macro(join_index_returns(bars, index_bars), macro)


def enriched_stock_data(bars: DataFrame, index_bars: DataFrame, macro: DataFrame, overview: DataFrame,
                        sector: DataFrame, etf_bars: DataFrame, options: DataFrame, news: DataFrame,
                        history: DataFrame, calendar: DataFrame, indicators: DataFrame | None = None) -> DataFrame:
    """All enrichments of one daily bar table; each joins once, for all symbols.  With ``indicators`` (symbol, date and
    the technical columns) the result has the columns of ENRICHED_STOCK_DATA, in their order and types."""
    out = join_overview(basic_stock_data(bars, index_bars, macro), overview)
    if indicators is not None:
        out = join_indicators(out, indicators)
    out = join_sector_performance(out, sector, etf_bars)
    out = out.join(option_metrics(options), ["symbol", "date"], "left")
    out = out.join(news_sentiment(bars, news), ["symbol", "date"], "left")
    out = join_earnings(out, history, calendar)
    if indicators is None:
        return out
    return out.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in columns(ENRICHED_STOCK_DATA).items()])


def backfill(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of each requested symbol between its start and end, whatever the number of requests."""
    edges = requests.select("symbol", F.col("start").alias("_edge"), F.lit(1).alias("n")).unionByName(
        requests.select("symbol", F.date_add("end", 1).alias("_edge"), F.lit(-1).alias("n")))
    by_day = edges.groupBy("symbol", "_edge").agg(F.sum("n").alias("n"))
    # at most one row per symbol and calendar day: how many requests are open from that day on
    w = Window.partitionBy("symbol").orderBy("_edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_open = by_day.select("symbol", "_edge", F.sum("n").over(w).alias("_open"))
    return asof_join(bars, is_open, ["symbol"], "date", "_edge", ["_open"]).filter("_open > 0").drop("_open")
