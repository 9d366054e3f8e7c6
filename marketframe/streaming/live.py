"""The daily ingest, kept up to date from streams of ticks, bars and news.

Days are UTC days: run with ``spark.sql.session.timeZone`` set to UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from marketframe.operators.enrich import NEWS_LIMIT, NEWS_WINDOW_DAYS
from marketframe.operators.indicators import EMA_SPAN, MACD_FAST, MACD_SIGNAL, MACD_SLOW
from marketframe.sources.tables import upsert_table


def daily_bars(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """Bars per symbol and day from (symbol, ts, price, size) ticks; a day closes ``late`` after its end."""
    day = F.window("ts", "1 day")
    tick = F.struct("ts", "price")
    bars = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", day.alias("w")).agg(
        F.min_by("price", tick).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", tick).alias("close"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")


def sentiment(news: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean score per symbol over the 7 days up to each day's start."""
    w = F.window("ts", "7 days", "1 day")
    out = news.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(F.avg("score").alias("sentiment_score"), F.count(F.lit(1)).alias("n"))
    return out.select("symbol", F.to_date("w.end").alias("date"), "sentiment_score", "n")


def upsert_into(path: str, keys: list[str], partition: str, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: put each batch into a Parquet table.  Running a batch again changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch.sparkSession, path, batch, keys, partition, order)
    return write


def keep_upserting(stream: DataFrame, path: str, checkpoint: str, keys: list[str], partition: str, order: list[str] | None = None,
                   mode: str = "append", **trigger) -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(upsert_into(path, keys, partition, order)).trigger(**(trigger or {"availableNow": True})).start())


LIVE_COLUMNS = ["symbol", "date", "ema_50", "macd", "macd_signal", "macd_hist", "status"]
LIVE_SCHEMA = "symbol string, date date, ema_50 double, macd double, macd_signal double, macd_hist double, status string"
BLOCK_DAYS = 64
KEEP_BLOCKS = 8
_END = "ema_50 double, fast double, slow double, signal double, last_day int"


def _average(x: np.ndarray, span: int, before: float | None) -> np.ndarray:
    """Exponential average of x that goes on from ``before``, or starts with the first value."""
    if before is None:
        return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()
    return pd.Series(np.concatenate([[before], x])).ewm(span=span, adjust=False).mean().to_numpy()[1:]


class LiveAverages(StatefulProcessor):
    """Carries each symbol's closes and exponential averages from batch to batch, in blocks of ``BLOCK_DAYS`` days.

    State per symbol: a map from block to the closes of its days and the averages at its end, for the latest
    ``KEEP_BLOCKS`` blocks with rows, and the averages at the end of the one before them; older closes are let go.  A row that
    comes late enters its block, and the averages run again from there, from the end of the block before, over whole
    arrays.  Every day whose averages change comes out again: ``new`` for rows of the batch, ``changed`` for days seen
    before; a later row of a date replaces the earlier one.  Rows that change nothing come out with NULL averages: ``late`` up to
    the last day let go, ``replaced`` for all but the last row of a date in a batch, ``incomplete`` without date or close.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", _END)
        self.blocks = handle.getMapState("blocks", "block int", f"days array<int>, closes array<double>, {_END}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        base = self.base.get() if self.base.exists() else None
        day = (pd.to_datetime(pdf["date"]) - pd.Timestamp(0)).dt.days
        whole = pdf["date"].notna() & pdf["close"].notna()
        late = whole & (day <= base[4]) if base else whole & False
        used = whole & ~late
        last = used & ~day.where(used).duplicated(keep="last")
        status = np.select([~whole, late, used & ~last], ["incomplete", "late", "replaced"], "")
        idle = pdf.loc[~last, ["date"]].assign(symbol=key[0], status=status[~last], ema_50=None, macd=None, macd_signal=None, macd_hist=None)
        if len(idle):
            yield idle[LIVE_COLUMNS]
        if last.any():
            yield self._run(key, pd.Series(pdf["close"][last].to_numpy(float), day[last].to_numpy(int)), base)

    def _run(self, key, fresh: pd.Series, base) -> pd.DataFrame:
        first = int(fresh.index.min()) // BLOCK_DAYS
        held = sorted(k[0] for k in self.blocks.keys())
        ends = self.blocks.getValue((max(b for b in held if b < first),))[2:] if held and held[0] < first else base
        again = [self.blocks.getValue((b,)) for b in held if b >= first]
        old = pd.Series([c for b in again for c in b[1]], [d for b in again for d in b[0]], dtype=float)
        old = old[~old.index.isin(fresh.index)]
        closes = (pd.concat([old, fresh]) if len(old) else fresh).sort_index()
        x, days = closes.to_numpy(), closes.index.to_numpy(int)
        e50, fast, slow = (_average(x, span, ends and ends[i]) for i, span in enumerate((EMA_SPAN, MACD_FAST, MACD_SLOW)))
        signal = _average(fast - slow, MACD_SIGNAL, ends and ends[3])
        block = days // BLOCK_DAYS
        for b in np.unique(block).tolist():
            at = np.flatnonzero(block == b)
            z = at[-1]
            self.blocks.updateValue((b,), (days[at].tolist(), x[at].tolist(), float(e50[z]), float(fast[z]), float(slow[z]), float(signal[z]), int(days[z])))
        gone = sorted({*held, *block.tolist()})[:-KEEP_BLOCKS]
        if gone:
            self.base.update(tuple(self.blocks.getValue((gone[-1],))[2:]))
            for b in gone:
                self.blocks.removeKey((b,))
        out = pd.DataFrame({"symbol": key[0], "date": pd.to_datetime(days, unit="D").date, "ema_50": e50, "macd": fast - slow, "macd_signal": signal,
                            "macd_hist": fast - slow - signal, "status": np.where(np.isin(days, fresh.index), "new", "changed")})
        return out[days >= fresh.index.min()]

    def close(self) -> None:
        pass


def live_averages(bars: DataFrame) -> DataFrame:
    """EMA 50 and MACD of each (symbol, date, close) row and of the days that it changes.  Needs the RocksDB state store and
    update mode; upsert by (symbol, date) where the status is ``new`` or ``changed``."""
    return bars.select("symbol", "date", "close").groupBy("symbol").transformWithStateInPandas(
        LiveAverages(), LIVE_SCHEMA, "update", "none")


LATEST_SCHEMA = "symbol string, date date, sentiment_score double, n long"


class LatestArticles(StatefulProcessor):
    """Keeps the ``limit`` latest articles of one (symbol, day); a timer drops them ``days`` after the day.

    The state never has more than ``limit`` articles, whatever arrives.  An article that comes again counts once.
    """

    def __init__(self, limit: int, days: int) -> None:
        self.limit, self.days = limit, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at array<long>, id array<long>, score array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [r[["at", "article_id", "score"]] for r in rows]
        if self.kept.exists():
            parts.insert(0, pd.DataFrame(dict(zip(("at", "article_id", "score"), self.kept.get()))))
        else:
            self.handle.registerTimer(int(pd.Timestamp(key[1]).timestamp() * 1000) + self.days * 86_400_000)
        held = pd.concat(parts).drop_duplicates(["at", "article_id"], keep="last").sort_values(["at", "article_id"]).tail(self.limit)
        self.kept.update((held["at"].tolist(), held["article_id"].tolist(), held["score"].tolist()))
        yield pd.DataFrame({"symbol": [key[0]], "date": [key[1]], "sentiment_score": [held["score"].mean()], "n": [len(held)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_sentiment(news: DataFrame, window_days: int = NEWS_WINDOW_DAYS, limit: int = NEWS_LIMIT, late: str = "1 day") -> DataFrame:
    """Mean score of the ``limit`` latest articles in the ``window_days`` before each day's start, kept up to date: what
    ``enrich.news_sentiment`` finds in a table, for days with articles.  ``news``: symbol, ts, article_id, score; articles
    without one of these are left out.  Articles up to ``late`` behind the latest are still counted.  Needs the RocksDB state store and update mode.
    """
    day = F.to_date("ts")
    first = F.when(F.col("ts") == F.date_trunc("day", "ts"), day).otherwise(F.date_add(day, 1))
    seen = news.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).na.drop(subset=["symbol", "ts", "article_id", "score"]).select(
        "symbol", "ts", F.unix_micros("ts").alias("at"), "article_id", "score", F.explode(F.sequence(first, F.date_add(day, window_days))).alias("date"))
    return seen.groupBy("symbol", "date").transformWithStateInPandas(LatestArticles(limit, window_days), LATEST_SCHEMA, "update", "eventTime")
