"""Averages as scans against step-by-step recursions."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketframe.operators import scan
from marketframe.operators.series import POS

DAY = datetime.date(2000, 1, 1)


def _recursion(x, span):
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def _walk(spark, n, symbols=("A",)):
    rng = np.random.default_rng(3)
    rows = [(s, DAY + datetime.timedelta(days=2 * i), float(v)) for s in symbols for i, v in enumerate(100 + rng.normal(0, 1, n).cumsum())]
    return spark.createDataFrame(rows, "symbol string, date date, close double"), rows


def test_blocks_and_groups_give_the_same_averages(spark):
    df, rows = _walk(spark, 1500, ("A", None))
    specs = {"short": ("close", 2), "long": ("close", 5000)}
    for block, group in ((256, 64), (16, 4)):
        got = scan.ema(df, ["symbol"], "date", specs, block=block, group=group).toPandas()
        assert len(got) == 3000
        for symbol, part in (("A", got[got.symbol == "A"]), (None, got[got.symbol.isna()])):
            part = part.sort_values("date")
            x = [c for s, _, c in rows if s == symbol]
            for name, span in (("short", 2), ("long", 5000)):
                want = _recursion(x, span)
                assert np.abs(part[name].to_numpy() / want - 1).max() < 1e-12


def test_nothing_and_one_row(spark):
    df, rows = _walk(spark, 1)
    assert scan.ema(df.where("false"), ["symbol"], "date", {"e": ("close", 9)}).count() == 0
    assert [r.e for r in scan.ema(df, ["symbol"], "date", {"e": ("close", 9)}).collect()] == [rows[0][2]]
    asked = spark.createDataFrame([("A", DAY, DAY, 1.5), ("B", DAY, DAY, 2.5), (None, DAY, None, 3.5)], "symbol string, start date, end date, close double")
    got = {r.close: (r.ema_50, r.macd, r.macd_signal) for r in scan.window_averages(df, asked).collect()}
    assert got == {1.5: (rows[0][2], 0.0, 0.0), 2.5: (None, None, None), 3.5: (None, None, None)}


def test_windows_equal_recomputed_ones(spark):
    df, rows = _walk(spark, 600)
    at = lambda d: DAY + datetime.timedelta(days=d)
    spans = [(0, 1198), (1, 1), (1, 2), (-50, 3), (333, 900), (100, 3000), (700, 701), (500, 400), (1198, 1198)]
    asked = spark.createDataFrame([("A", at(a), at(b)) for a, b in spans], "symbol string, start date, end date")
    got = {(r.start, r.end): r for r in scan.window_averages(df, asked, block=16, group=4).collect()}
    assert len(got) == len(spans)
    for a, b in spans:
        x = [c for _, d, c in rows if at(a) <= d <= at(b)]
        r = got[at(a), at(b)]
        if not x:
            assert r.ema_50 is None and r.macd is None and r.macd_signal is None and r.macd_hist is None
            continue
        macd = _recursion(x, 12) - _recursion(x, 26)
        signal = _recursion(macd, 9)
        want = [_recursion(x, 50)[-1], macd[-1], signal[-1], macd[-1] - signal[-1]]
        assert np.abs(np.array([r.ema_50, r.macd, r.macd_signal, r.macd_hist]) - want).max() < 1e-9


def test_one_series_spreads_over_tasks(spark):
    df, _ = _walk(spark, 2000)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = scan.ema(df, ["symbol"], "date", {"e": ("close", 50)}, block=64)
        per_task = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(per_task) == 2000 and len(per_task) > 1 and POS in out.columns
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
