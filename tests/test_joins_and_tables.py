import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from marketframe.functions import scalars, text
from marketframe.operators import backtest, enrich, evaluate, reports, select
from marketframe.operators.asof import asof_join
from marketframe.sources import files, model_store, tables, vendor

D = dt.date


def day(i):
    return D(2021, 1, 1) + dt.timedelta(days=i)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_against_brute_force(spark, direction, strict, tolerance):
    rng = random.Random(5)
    left = [(rng.choice("ab"), day(rng.randrange(60)), i) for i in range(80)]
    right = [(k, day(d), None if d % 5 == 0 else float(d)) for k in "ab" for d in rng.sample(range(60), 15)]
    got = asof_join(spark.createDataFrame(left, "k string, d date, i int"), spark.createDataFrame(right, "k string, rd date, v double"),
                    ["k"], "d", "rd", ["v"], direction, strict, tolerance, matched="m").collect()
    assert len(got) == len(left)
    for r in got:
        ok = {"backward": lambda x: x < r.d or (x == r.d and not strict), "forward": lambda x: x > r.d or (x == r.d and not strict)}[direction]
        c = [(x, v) for k, x, v in right if k == r.k and ok(x)]
        want = (max(c, key=lambda z: z[0]) if direction == "backward" else min(c, key=lambda z: z[0])) if c else (None, None)
        if c and tolerance is not None and abs((want[0] - r.d).days) > tolerance:
            want = (None, None)
        assert (r.m, r.v) == want


def test_news_uses_the_latest_articles_of_the_week_before(spark):
    start = dt.datetime(2021, 1, 1)
    rng = random.Random(2)
    rows = [("s", start + dt.timedelta(hours=rng.randrange(24 * 20)), i, float(i)) for i in range(300)]
    rows += [("s", start + dt.timedelta(days=9), 900 + i, 5000.0) for i in range(4)]
    news = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, article_id int, score double")
    days = spark.createDataFrame([("s", day(i)) for i in range(25)] + [("none", day(3))], "symbol string, date date")
    got = {(r.symbol, r.date): r.sentiment_score for r in enrich.news_sentiment(days, news, limit=10).collect()}
    for i in range(25):
        end = start + dt.timedelta(days=i)
        seen = sorted([(t, a, s) for _, t, a, s in rows if end - dt.timedelta(days=7) <= t <= end], reverse=True)[:10]
        assert got[("s", day(i))] == pytest.approx(sum(s for *_, s in seen) / len(seen) if seen else 0.0)
    assert got[("none", day(3))] == 0.0


def test_earnings_history_wins_and_calendar_estimate_comes_first(spark):
    bars = spark.createDataFrame([("s", day(i)) for i in (0, 10, 20)], "symbol string, date date")
    hist = spark.createDataFrame([("s", day(5), 1.0, 2.0, -1.0, -0.5), ("s", day(15), 3.0, 4.0, -1.0, -0.25)],
                                 "symbol string, fiscal_date date, reported double, estimated double, surprise double, surprise_pct double")
    cal = spark.createDataFrame([("s", day(15), 9.0), ("s", day(30), 7.0)], "symbol string, report_date date, estimate double")
    got = enrich.join_earnings(bars, hist, cal).orderBy("date").collect()
    assert [(r.reported_eps, r.next_earnings_date, r.next_earnings_estimated_eps) for r in got] == [
        (None, day(5), 2.0), (1.0, day(15), 9.0), (3.0, day(30), 7.0)]


def test_option_metrics_without_calls(spark):
    rows = [("s", day(0), day(25), "put", 5.0, "None"), ("s", day(0), day(60), "call", 5.0, "0.5"), ("t", day(0), day(20), "call", 2.0, "0.4")]
    got = {r.symbol: r for r in enrich.option_metrics(spark.createDataFrame(
        rows, "symbol string, date date, expiration date, type string, volume double, implied_volatility string")).collect()}
    assert got["s"].put_call_ratio is None and got["s"].implied_volatility is None
    assert got["t"].put_call_ratio == 0.0 and got["t"].implied_volatility == 0.4


def test_backfill_gives_each_bar_once(spark):
    bars = spark.createDataFrame([(s, day(i), 1.0) for s in "ab" for i in range(20)], "symbol string, date date, close double")
    req = spark.createDataFrame([("a", day(2), day(4)), ("a", day(3), day(6)), ("a", day(10), day(10)), ("c", day(0), day(9))],
                                "symbol string, start date, end date")
    got = sorted(r.date for r in enrich.backfill(req, bars).collect())
    assert got == [day(i) for i in (2, 3, 4, 5, 6, 10)]


def test_upsert_twice_is_once_and_last_wins(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = spark.createDataFrame([("a", day(i), "m1", float(i)) for i in range(5)] + [("b", day(40), "m2", 1.0)],
                                  "symbol string, date date, month string, close double")
    batch = spark.createDataFrame([("a", day(1), "m1", 10.0, 1), ("a", day(1), "m1", 11.0, 2), ("a", day(9), "m1", 9.0, 1)],
                                  "symbol string, date date, month string, close double, ord int")
    tables.upsert_table(spark, path, first, ["symbol", "date"], "month")
    untouched = [f.path for f in files._listing(spark, path + "/month=m2").collect()]
    for _ in range(2):
        tables.upsert_table(spark, path, batch, ["symbol", "date"], "month", ["ord"])
        got = {(r.symbol, r.date): r.close for r in spark.read.parquet(path).collect()}
        assert got == {("a", day(0)): 0.0, ("a", day(1)): 11.0, ("a", day(2)): 2.0, ("a", day(3)): 3.0, ("a", day(4)): 4.0,
                       ("a", day(9)): 9.0, ("b", day(40)): 1.0}
    assert [f.path for f in files._listing(spark, path + "/month=m2").collect()] == untouched


def test_write_modes_types_and_sql(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS w LOCATION '{tmp_path}/w'")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    tables.overwrite(df, "w.t")
    tables.append(df, "w.t")
    assert spark.table("w.t").count() == 4
    tables.truncate_and_load(df, "w.t")
    assert spark.table("w.t").count() == 2
    assert tables.column_types(spark, "w.t") == {"id": "int", "name": "string"}
    assert tables.run_sql(spark, "SELECT name FROM w.t WHERE id = :id", id=2).first().name == "y"
    assert tables.run_sql(spark, "SELECT count(*) AS n FROM w.t WHERE name = :v", v="x' OR '1'='1").first().n == 0
    spark.sql("DROP DATABASE w CASCADE")


def test_conform_counts_what_it_loses(spark):
    df = spark.createDataFrame([("1", "a"), ("x", None)], "n string, s string")
    assert [r.n for r in tables.conform(df, {"n": "smallint", "s": "varchar"}).collect()] == [1, None]
    assert tables.cast_failures(df, {"n": "smallint", "s": "varchar"}).first().asDict() == {"n": 1, "s": 0}


def test_vendor_json(spark, tmp_path):
    body = json.dumps({"Time Series (Daily)": {"2024-10-10": {
        "1. open": "1.5", "2. high": "2", "3. low": "1", "4. close": "oops", "6. volume": "100"}, "bad": {}}})
    r = vendor.daily_bars(spark.createDataFrame([("A", body), ("B", "{}"), ("C", "no json")], "symbol string, body string")).collect()
    assert len(r) == 1 and (r[0].date, r[0].open, r[0].close, r[0].split_coef) == (D(2024, 10, 10), 1.5, None, 1.0)
    macd = json.dumps({"Technical Analysis: MACD": {"2024-10-10": {"MACD": "1", "MACD_Signal": "2", "MACD_Hist": "-1"}}})
    long = vendor.indicators_long(spark.createDataFrame([("A", macd)], "symbol string, body string"), "MACD").collect()
    assert {(x.indicator, x.value) for x in long} == {("macd", 1.0), ("macd_signal", 2.0), ("macd_hist", -1.0)}
    over = spark.createDataFrame([("A", '{"MarketCapitalization":"5","PERatio":"None","Sector":"Energy"}'), ("B", '{"Note":"x"}')], "symbol string, body string")
    o = vendor.overview(over).collect()
    assert len(o) == 1 and (o[0].sector, o[0].market_capitalization, o[0].pe_ratio) == ("ENERGY", 5.0, 0.0)
    earn = spark.createDataFrame([("A", '{"quarterlyEarnings":[{"fiscalDateEnding":"2024-09-30","reportedEPS":"1.2","estimatedEPS":"None"}]}')], "symbol string, body string")
    e = vendor.earnings(earn).first()
    assert (e.fiscal_date, e.reported, e.estimated) == (D(2024, 9, 30), 1.2, None)
    (tmp_path / "cal.csv").write_text("symbol,name,reportDate,fiscalDateEnding,estimate,currency\nA,Aco,2024-11-01,2024-09-30,1.5,USD\nB,Bco,2024-11-02,2024-09-30,,USD\n")
    assert [(x.symbol, x.estimate) for x in vendor.earnings_calendar(spark, str(tmp_path / "cal.csv")).orderBy("symbol").collect()] == [("A", 1.5), ("B", 0.0)]
    m = vendor.macro_series(spark.createDataFrame([("gdp", '{"data":[{"date":"2024-01-01","value":"."},{"date":"2023-10-01","value":"3.5"}]}')], "series string, body string")).orderBy("date").collect()
    assert [x.value for x in m] == [3.5, None]
    opt = vendor.options_chain(spark.createDataFrame([("A", day(0), '{"data":[{"expiration":"2021-01-30","type":"call","volume":"7","implied_volatility":"0.3"}]}')], "symbol string, date date, body string")).first()
    assert (opt.expiration, opt.volume, opt.implied_volatility) == (D(2021, 1, 30), 7.0, "0.3")
    feed = {"items": "1", "feed": [{"url": "u", "time_published": "20240102T030405", "ticker_sentiment": [
        {"ticker": "A", "ticker_sentiment_score": "0.25"}, {"ticker": "B", "ticker_sentiment_score": "x"}]}]}
    n = vendor.news(spark.createDataFrame([(json.dumps(feed),)], "body string")).orderBy("symbol").collect()
    assert [(x.symbol, x.score) for x in n] == [("A", 0.25), ("B", 0.0)] and n[0].ts == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_files_by_age_and_name(spark, tmp_path):
    import os
    for name, age in (("b_prices.csv", 0), ("a_prices.csv", 0), ("old_prices.json", 7200)):
        p = tmp_path / name
        p.write_text("x")
        t = dt.datetime.now().timestamp() - age
        os.utime(p, (t, t))
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    assert sorted(r.name for r in files.changed_since(spark, str(tmp_path), 30, now).collect()) == ["a_prices.csv", "b_prices.csv"]
    assert files.first_named(spark, str(tmp_path), "prices", ".csv").first().name == "a_prices.csv"
    assert files.first_named(spark, str(tmp_path), "nothing", ".csv").count() == 0
    assert sorted(r.name for r in files.named_any(spark, str(tmp_path), ["old", "b_"], "prices").collect()) == ["b_prices.csv", "old_prices.json"]


def test_model_store_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("k1", [1.0, 2.0], 0.5), ("k2", [3.0, 4.0], 0.1)], "model_key string, coef array<double>, intercept double")
    path = str(tmp_path / "models")
    model_store.save_linear(m, path)
    model_store.save_linear(m.filter("model_key = 'k1'").withColumn("intercept", F.lit(9.0)), path)
    got = {r.model_key: (r.coef, r.intercept) for r in model_store.load_linear(spark, path).collect()}
    assert got == {"k1": ([1.0, 2.0], 9.0), "k2": ([3.0, 4.0], 0.1)}
    assert model_store.load_linear(spark, path, ["k2"]).count() == 1


def test_sql_sees_the_given_null_rules_of_the_log(spark):
    trained = spark.createDataFrame([("m", day(0), 1.0, 2.0), ("m", day(1), 1.0, 2.0), ("m", day(2), 1.0, 2.0)], "model_key string, date date, actual double, predicted double")
    log = spark.createDataFrame([("m", day(0), 1, 5.0, 7.0, True), ("m", day(1), 1, 5.0, None, True), ("m", day(2), 1, 5.0, None, False), ("m", day(3), 1, 5.0, 8.0, True)],
                                "model_key string, date date, record int, last_known_price double, predicted double, has_predicted boolean")
    got = [r.predicted for r in reports.merged_predictions(trained, log).orderBy("date").collect()]
    assert got == [7.0, None, 2.0, 8.0]


def test_explanation_left_join_keeps_models_without_one(spark):
    m = spark.createDataFrame([("a",), ("b",)], "model_key string")
    e = spark.createDataFrame([("a", "text")], "model_key string, explanation string")
    assert {r.model_key: r.explanation for r in reports.with_explanation(m, e).collect()} == {"a": "text", "b": None}


def test_clean_response(spark):
    rows = ['{"a_b": 1, "c": null}', '```json\n{"x!": "y"}\n```', "nonsense", '{"only": null}', '{"k-": "1", "k_": "2"}', ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.m for r in text.clean_responses(df, "t", "m").orderBy("i").collect()]
    assert got == [{"ab": "1"}, {"x": "y"}, None, None, {"k": "2"}, None]


def test_explanation_parts(spark):
    t = "\n".join(["**Conclusion:** ignored rest", "one", "  two ", "", "**Performance Metrics:**", "- **A:** 0.5 - fine - really", "not a bullet",
                   "- plain", "**Key Influencing Features:**", "- 'f' (0.1) and 'g'(0.2)", "loose", "**Additional Notes:**", "end"])
    s = text.explanation_sections(text.explanation_lines(spark.createDataFrame([(t,)], "explanation string")))
    r = s.first()
    assert (r.conclusion, r.additional_notes) == ("one two", "loose end")
    b = text.bullets(s.select("performance_metrics"), "performance_metrics").collect()
    assert [(x.name, x["value"], x.numeric_value, x.description) for x in b] == [("A", "0.5", 0.5, "fine - really"), ("", "", None, "plain")]
    f = text.feature_pairs(s.select(F.explode("key_features").alias("line")), "line").collect()
    assert [(x.name, x.numeric_value) for x in f] == [("f", 0.1), ("g", 0.2)]


def test_scoring_dates_match_pandas(spark):
    import pandas as pd
    for end, h in ((D(2024, 3, 15), 7), (D(2024, 3, 16), 30), (D(2024, 3, 17), 8)):
        got = spark.range(1).select(scalars.scoring_dates(F.lit(end), F.lit(h)).alias("d")).first().d
        want = sorted({*pd.bdate_range(end=end, periods=h), *pd.bdate_range(start=end, end=end + dt.timedelta(days=h))})
        assert got == [w.date() for w in want]


def test_metrics_edge_rows(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("b", 0.0, 0.0), ("b", 4.0, 3.0)], "m string, y double, p double")
    got = {r.m: r.mape for r in evaluate.regression_metrics(df, ["m"], "y", "p").collect()}
    assert got == {"a": 9999.0, "b": 25.0}
    c = spark.createDataFrame([("a", 0, 0), ("a", 0, 0)], "m string, y int, p int")
    r = evaluate.classification_metrics(c, ["m"], "y", "p").first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 0.0, 0.0, 0.0)
    assert evaluate.roc_auc(c.withColumn("s", F.lit(0.5)), ["m"], "y", "s").first().roc_auc is None
    assert evaluate.class_ratio(c, ["m"], "y").first().ratio == 1.0
    assert sum(r.n for r in evaluate.histogram(df, "y").collect()) == 4


def test_auc_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [("m", rng.randrange(2), rng.choice([0.1, 0.4, 0.4001, 0.9, 1.0])) for _ in range(200)]
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    got = evaluate.roc_auc(spark.createDataFrame(rows, "m string, y int, s double"), ["m"], "y", "s").first().roc_auc
    assert got == pytest.approx(want)


def test_trades_sell_on_due_day_or_at_the_end(spark):
    rows = [("m", day(i), 100.0 + i, 200.0 if i in (3, 4) else 0.0) for i in (0, 1, 2, 3, 4, 7)]
    s = backtest.signals(spark.createDataFrame(rows, "model_key string, date date, price double, predicted double"), 2)
    t = {r.buy_date: (r.sell_date, r.sell_price) for r in backtest.trades(s, 2).collect()}
    assert t == {day(1): (day(3), 103.0), day(2): (day(3), 103.0)}
    one = backtest.trade_statistics(spark.createDataFrame([("m", 0.1, 100.0)], "model_key string, trade_return double, pnl double")).first()
    assert one.sharpe is None and one.hit_rate == 1.0


def test_drawdown_never_positive(spark):
    t = spark.createDataFrame([("m", day(i), x) for i, x in enumerate((100.0, -300.0, 50.0, 400.0))], "model_key string, sell_date date, pnl double")
    got = [r.drawdown for r in backtest.equity_curve(t).orderBy("date").collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(-300 / 10100) and got[3] == 0.0 and max(got) <= 0.0


def test_folds_train_before_test(spark):
    df = spark.createDataFrame([("s", day(i)) for i in range(23)], "symbol string, date date")
    f = select.expanding_folds(df).toPandas()
    for k in (1, 2, 3):
        g = f[f["fold"] == k]
        assert g[g["role"] == "train"]["date"].max() < g[g["role"] == "test"]["date"].min()
        assert (g["role"] == "test").sum() == 23 // 4
    assert f[(f["fold"] == 3) & (f["role"] == "test")]["date"].max() == day(22)


def test_request_errors(spark):
    df = spark.createDataFrame([("AAPL", 700, 30, "LOW", "basic"), ("TOOLONG", 10, 99, "low", None)], "s string, l int, h int, t string, f string")
    got = [r.e for r in df.select(scalars.request_errors(*[F.col(c) for c in "slhtf"]).alias("e")).collect()]
    assert got == [[], ["symbol", "lookback", "horizon", "tuning", "feature_set"]]


def test_upsert_of_repeated_and_null_keys(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    batch = spark.createDataFrame([("a", 5), ("a", 7), (None, 9), ("b", 1)], "k string, v int")
    once = tables.upsert(old, batch, ["k"])
    want = {("a", 7), (None, 9), ("b", 1)}
    assert sorted(map(tuple, once.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, tables.upsert(once, batch, ["k"]).collect()), key=str) == sorted(want, key=str)


def test_upsert_finishes_what_an_earlier_run_staged(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, "p"), ("b", 2, "q")], "k string, v int, part string")
    tables.upsert_table(spark, path, first, ["k"], "part")
    spark.createDataFrame([("a", 10, "p")], "k string, v int, part string").write.mode("overwrite").parquet(f"{path}_staged")
    tables.upsert_table(spark, path, spark.createDataFrame([("b", 3, "q")], "k string, v int, part string"), ["k"], "part")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 10), ("b", 3)}


def test_every_database_type_is_known(spark):
    from marketframe.schemas import TYPE_MAP, spark_type
    for name in TYPE_MAP:
        assert spark_type(name) and spark_type(name.upper())
    assert spark_type("varchar(20)") == "string" and spark_type("numeric(10,2)") == "decimal(10,2)" and spark_type("timestamp(6) without time zone") == "timestamp_ntz"
    assert spark_type("text[]") == "array<string>" and spark_type("no such type") is None
    df = spark.createDataFrame([("1", "(1,2)", "x")], "a string, b string, c string")
    assert tables.conform(df, {"a": "int", "b": "point", "c": "no such type"}).first() == (1, "(1,2)", "x")


def test_asof_needs_dates(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int").withColumn("ts", F.current_timestamp())
    with pytest.raises(TypeError):
        asof_join(df, df, ["k"], "ts", "ts", ["v"])


def test_late_ticks_and_bars(spark, tmp_path):
    from marketframe.plans.stream_queries import _upserted
    from marketframe.streaming import live
    schema = "symbol string, ts timestamp, price double, size int"
    batches = [[("A", "2024-01-01 10:00:00", 1.0, 1), ("A", "2024-01-02 10:00:00", 2.0, 1)], [("A", "2024-01-01 11:00:00", 5.0, 1)],
               [("A", "2024-01-20 10:00:00", 3.0, 1)], [("A", "2024-01-20 11:00:00", 4.0, 1)], [("A", "2024-01-01 12:00:00", 9.0, 1)]]
    for rows in batches:
        spark.createDataFrame(rows, "symbol string, ts string, price double, size int").withColumn("ts", F.to_timestamp("ts")).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))

    class Here:
        pass
    here = Here()
    here.spark = spark
    got = {str(r.date): (r.open, r.close, r.volume) for r in _upserted(here, live.daily_bars(stream)).collect()}
    # an hour late still counts, nineteen days late no more
    assert got == {"2024-01-01": (1.0, 5.0, 2), "2024-01-02": (2.0, 2.0, 1), "2024-01-20": (3.0, 4.0, 2)}


def test_advanced_features_and_lags(spark, small):
    from marketframe.plans import Inputs
    from marketframe.plans.join_queries import enriched
    from marketframe.plans.features import LAGGED, feature_table
    from marketframe.schemas import ADVANCED_FEATURES, ENRICHED_STOCK_DATA, columns
    stock = enriched(Inputs(spark, small)).where("symbol IN ('Brand#1', 'Brand#7')").cache()
    assert dict(stock.dtypes) == {c: k.replace("long", "bigint") for c, k in columns(ENRICHED_STOCK_DATA).items()}
    got = feature_table(stock, 7, "advanced", lags=True).toPandas()
    assert set(ADVANCED_FEATURES) <= set(got.columns) and got.notna().all().all()
    base = stock.toPandas().sort_values(["symbol", "date"])
    base = base.groupby("symbol", group_keys=False)[base.columns.tolist()].apply(lambda g: g.ffill())
    for c, n in [(c, n) for c in LAGGED["advanced"] for n in (1, 7, 30)] + [("sentiment_score", 1)]:
        base[f"{c}_lag_{n}"] = base.groupby("symbol")[c].shift(n)
    both = got.merge(base, on=["symbol", "date"], suffixes=("", "_base"))
    assert len(both) == len(got) > 0
    for c in [x for x in got.columns if "_lag_" in x]:
        assert (both[c] - both[f"{c}_base"]).abs().max() < 1e-9
