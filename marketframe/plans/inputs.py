"""Market tables derived from the given tables, as Spark plans and as SQL for the check.

Prices are floored to whole cents and averaged as integers, so that both engines
start from identical values.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.operators import series
from marketframe.operators.landing import land

HORIZON = 7

# A sale's place in its day and its price as one number, so that the first and the last price of a
# day are plain minima and maxima: those aggregate by hash, where an order of several columns would sort.
_PRICE_DIGITS = 10 ** 12


def _cents(c):
    return F.round(F.col(c) * 100).cast("long")


def _mean_cents(c):
    return F.sum(c) / F.lit(100.0) / F.count(c)


class Inputs:
    """Lazy plans over one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        """One row per sale: symbol, date, price in cents, quantity."""
        part = self.table("part").select("p_partkey", "p_brand", "p_type")
        price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
        place = F.col("l_orderkey").cast("decimal(24,0)") * 10 + F.col("l_linenumber")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("symbol"), "p_type", F.to_date("l_shipdate").alias("date"), price.alias("px_c"),
            (place * F.lit(_PRICE_DIGITS) + price).cast("decimal(38,0)").alias("ord"), "l_quantity", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_orderkey", "l_partkey")

    @staticmethod
    def _bars(trades: DataFrame, symbol: str) -> DataFrame:
        px = F.col("px_c")
        days = trades.groupBy(F.col(symbol).alias("symbol"), "date").agg(
            F.min("ord").alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max("ord").alias("close"),
            F.sum("l_quantity").alias("volume"))

        def dollars(c):
            return F.col(c).cast("long") / F.lit(100.0)
        days = days.withColumns({c: F.pmod(F.col(c), F.lit(_PRICE_DIGITS)) for c in ("open", "close")})
        return days.withColumns({c: dollars(c) for c in ("open", "high", "low", "close")})

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars, landed once: they are far smaller than the sales, and positions read them twice."""
        return land(self._bars(self.trades, "symbol"))

    @cached_property
    def bars_dense(self) -> DataFrame:
        return self._bars(self.trades, "l_returnflag")

    @cached_property
    def bars_split(self) -> DataFrame:
        p = series.with_position(self.bars, ["symbol"], "date", pos="pos", size="size")
        third = F.floor(F.col("size") / 3)
        return p.withColumn("split_coef", F.when(F.col("pos") == third, 2.0).when(
            F.col("pos") == 2 * third, 4.0).otherwise(1.0)).drop("pos", "size")

    @cached_property
    def calendar(self) -> DataFrame:
        return self.table("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()

    @cached_property
    def index_bars(self) -> DataFrame:
        spy = self.trades.groupBy("date").agg(_mean_cents("px_c").alias("close")).withColumn("idx", F.lit("SPY"))
        qqq = self.trades.filter("l_linestatus = 'O'").groupBy("date").agg(
            _mean_cents("px_c").alias("close")).withColumn("idx", F.lit("QQQ"))
        return spy.unionByName(qqq)

    @cached_property
    def sector(self) -> DataFrame:
        part = self.table("part")
        kinds = part.groupBy(F.col("p_type").alias("sector")).agg(F.count(F.lit(1)).alias("n"))
        kinds = kinds.withColumn("k", F.row_number().over(Window.orderBy("sector")) - 1).drop("n")
        brands = part.select(F.col("p_brand").alias("symbol")).distinct().withColumn(
            "k", F.substring("symbol", 7, 9).cast("int") % 6)
        return brands.join(kinds, "k").select(
            "symbol", "sector", F.concat(F.lit("ETF_"), "sector").alias("etf"))

    @cached_property
    def etf_bars(self) -> DataFrame:
        return self.trades.groupBy(F.concat(F.lit("ETF_"), "p_type").alias("etf"), "date").agg(
            _mean_cents("px_c").alias("close"))

    @cached_property
    def overview(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_brand").alias("symbol")).agg(
            (F.sum(_cents("p_retailprice")) / F.lit(100.0)).alias("market_capitalization"),
            (F.sum(F.col("p_size").cast("long")) / F.count("p_size")).alias("pe_ratio"),
            (F.min("p_size") / F.lit(100.0)).alias("dividend_yield"), (F.max("p_size") / F.lit(50.0)).alias("beta"))

    @cached_property
    def macro(self) -> DataFrame:
        o = self.table("orders").select(
            F.to_date("o_orderdate").alias("d"), _cents("o_totalprice").alias("c"), "o_orderpriority")

        def one(name, unit, cond):
            return o.filter(cond).groupBy(F.trunc("d", unit).alias("date")).agg(
                _mean_cents("c").alias("value")).withColumn("series", F.lit(name))
        return one("gdp", "quarter", F.lit(True)).unionByName(
            one("inflation", "year", "o_orderpriority = '1-URGENT'")).unionByName(
            one("unemployment", "month", "o_orderpriority = '2-HIGH'"))

    @cached_property
    def earnings(self) -> DataFrame:
        quarter_end = F.last_day(F.add_months(F.trunc("date", "quarter"), 2))
        g = self.trades.groupBy("symbol", quarter_end.alias("fiscal_date")).agg(
            _mean_cents(_cents("l_discount")).alias("reported"), _mean_cents(_cents("l_tax")).alias("estimated"))
        diff = F.col("reported") - F.col("estimated")
        return g.withColumn("surprise", diff).withColumn("surprise_pct", F.try_divide(diff, "estimated"))

    @cached_property
    def earnings_calendar(self) -> DataFrame:
        w = Window.partitionBy("symbol").orderBy("fiscal_date")
        day = F.when(F.row_number().over(w) % 7 == 0, F.col("fiscal_date")).otherwise(F.date_add("fiscal_date", 20))
        return self.earnings.select("symbol", day.alias("report_date"), F.lead("estimated").over(w).alias("estimate"))

    @cached_property
    def options(self) -> DataFrame:
        return self.trades.select(
            "symbol", "date", F.date_add("date", (10 + F.col("l_partkey") % 50).cast("int")).alias("expiration"),
            F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("type"),
            F.col("l_quantity").alias("volume"),
            F.when(F.col("l_orderkey") % 11 == 0, "None").otherwise(
                F.col("l_discount").cast("string")).alias("implied_volatility"))

    @cached_property
    def news(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("article_id"),
            (F.col("value") / 100).alias("score"))

    @cached_property
    def bar_news(self) -> DataFrame:
        """The same articles, dealt to the symbols that have bars, on days that have bars."""
        return self.table("events").select(
            F.concat(F.lit("Brand#"), (F.col("event_id") % 25 + 1).cast("string")).alias("symbol"),
            F.expr("CAST(ts AS timestamp_ntz) - INTERVAL 27 YEAR").alias("ts"), F.col("event_id").alias("article_id"), (F.col("value") / 100).alias("score"))

    @cached_property
    def predictions(self) -> DataFrame:
        """Per bar: what followed HORIZON rows later, and a made-up forecast of it."""
        c = series.chunked(self.bars, ["symbol"], "date", before=0, after=HORIZON)
        rn = F.col(series.POS) + 1
        rows = c.withColumn("actual", F.lead("close", HORIZON).over(series.chunk_window(["symbol"]))).select(
            "*", (F.col("close") * (1 + ((rn % 21) - 10) / F.lit(200.0))).alias("predicted"),
            ((rn * 37) % 101 / F.lit(100.0)).alias("proba"))
        return series.own_rows(rows).select(
            F.col("symbol").alias("model_key"), "symbol", "date", "close", "actual", "predicted", "proba",
            (F.col("actual") > F.col("close")).cast("int").alias("label"),
            (F.col("proba") > 0.5).cast("int").alias("pred_label"))

    @cached_property
    def registry(self) -> DataFrame:
        k = F.col("o_orderkey")
        day = F.to_date("o_orderdate")
        horizon = (7 + k % 24).cast("int")
        return self.table("orders").select(
            F.concat(F.lit("m"), k.cast("string")).alias("model_key"),
            F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("symbol"),
            day.alias("input_date"), horizon.alias("horizon"), (720 + k % 481).cast("int").alias("lookback"),
            F.when(k % 2 == 0, "basic").otherwise("advanced").alias("feature_set"),
            F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (1 + k % 3).cast("int")).alias("tuning"),
            ((k * 7919) % 1000 / F.lit(1000.0)).alias("f1"), (F.col("o_totalprice") / 1000).alias("mape"),
            F.date_add(day, horizon).alias("prediction_date"), day.alias("date_created"),
            (F.floor(F.col("o_totalprice") / 100) / F.lit(10.0)).alias("start_price"),
            F.when(k % 2 == 0, "Up").otherwise("Down").alias("movement"), k.alias("k"))

    @cached_property
    def params_json(self) -> DataFrame:
        return self.registry.select("*", F.to_json(F.struct(
            F.col("tuning").alias("hyperparameter_tuning"), "feature_set", F.col("horizon").alias("prediction_horizon"),
            F.col("input_date").cast("string").alias("input_date"), F.col("lookback").alias("lookback_period"),
        )).alias("model_parameters"))

    @cached_property
    def importance_json(self) -> DataFrame:
        """Eight features per model in the stored shape {"feature":{i:name},"importance":{i:value}}."""
        names = F.concat_ws(",", *[F.format_string(f'"{i}":"f%d"', ((F.col("k") + 3 * i) % 20)) for i in range(8)])
        vals = F.concat_ws(",", *[F.format_string(f'"{i}":0.%03d', ((F.col("k") * (i + 7)) % 997)) for i in range(8)])
        return self.registry.select("model_key", "f1", F.concat(
            F.lit('{"feature":{'), names, F.lit('},"importance":{'), vals, F.lit("}}")).alias("feature_importance"))

    @cached_property
    def explanation_text(self) -> DataFrame:
        k = F.col("k")
        text = F.concat_ws(
            "\n", F.lit("**Conclusion:**"), F.concat(F.lit("The model for "), "symbol", F.lit(" says "), "movement"),
            F.lit("Second line"), F.lit(""), F.lit("**Performance Metrics:**"),
            F.format_string("- **F1 Score:** 0.%03d - a plain value", (k * 7919) % 1000),
            F.format_string("- **Recall:** %d%% - well - known", k % 100), F.lit("- no colon here"),
            F.lit("**Key Influencing Features:**"),
            F.format_string("- 'gdp' (0.%02d), 'sma_50' (0.%02d)", k % 97, k % 89), F.lit("- none named"),
            F.lit("**Model Parameters:**"), F.concat(F.lit("- **Tuning:** "), "tuning"),
            F.lit("**Additional Notes:**"), F.lit("Use with care"))
        return self.registry.select("model_key", text.alias("explanation"))

    @cached_property
    def responses(self) -> DataFrame:
        """Answer texts: plain JSON, fenced JSON, broken JSON; some without an amount."""
        k = F.col("k")
        amount = F.when(k % 4 == 0, F.lit("null")).otherwise(F.format_string("%d", F.floor(F.col("mape")).cast("long")))
        body = F.concat(
            F.lit('{"predicted_amount": '), amount, F.lit(', "up_or_down!": "'), "movement",
            F.lit('", "prediction_explanation": "for '), "symbol", F.lit('"}'))
        body = F.when(k % 5 == 0, F.concat(F.lit("sorry, "), body)).otherwise(body)
        return self.registry.select(
            "model_key", "symbol", "input_date", "prediction_date", k.alias("k"),
            F.when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("text"))

    @cached_property
    def upsert_batch(self) -> DataFrame:
        """The bars again, 30 days later and one up, every key twice: the row with ord = 2 must win."""
        moved = self.bars.withColumn("date", F.date_add("date", 30))
        return moved.select("symbol", "date", "open", "high", "low", (F.col("close") + 1).alias("close"), "volume",
                            F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).withColumn(
            "close", F.col("close") + F.col("ord"))

    @cached_property
    def pred_log(self) -> DataFrame:
        """Log records per model and date: record 1 for every second date, record 2 for every third, some fields empty."""
        p = self.predictions
        d = F.unix_date("date")
        one = p.filter(d % 2 == 0).select(
            "model_key", "date", F.lit(1).alias("record"), F.col("close").alias("last_known_price"),
            (F.col("predicted") + 1).alias("predicted"), F.lit(True).alias("has_predicted"))
        two = p.filter(d % 3 == 0).select(
            "model_key", "date", F.lit(2).alias("record"), F.col("close").alias("last_known_price"),
            F.lit(None).cast("double").alias("predicted"), (d % 5 == 0).alias("has_predicted"))
        return one.unionByName(two)


_MEAN = "sum({0}) / CAST(100 AS DOUBLE) / count({0})"
_ORD = "l_orderkey, l_linenumber, px_c"


def _bars_sql(symbol: str) -> str:
    return f"""
    SELECT {symbol} AS symbol, date, first(px_c ORDER BY {_ORD}) / 100 AS open, max(px_c) / 100 AS high,
           min(px_c) / 100 AS low, last(px_c ORDER BY {_ORD}) / 100 AS close, sum(l_quantity) AS volume
    FROM trades GROUP BY ALL"""


def _macro_sql(name: str, unit: str, cond: str) -> str:
    return f"""SELECT '{name}' AS series, CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS date,
      {_MEAN.format("CAST(round(o_totalprice * 100) AS BIGINT)")} AS value FROM orders WHERE {cond} GROUP BY ALL"""


CTES: dict[str, str] = {
    "trades": """
    SELECT p_brand AS symbol, p_type, CAST(l_shipdate AS DATE) AS date,
           CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS px_c, lineitem.*
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bars": _bars_sql("symbol"),
    "bars_dense": _bars_sql("l_returnflag"),
    "bars_split": """
    SELECT symbol, date, open, high, low, close, volume,
           CASE WHEN pos = size // 3 THEN 2.0::DOUBLE WHEN pos = 2 * (size // 3) THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS split_coef
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos,
                 count(*) OVER (PARTITION BY symbol) AS size FROM bars)""",
    "calendar": "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem",
    "index_bars": f"""
    SELECT 'SPY' AS idx, date, {_MEAN.format("px_c")} AS close FROM trades GROUP BY ALL
    UNION ALL SELECT 'QQQ' AS idx, date, {_MEAN.format("px_c")} AS close FROM trades WHERE l_linestatus = 'O' GROUP BY ALL""",
    "sector": """
    SELECT b.symbol, k.sector, 'ETF_' || k.sector AS etf
    FROM (SELECT DISTINCT p_brand AS symbol, CAST(substr(p_brand, 7) AS INT) % 6 AS k FROM part) b
    JOIN (SELECT p_type AS sector, row_number() OVER (ORDER BY p_type) - 1 AS k FROM part GROUP BY p_type) k ON b.k = k.k""",
    "etf_bars": f"SELECT 'ETF_' || p_type AS etf, date, {_MEAN.format('px_c')} AS close FROM trades GROUP BY ALL",
    "overview": """
    SELECT p_brand AS symbol, sum(CAST(round(p_retailprice * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS market_capitalization,
           CAST(sum(p_size) AS DOUBLE) / count(p_size) AS pe_ratio, min(p_size) / 100 AS dividend_yield, max(p_size) / 50 AS beta
    FROM part GROUP BY p_brand""",
    "macro": " UNION ALL ".join([
        _macro_sql("gdp", "quarter", "true"), _macro_sql("inflation", "year", "o_orderpriority = '1-URGENT'"),
        _macro_sql("unemployment", "month", "o_orderpriority = '2-HIGH'")]),
    "earnings": f"""
    SELECT *, reported - estimated AS surprise, (reported - estimated) / nullif(estimated, 0) AS surprise_pct FROM (
      SELECT symbol, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS fiscal_date,
        {_MEAN.format("CAST(round(l_discount * 100) AS BIGINT)")} AS reported,
        {_MEAN.format("CAST(round(l_tax * 100) AS BIGINT)")} AS estimated
      FROM trades GROUP BY ALL)""",
    "earnings_calendar": """
    SELECT symbol, CASE WHEN row_number() OVER w % 7 = 0 THEN fiscal_date ELSE fiscal_date + 20 END AS report_date,
           lead(estimated) OVER w AS estimate
    FROM earnings WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_date)""",
    "options": """
    SELECT symbol, date, date + CAST(10 + l_partkey % 50 AS INT) AS expiration,
           CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS type, l_quantity AS volume,
           CASE WHEN l_orderkey % 11 = 0 THEN 'None' ELSE CAST(l_discount AS VARCHAR) END AS implied_volatility
    FROM trades""",
    "news": "SELECT event_type AS symbol, ts, event_id AS article_id, value / 100 AS score FROM events",
    "bar_news": """
    SELECT 'Brand#' || (event_id % 25 + 1) AS symbol, CAST(ts AS TIMESTAMP) - INTERVAL 27 YEAR AS ts, event_id AS article_id,
           value / 100 AS score FROM events""",
    "predictions": f"""
    SELECT symbol AS model_key, symbol, date, close, actual, predicted, proba,
           CAST(actual > close AS INT) AS label, CAST(proba > 0.5::DOUBLE AS INT) AS pred_label
    FROM (SELECT *, close * (1 + ((rn % 21) - 10) / 200) AS predicted, ((rn * 37) % 101) / 100 AS proba
          FROM (SELECT *, lead(close, {HORIZON}) OVER w AS actual, row_number() OVER w AS rn FROM bars
                WINDOW w AS (PARTITION BY symbol ORDER BY date)))""",
    "registry": """
    SELECT 'm' || o_orderkey AS model_key, 'Brand#' || (1 + o_custkey % 25) AS symbol, CAST(o_orderdate AS DATE) AS input_date,
           CAST(7 + o_orderkey % 24 AS INT) AS horizon, CAST(720 + o_orderkey % 481 AS INT) AS lookback,
           CASE WHEN o_orderkey % 2 = 0 THEN 'basic' ELSE 'advanced' END AS feature_set,
           CASE o_orderkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS tuning,
           ((o_orderkey * 7919) % 1000) / 1000 AS f1, o_totalprice / 1000 AS mape,
           CAST(o_orderdate AS DATE) + CAST(7 + o_orderkey % 24 AS INT) AS prediction_date,
           CAST(o_orderdate AS DATE) AS date_created, floor(o_totalprice / 100) / 10 AS start_price,
           CASE WHEN o_orderkey % 2 = 0 THEN 'Up' ELSE 'Down' END AS movement, o_orderkey AS k
    FROM orders""",
    "params_json": """
    SELECT *, '{"hyperparameter_tuning":"' || tuning || '","feature_set":"' || feature_set || '","prediction_horizon":' || horizon
        || ',"input_date":"' || input_date || '","lookback_period":' || lookback || '}' AS model_parameters FROM registry""",
    "importance_json": "SELECT model_key, f1, '{\"feature\":{' || "
    + " || ',' || ".join(f"'\"{i}\":\"f' || (k + {3 * i}) % 20 || '\"'" for i in range(8))
    + " || '},\"importance\":{' || "
    + " || ',' || ".join(f"'\"{i}\":0.' || lpad(CAST((k * {i + 7}) % 997 AS VARCHAR), 3, '0')" for i in range(8))
    + " || '}}' AS feature_importance FROM registry",
    "explanation_text": """
    SELECT model_key, concat_ws(chr(10), '**Conclusion:**', 'The model for ' || symbol || ' says ' || movement, 'Second line', '',
      '**Performance Metrics:**', '- **F1 Score:** 0.' || lpad(CAST((k * 7919) % 1000 AS VARCHAR), 3, '0') || ' - a plain value',
      '- **Recall:** ' || (k % 100) || '% - well - known', '- no colon here', '**Key Influencing Features:**',
      '- ''gdp'' (0.' || lpad(CAST(k % 97 AS VARCHAR), 2, '0') || '), ''sma_50'' (0.' || lpad(CAST(k % 89 AS VARCHAR), 2, '0') || ')',
      '- none named', '**Model Parameters:**', '- **Tuning:** ' || tuning, '**Additional Notes:**', 'Use with care') AS explanation
    FROM registry""",
    "responses": """
    SELECT model_key, symbol, input_date, prediction_date, k,
           CASE WHEN k % 3 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS text
    FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'sorry, ' ELSE '' END || '{"predicted_amount": '
            || CASE WHEN k % 4 = 0 THEN 'null' ELSE CAST(CAST(floor(mape) AS BIGINT) AS VARCHAR) END
            || ', "up_or_down!": "' || movement || '", "prediction_explanation": "for ' || symbol || '"}' AS body FROM registry)""",
    "upsert_batch": """
    SELECT symbol, date + 30 AS date, open, high, low, close + 1 + ord AS close, volume, ord
    FROM bars, (VALUES (1), (2)) o(ord)""",
    "pred_log": """
    SELECT model_key, date, 1 AS record, close AS last_known_price, predicted + 1 AS predicted, true AS has_predicted
    FROM predictions WHERE (date - DATE '1970-01-01') % 2 = 0
    UNION ALL SELECT model_key, date, 2, close, NULL, (date - DATE '1970-01-01') % 5 = 0
    FROM predictions WHERE (date - DATE '1970-01-01') % 3 = 0""",
}
