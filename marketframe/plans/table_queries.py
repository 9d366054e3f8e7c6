"""Scans, casts, upserts, projections, sorting and scalar functions as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketframe.functions import scalars, text
from marketframe.operators import enrich, reports
from marketframe.operators.backtest import up_calls
from marketframe.operators.select import latest_per_key, present_columns
from marketframe.plans.catalog import query, rnd, sql_rnd
from marketframe.plans.inputs import CTES
from marketframe.schemas import BASIC_FEATURES
from marketframe.sources import tables

KEY = ["symbol", "date"]
_BAR = "symbol, date, open, high, low, close, volume"
_DAY = "(date - DATE '1970-01-01')"


# -- scans and sinks -------------------------------------------------------------------------------

@query("s6_scan_range", f"SELECT {_BAR} FROM bars WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#13') AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def _s6(t):
    return tables.scan(t.bars, ["Brand#1", "Brand#2", "Brand#13"], "1997-01-01", "1999-12-31")


@query("s7_scan_since", f"SELECT {_BAR} FROM bars WHERE symbol = 'Brand#7' AND date >= DATE '1998-06-01'")
def _s7(t):
    return tables.scan(t.bars, ["Brand#7"], "1998-06-01")


_UPSERT = """
SELECT {cols} FROM {target} t ANTI JOIN {batch} b USING ({keys})
UNION ALL SELECT {cols} FROM {batch} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC) = 1"""


@query("s9_upsert", _UPSERT.format(cols=_BAR, target="bars", batch="upsert_batch", keys="symbol, date", order="ord"))
def _s9(t):
    return tables.upsert(t.bars, t.upsert_batch, KEY, ["ord"])


@query("s15_conform", f"""
SELECT symbol, try_cast(date_text AS DATE) AS date, try_cast(open_text AS DOUBLE) AS open, try_cast(volume_text AS BIGINT) AS volume,
       try_cast(flag_text AS BOOLEAN) AS flag
FROM (SELECT symbol, CASE WHEN {_DAY} % 13 = 0 THEN 'n/a' ELSE CAST(date AS VARCHAR) END AS date_text,
        CASE WHEN {_DAY} % 7 = 0 THEN 'None' ELSE CAST(open AS VARCHAR) END AS open_text,
        CASE WHEN {_DAY} % 5 = 0 THEN '-' ELSE CAST(CAST(volume AS BIGINT) AS VARCHAR) END AS volume_text,
        CASE WHEN {_DAY} % 2 = 0 THEN 'true' ELSE 'maybe' END AS flag_text FROM bars)""")
def _s15(t):
    d = F.unix_date("date")
    raw = t.bars.select(
        "symbol", F.when(d % 13 == 0, "n/a").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(d % 7 == 0, "None").otherwise(F.col("open").cast("string")).alias("open"),
        F.when(d % 5 == 0, "-").otherwise(F.col("volume").cast("long").cast("string")).alias("volume"),
        F.when(d % 2 == 0, "true").otherwise("maybe").alias("flag"))
    return tables.conform(raw, {"symbol": "varchar", "date": "date", "open": "double precision", "volume": "bigint", "flag": "boolean"})


@query("s19_json_records", """
SELECT '{"symbol":"' || symbol || '","date":"' || date || '","close":' || close || '}' AS record FROM bars""")
def _s19(t):
    return tables.json_records(t.bars, ["symbol", "date", "close"])


@query("s21_backfill", """
SELECT DISTINCT b.symbol, b.date, b.close FROM bars b JOIN registry r ON r.symbol = b.symbol AND b.date BETWEEN r.input_date - 1 AND r.input_date""")
def _s21(t):
    requests = t.registry.select("symbol", F.date_sub("input_date", 1).alias("start"), F.col("input_date").alias("end"))
    return enrich.backfill(requests, t.bars).select("symbol", "date", "close")


# -- projections and predicates --------------------------------------------------------------------

@query("p1_date_range", f"SELECT {_BAR} FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '2000-02-29'")
def _p1(t):
    return t.bars.filter(F.col("date").between(F.lit("1996-03-01").cast("date"), F.lit("2000-02-29").cast("date")))


@query("p2_finite_close", f"""
SELECT symbol, date, close FROM (SELECT symbol, date, CASE {_DAY} % 9 WHEN 0 THEN CAST('inf' AS DOUBLE) WHEN 1 THEN CAST('-inf' AS DOUBLE)
  WHEN 2 THEN NULL ELSE close END AS close FROM bars) WHERE isfinite(close)""")
def _p2(t):
    d = F.unix_date("date") % 9
    odd = t.bars.select(*KEY, F.when(d == 0, F.lit(float("inf"))).when(d == 1, F.lit(float("-inf"))).when(
        d == 2, F.lit(None)).otherwise(F.col("close")).alias("close"))
    return odd.withColumn("close", scalars.finite(F.col("close"))).na.drop(subset=["close"])


@query("p3_complete_rows", "SELECT symbol, date, sp500_return, nasdaq_return FROM basic_rows WHERE sp500_return IS NOT NULL AND nasdaq_return IS NOT NULL")
def _p3(t):
    return enrich.join_index_returns(t.bars, t.index_bars).select(*KEY, "sp500_return", "nasdaq_return").na.drop()


@query("p4_present_columns", "SELECT volume, open, high, low, close FROM bars")
def _p4(t):
    return present_columns(t.bars, BASIC_FEATURES)


@query("p5_text_to_number", """
SELECT symbol, date, expiration, type, count(try_cast(implied_volatility AS DOUBLE)) AS n,
  sum(coalesce(CAST(round(try_cast(implied_volatility AS DOUBLE) * 100) AS BIGINT), 0)) AS cents FROM options GROUP BY ALL""")
def _p5(t):
    iv = scalars.number_or(F.col("implied_volatility"))
    return t.options.groupBy(*KEY, "expiration", "type").agg(
        F.count(iv).alias("n"), F.sum(F.round(scalars.number_or(F.col("implied_volatility"), 0.0) * 100).cast("long")).alias("cents"))


@query("p6_model_filter", """
SELECT symbol, json_extract_string(model_parameters, '$.input_date') AS start_date, prediction_date AS end_date, start_price, movement
FROM params_json WHERE f1 > 0.82 AND prediction_date < DATE '2000-01-01'""")
def _p6(t):
    m = t.params_json.filter((F.col("f1") > 0.82) & (F.col("prediction_date") < F.lit("2000-01-01").cast("date")))
    return m.select("symbol", F.get_json_object("model_parameters", "$.input_date").alias("start_date"),
                    F.col("prediction_date").alias("end_date"), "start_price", "movement")


@query("p7_up_calls", "SELECT model_key, symbol, movement FROM registry WHERE movement = 'Up'")
def _p7(t):
    return up_calls(t.registry).select("model_key", "symbol", "movement")


@query("p9_trading_day_guard", """
SELECT model_key, input_date, CASE WHEN input_date > DATE '2000-06-30' THEN 'future' END AS reason
FROM registry SEMI JOIN calendar c ON c.date = input_date""")
def _p9(t):
    trading = t.registry.join(t.calendar.withColumnRenamed("date", "input_date"), "input_date", "left_semi")
    return trading.select("model_key", "input_date", F.when(
        F.col("input_date") > F.lit("2000-06-30").cast("date"), "future").alias("reason"))


@query("p10_request_errors", """
SELECT model_key, concat_ws(',', CASE WHEN length(symbol) > 6 THEN 'symbol' END, CASE WHEN lookback * 3 - 900 NOT BETWEEN 365 AND 2000 THEN 'lookback' END,
  CASE WHEN horizon * 3 NOT BETWEEN 7 AND 60 THEN 'horizon' END) AS errors FROM registry""")
def _p10(t):
    errors = scalars.request_errors(F.col("symbol"), F.col("lookback") * 3 - 900, F.col("horizon") * 3, F.col("tuning"), F.col("feature_set"))
    return t.registry.select("model_key", F.array_join(errors, ",").alias("errors"))


@query("p11_model_category", """
SELECT model_key, CASE k % 3 WHEN 0 THEN 'classification' WHEN 1 THEN 'regression' ELSE 'general' END AS category FROM registry""")
def _p11(t):
    words = F.element_at(F.array(F.lit("Binary CLASSIFIER run"), F.lit("Regression with SARIMAX"), F.lit("Other")), (F.col("k") % 3 + 1).cast("int"))
    return t.registry.select("model_key", text.model_category(words).alias("category"))


# -- order, limits, sets ---------------------------------------------------------------------------

@query("o1_latest_rows_json", """
SELECT symbol, count(*) AS n, '[' || string_agg('{"date":"' || date || '","close":' || close || '}', ',' ORDER BY date DESC) || ']' AS rows_json
FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 400) GROUP BY symbol""")
def _o1(t):
    return reports.latest_rows_json(t.bars, ["symbol"], "date", ["close"], 400)


@query("o2_latest_row", f"SELECT {_BAR} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
def _o2(t):
    return latest_per_key(t.bars, ["symbol"], ["date"])


@query("o3_top_recent_models", """
WITH recent AS (SELECT * FROM registry WHERE date_created >= DATE '2001-07-01')
(SELECT 'f1' AS list, model_key, f1 AS score FROM recent ORDER BY f1 DESC, model_key LIMIT 5)
UNION ALL (SELECT 'mape', model_key, mape FROM recent ORDER BY mape, model_key LIMIT 5)""")
def _o3(t):
    since = F.lit("2001-07-01").cast("date")
    f1 = reports.recent_top_models(t.registry, since, "f1")
    mape = reports.recent_top_models(t.registry, since, "mape", "low")
    return f1.select(F.lit("f1").alias("list"), "model_key", F.col("f1").alias("score")).unionByName(
        mape.select(F.lit("mape").alias("list"), "model_key", F.col("mape").alias("score")))


@query("o5_distinct_dates", "SELECT date FROM calendar UNION SELECT input_date FROM registry")
def _o5(t):
    return t.calendar.unionByName(t.registry.select(F.col("input_date").alias("date"))).distinct()


CTES["importance_rows"] = """
SELECT model_key, f1, i, json_extract_string(feature_importance, '$.feature."' || i || '"') AS feature,
  CAST(json_extract_string(feature_importance, '$.importance."' || i || '"') AS DOUBLE) AS importance
FROM importance_json, range(8) r(i)"""


@query("o6_top_features", f"""
SELECT model_key, feature, importance, rn, {sql_rnd('importance / nullif(max(importance) OVER (PARTITION BY model_key), 0)')} AS relative
FROM (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY importance DESC, i) AS rn FROM importance_rows) WHERE rn <= 6""")
def _o6(t):
    return reports.top_features(text.importance_rows(t.importance_json)).select(
        "model_key", "feature", "importance", "rn", rnd("relative").alias("relative"))


@query("u3_latest_log", "SELECT model_key, date, record, last_known_price, predicted, has_predicted FROM pred_log QUALIFY row_number() OVER (PARTITION BY model_key, date ORDER BY record DESC) = 1")
def _u3(t):
    return reports.latest_log(t.pred_log)


# -- scalar functions ------------------------------------------------------------------------------

@query("f1_dates", f"""
SELECT model_key, strftime(prediction_date, '%Y-%m-%d') AS day_text, input_date + lookback AS due, prediction_date - input_date AS gap,
  CAST(strptime('2024-01-' || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0'), '%Y-%m-%d') AS DATE) AS parsed FROM registry""")
def _f1(t):
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("k") % 28).cast("string"), 2, "0"))
    return t.registry.select("model_key", F.date_format("prediction_date", "yyyy-MM-dd").alias("day_text"),
                             F.date_add("input_date", F.col("lookback")).alias("due"),
                             F.date_diff("prediction_date", "input_date").alias("gap"), F.to_date(day, "yyyy-MM-dd").alias("parsed"))


@query("f2_business_days", """
SELECT model_key, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM (
  SELECT model_key, CAST(unnest(generate_series(CAST(input_date AS TIMESTAMP), CAST(prediction_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM registry)
WHERE isodow(d) <= 5 GROUP BY model_key""")
def _f2(t):
    days = scalars.business_days(F.col("input_date"), F.col("prediction_date"))
    out = t.registry.select("model_key", days.alias("d"))
    return out.select("model_key", F.size("d").alias("n"), F.array_min("d").alias("first_day"), F.array_max("d").alias("last_day"))


@query("f3_math", f"""
SELECT symbol, date, {sql_rnd('ln(close)')} AS log_close, {sql_rnd('exp(open / 1000000)')} AS exp_open, abs(close - open) AS move, CAST(sign(close - open) AS INT) AS side,
  round(volume * 2) AS doubled, greatest(open, close) AS top, least(open, close) AS bottom, greatest(close - open, 0) AS gain FROM bars""")
def _f3(t):
    diff = F.col("close") - F.col("open")
    return t.bars.select(*KEY, rnd(F.ln("close")).alias("log_close"), rnd(F.exp(F.col("open") / 1000000)).alias("exp_open"),
                         F.abs(diff).alias("move"), F.signum(diff).cast("int").alias("side"), F.round(F.col("volume") * 2).alias("doubled"),
                         F.greatest("open", "close").alias("top"), F.least("open", "close").alias("bottom"),
                         F.greatest(diff, F.lit(0.0)).alias("gain"))


@query("f4_price_from_return", f"SELECT model_key, date, {sql_rnd('close * exp(predicted / close - 1)', 4)} AS price FROM predictions")
def _f4(t):
    return t.predictions.select("model_key", "date", rnd(scalars.price_from_return(
        F.col("close"), F.col("predicted") / F.col("close") - 1), 4).alias("price"))


@query("f5_confidence", f"SELECT model_key, {sql_rnd('1 / (1 + mape)')} AS confidence FROM registry")
def _f5(t):
    return t.registry.select("model_key", rnd(scalars.confidence(F.col("mape"))).alias("confidence"))


@query("f6_model_key", """
SELECT model_key, concat_ws('_', 'SARIMAX', symbol, feature_set, tuning, CAST(lookback AS VARCHAR), CAST(horizon AS VARCHAR), CAST(input_date AS VARCHAR)) AS long_key FROM registry""")
def _f6(t):
    return t.registry.select("model_key", scalars.model_key(
        F.lit("SARIMAX"), F.col("symbol"), F.col("feature_set"), F.col("tuning"), F.col("lookback"), F.col("horizon"),
        F.col("input_date")).alias("long_key"))


@query("f7_strings", """
SELECT p_partkey, contains(p_name, 're') AS has_re, ends_with(p_name, 'ring') AS is_ring, upper(trim(p_name)) AS up,
  replace(p_brand, 'Brand#', 'B') AS short, string_split(p_name, ' ')[1] AS first_word FROM part""")
def _f7(t):
    p = t.table("part")
    return p.select("p_partkey", F.contains("p_name", F.lit("re")).alias("has_re"), F.endswith("p_name", F.lit("ring")).alias("is_ring"),
                    F.upper(F.trim("p_name")).alias("up"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("short"),
                    F.split("p_name", " ")[0].alias("first_word"))


_LINES = """
SELECT model_key, unnest(string_split(explanation, chr(10))) AS line, generate_subscripts(string_split(explanation, chr(10)), 1) AS i FROM explanation_text"""
CTES["exp_lines"] = _LINES
CTES["exp_marked"] = """
SELECT model_key, i, trim(line) AS line, last_value(head IGNORE NULLS) OVER (PARTITION BY model_key ORDER BY i) AS section, head FROM (
  SELECT *, CASE WHEN line LIKE '**Conclusion:**%' THEN 'conclusion' WHEN line LIKE '**Performance Metrics:**%' THEN 'performance_metrics'
    WHEN line LIKE '**Key Influencing Features:**%' THEN 'key_features' WHEN line LIKE '**Model Parameters:**%' THEN 'model_params'
    WHEN line LIKE '**Additional Notes:**%' THEN 'additional_notes' END AS head FROM exp_lines)"""


@query("f8_feature_pairs", r"""
SELECT model_key, name, value, CAST(value AS DOUBLE) AS numeric_value FROM (
  SELECT model_key, unnest(regexp_extract_all(explanation, '''([^'']+)''\s*\([\d.]+\)', 1)) AS name,
         unnest(regexp_extract_all(explanation, '''[^'']+''\s*\(([\d.]+)\)', 1)) AS value FROM explanation_text)""")
def _f8(t):
    return text.feature_pairs(t.explanation_text, "explanation").drop("explanation")


@query("f9_bullets", r"""
WITH b AS (SELECT model_key, replace(regexp_replace(line, '^[- ]+', ''), '**', '') AS x FROM exp_marked
           WHERE section = 'performance_metrics' AND head IS NULL AND line LIKE '-%'),
     c AS (SELECT *, instr(x, ':') AS p, CASE WHEN instr(x, ':') > 0 THEN substr(x, instr(x, ':') + 1) ELSE '' END AS rest FROM b),
     d AS (SELECT *, instr(rest, '-') AS q FROM c)
SELECT model_key, CASE WHEN p > 0 THEN trim(substr(x, 1, p - 1)) ELSE '' END AS name,
  trim(CASE WHEN q > 0 THEN substr(rest, 1, q - 1) ELSE rest END) AS value,
  try_cast(regexp_extract(trim(CASE WHEN q > 0 THEN substr(rest, 1, q - 1) ELSE rest END), '[\d.]+') AS DOUBLE) AS numeric_value,
  CASE WHEN p > 0 THEN CASE WHEN q > 0 THEN trim(substr(rest, q + 1)) ELSE '' END ELSE trim(x) END AS description FROM d""")
def _f9(t):
    s = text.explanation_sections(text.explanation_lines(t.explanation_text))
    return text.bullets(s.select("model_key", "performance_metrics"), "performance_metrics")


@query("f10_sections", r"""
WITH m AS (SELECT * FROM exp_marked WHERE head IS NULL AND line <> '')
SELECT model_key, string_agg(line, ' ' ORDER BY i) FILTER (section = 'conclusion') AS conclusion,
  string_agg(line, ' ' ORDER BY i) FILTER (section = 'additional_notes' OR (section = 'key_features' AND line NOT LIKE '%''%')) AS additional_notes,
  count(*) FILTER (section = 'performance_metrics') AS metrics, count(*) FILTER (section = 'model_params') AS params,
  count(*) FILTER (section = 'key_features' AND line LIKE '%''%') AS features FROM m GROUP BY model_key""")
def _f10(t):
    s = text.explanation_sections(text.explanation_lines(t.explanation_text))
    return s.select("model_key", "conclusion", "additional_notes", F.size("performance_metrics").alias("metrics"),
                    F.size("model_params").alias("params"), F.size("key_features").alias("features"))


CTES["clean_responses"] = r"""
SELECT model_key, symbol, input_date, prediction_date, k, CASE WHEN json_valid(c) THEN c END AS c FROM (
  SELECT *, regexp_replace(trim(text), '^```json\s*|\s*```$', '', 'g') AS c FROM responses)"""


@query("f11_clean_responses", """
SELECT model_key, c IS NOT NULL AS parsed, json_extract_string(c, '$.predicted_amount') AS predictedamount,
  json_extract_string(c, '$."up_or_down!"') AS upordown FROM clean_responses""")
def _f11(t):
    r = text.clean_responses(t.responses, out="m")
    return r.select("model_key", F.col("m").isNotNull().alias("parsed"), F.try_element_at("m", F.lit("predictedamount")).alias("predictedamount"),
                    F.try_element_at("m", F.lit("upordown")).alias("upordown"))


@query("f12_json_fields", """
SELECT model_key, json_extract_string(model_parameters, '$.feature_set') AS feature_set, CAST(json_extract_string(model_parameters, '$.prediction_horizon') AS INT) AS horizon,
  k % 7 AS tn, k % 3 AS fp, 'f' || (k + 9) % 20 AS fourth FROM params_json""")
def _f12(t):
    cell = F.from_json(F.format_string("[[%d,%d],[1,2]]", F.col("k") % 7, F.col("k") % 3), "array<array<int>>")
    p = t.params_json.select("model_key", F.get_json_object("model_parameters", "$.feature_set").alias("feature_set"),
                             F.get_json_object("model_parameters", "$.prediction_horizon").cast("int").alias("horizon"),
                             cell[0][0].alias("tn"), cell[0][1].alias("fp"))
    i = t.importance_json.select("model_key", F.from_json("feature_importance", "feature map<string,string>")["feature"]["3"].alias("fourth"))
    return p.join(i, "model_key")


@query("f13_predictions_json", """
SELECT model_key, '{' || string_agg('"' || date || '":{"close":' || close || ',"pred_label":' || pred_label || '}', ',' ORDER BY date) || '}' AS predictions_json
FROM predictions GROUP BY model_key""")
def _f13(t):
    return text.predictions_json(t.predictions, ["model_key"], "date", ["close", "pred_label"])


@query("f14_importance_round_trip", """
SELECT model_key, feature_importance LIKE '{"feature":{"0":"f%' AS same, 8 AS n FROM importance_json""")
def _f14(t):
    rows = text.importance_rows(t.importance_json)
    back = text.importance_json(rows, ["model_key"])
    again = text.importance_rows(back).groupBy("model_key").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("i", "feature", "importance"))).alias("a"))
    first = rows.groupBy("model_key").agg(F.sort_array(F.collect_list(F.struct("i", "feature", "importance"))).alias("b"))
    return again.join(first, "model_key").select("model_key", (F.col("a") == F.col("b")).alias("same"), "n")


@query("f15_fallback", """
SELECT model_key, date, CASE WHEN date <= DATE '2000-01-01' THEN coalesce(actual, last_known_price) END AS actual_price FROM merged_predictions""")
def _f15(t):
    return reports.chart_series(reports.merged_predictions(t.predictions, t.pred_log), F.lit("2000-01-01").cast("date")).drop("predicted_price")


@query("f16_percent_text", "SELECT model_key, printf('%.2f%%', f1 * 100) AS f1_text, strftime(input_date, '%b %d, %Y') AS day_text FROM registry")
def _f16(t):
    return t.registry.select("model_key", text.percent_text(F.col("f1")).alias("f1_text"), F.date_format("input_date", "MMM dd, yyyy").alias("day_text"))


@query("f17_narrative", """
SELECT model_key, concat_ws(chr(10) || chr(10),
  '**Conclusion:**' || chr(10) || CASE WHEN k % 3 = 1 THEN 'Expected price of ' || symbol || ' on ' || prediction_date || ': $' || printf('%.1f', start_price)
       ELSE 'Expected direction of ' || symbol || ' on ' || prediction_date || ': *' || movement || '*' END,
  '**Performance Metrics:**' || chr(10) || CASE WHEN k % 3 = 0 THEN '- **F1 Score:** ' || printf('%.3f', f1) ELSE '- **MAPE:** ' || CAST(floor(mape) AS BIGINT) || '%' END,
  '**Prediction Details:**' || chr(10) || CASE WHEN k % 3 = 1 THEN '- **Predicted Amount:** ' || printf('%.1f', start_price) || chr(10) ELSE '' END
     || '- **Last Known Price:** ' || printf('%.1f', start_price),
  CASE WHEN k % 3 = 0 THEN '**Confusion Matrix:**' || chr(10) || '- **True Positives:** ' || k % 7 || chr(10) || '- **True Negatives:** ' || k % 11 END,
  '**Model Parameters:**' || chr(10) || '- ' || model_parameters) AS narrative FROM params_json""")
def _f17(t):
    kind = F.element_at(F.array(F.lit("classification"), F.lit("regression"), F.lit("general")), (F.col("k") % 3 + 1).cast("int"))
    price = F.format_string("%.1f", "start_price")
    return t.params_json.select("model_key", text.narrative(kind, {
        "symbol": F.col("symbol"), "movement": F.col("movement"), "prediction_date": F.col("prediction_date").cast("string"),
        "amount": price, "last_known_price": price, "f1": F.format_string("%.3f", "f1"), "parameters": F.col("model_parameters"),
        "mape": F.concat(F.floor("mape").cast("string"), F.lit("%")), "tp": (F.col("k") % 7).cast("string"), "tn": (F.col("k") % 11).cast("string"),
    }).alias("narrative"))


# -- registry and reports --------------------------------------------------------------------------

CTES["retrained"] = "SELECT * REPLACE ('m' || (k * 2) AS model_key, f1 + 1 AS f1) FROM registry"


@query("r1_model_upsert", _UPSERT.format(cols="model_key, symbol, input_date, f1, mape", target="registry", batch="retrained", keys="model_key", order="input_date"))
def _r1(t):
    cols = ["model_key", "symbol", "input_date", "f1", "mape"]
    again = t.registry.withColumn("model_key", F.concat(F.lit("m"), (F.col("k") * 2).cast("string"))).withColumn("f1", F.col("f1") + 1)
    return tables.upsert(t.registry.select(*cols), again.select(*cols), ["model_key"], ["input_date"])


CTES["rescored"] = "SELECT model_key, symbol, date + 30 AS date, predicted + 1 AS predicted, proba FROM predictions"


@query("r2_log_upsert", _UPSERT.format(cols="model_key, symbol, date, predicted, proba", target="predictions", batch="rescored", keys="model_key, symbol, date", order="proba"))
def _r2(t):
    cols = ["model_key", "symbol", "date", "predicted", "proba"]
    batch = t.predictions.select("model_key", "symbol", F.date_add("date", 30).alias("date"), (F.col("predicted") + 1).alias("predicted"), "proba")
    return tables.upsert(t.predictions.select(*cols), batch, ["model_key", "symbol", "date"])


@query("r3_chart_series", f"""
SELECT model_key, date, {sql_rnd('predicted')} AS predicted_price, CASE WHEN date <= DATE '2000-06-30' THEN coalesce(actual, last_known_price) END AS actual_price
FROM merged_predictions""")
def _r3(t):
    c = reports.chart_series(reports.merged_predictions(t.predictions, t.pred_log), F.lit("2000-06-30").cast("date"))
    return c.select("model_key", "date", rnd("predicted_price").alias("predicted_price"), "actual_price")


@query("r3_chart_series_class", """
SELECT model_key, date, CASE WHEN date <= DATE '2000-06-30' THEN actual END AS actual_price,
  CAST(proba > 0.5 AS INT) AS predicted_movement, CAST(actual > lag(actual) OVER (PARTITION BY model_key ORDER BY date) AS INT) AS actual_movement
FROM predictions""")
def _r3c(t):
    before = F.lag("actual").over(Window.partitionBy("model_key").orderBy("date"))
    rows = t.predictions.select("model_key", "date", F.when(F.col("date") <= F.lit("2000-06-30").cast("date"), F.col("actual")).alias("actual_price"),
                                (F.col("proba") > 0.5).cast("int").cast("string").alias("predicted_movement"),
                                (F.col("actual") > before).cast("int").cast("string").alias("actual_movement"))
    return reports.chart_movements(rows)


@query("r4_model_card", """
SELECT p.model_key, p.symbol, p.f1, json_extract_string(p.model_parameters, '$.hyperparameter_tuning') AS tuning,
  json_extract_string(i.feature_importance, '$.feature."0"') AS first_feature, e.explanation
FROM params_json p JOIN importance_json i USING (model_key) LEFT JOIN explanation_text e USING (model_key)""")
def _r4(t):
    return reports.model_cards(t.params_json, t.importance_json, t.explanation_text)


@query("r5_freshness", """
SELECT s.symbol, max(b.date) AS last_date, coalesce(max(b.date) < DATE '2001-10-30', true) AS stale
FROM (SELECT DISTINCT symbol FROM bars UNION SELECT DISTINCT event_type FROM events) s LEFT JOIN bars b USING (symbol) GROUP BY s.symbol""")
def _r5(t):
    expected = t.bars.select("symbol").union(t.news.select("symbol")).distinct()
    return reports.missing_symbols(expected, t.bars, F.lit("2001-10-30").cast("date"))


@query("r6_external_calls", """
SELECT symbol, input_date AS date, prediction_date, CAST(json_extract_string(c, '$.predicted_amount') AS DOUBLE) AS predicted_amount,
  json_extract_string(c, '$."up_or_down!"') AS up_or_down
FROM clean_responses WHERE json_extract_string(c, '$.predicted_amount') IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol, input_date ORDER BY k DESC) = 1""")
def _r6(t):
    good, _ = reports.external_calls(t.responses)
    return latest_per_key(good, ["symbol", "date"], ["k"]).select("symbol", "date", "prediction_date", "predicted_amount", "up_or_down")


@query("r7_explanation_upsert", """
WITH made AS (SELECT model_key, 'about ' || symbol AS explanation, date_created AS created_date FROM registry WHERE k % 3 <> 0 AND k % 5 <> 0)
SELECT model_key, explanation, NULL AS error FROM made
UNION ALL SELECT model_key, explanation, NULL FROM explanation_text ANTI JOIN made USING (model_key)
UNION ALL SELECT model_key, NULL, 'missing: symbol' FROM registry WHERE k % 3 <> 0 AND k % 5 = 0""")
def _r7u(t):
    batch = t.registry.where("k % 3 <> 0").select("model_key", F.when(F.col("k") % 5 != 0, F.col("symbol")).alias("symbol"), "prediction_date",
                                                  F.col("movement").alias("prediction_explanation"), "date_created")
    table, failed = reports.explained(t.explanation_text.withColumn("created_date", F.lit(None).cast("date")), batch, F.concat(F.lit("about "), F.col("symbol")))
    return table.select("model_key", "explanation", F.lit(None).cast("string").alias("error")).unionByName(
        failed.select("model_key", F.lit(None).cast("string").alias("explanation"), "error"))


@query("r7_rejected_calls", """
SELECT model_key, CASE WHEN c IS NULL THEN 'no JSON object' ELSE 'no amount' END AS error, r.text AS input
FROM clean_responses JOIN responses r USING (model_key) WHERE json_extract_string(c, '$.predicted_amount') IS NULL""")
def _r7(t):
    _, bad = reports.external_calls(t.responses)
    return bad.select("model_key", "error", "input")
