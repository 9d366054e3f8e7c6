"""One classifier per symbol as registered queries: the first split of a stump has a closed answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.operators import boosted, select
from marketframe.operators.evaluate import classification_metrics
from marketframe.operators.landing import land
from marketframe.operators.linear import future_class, score_classes
from marketframe.plans.catalog import query, rnd, sql_rnd
from marketframe.plans.inputs import CTES, HORIZON
from marketframe.plans.model_queries import FEATURES, _rows, _scaled_split, _with_price

_PAIR = ["momentum_30", "rsi"]
_CUTS = [[-0.4, -0.2, -0.1, 0.0, 0.1, 0.2, 0.4], [30.0, 40.0, 50.0, 60.0, 70.0]]
_RATE = 0.1
DEPTH, ROUNDS = 3, 5

CTES["stump_cuts"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({f}, {b}, CAST({cut} AS DOUBLE))" for f, cuts in enumerate(_CUTS) for b, cut in enumerate(cuts)) + ") AS c(f, b, cut)"
CTES["stump_rows"] = "SELECT symbol, f, v, 0.5 - CAST(log_return_future > 0 AS INT) AS g FROM pair_rows, LATERAL (VALUES " + ", ".join(
    f"({f}, {name})" for f, name in enumerate(_PAIR)) + ") AS x(f, v) WHERE is_train"
CTES["stump_best"] = f"""
WITH s AS (SELECT symbol, f, b, cut, sum(CASE WHEN v <= cut THEN g ELSE 0 END) AS gl, 0.25 * count(*) FILTER (v <= cut) AS hl, sum(g) AS gs, 0.25 * count(*) AS hs
  FROM stump_rows JOIN stump_cuts USING (f) GROUP BY symbol, f, b, cut),
 k AS (SELECT *, round(gl * gl / (hl + {boosted.L2}) + (gs - gl) * (gs - gl) / (hs - hl + {boosted.L2}) - gs * gs / (hs + {boosted.L2}), 9) AS gain
  FROM s WHERE hl >= {boosted.LEAST_HESSIAN} AND hs - hl >= {boosted.LEAST_HESSIAN})
SELECT * FROM k WHERE gain > {boosted.LEAST_GAIN} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY gain DESC, f, b) = 1"""


def _stumps(t):
    rows = land(select.chronological_split(_rows(t)))
    cuts = boosted.fixed_cuts(rows, _CUTS, ["symbol"])
    return rows, cuts, boosted.train(rows.filter("is_train"), cuts, _PAIR, ["symbol"], 1, 1, _RATE, balanced=False)


@query("m10_symbol_stumps", f"""
SELECT symbol, CASE f WHEN 0 THEN '{_PAIR[0]}' ELSE '{_PAIR[1]}' END AS feature, cut, {sql_rnd('gain')} AS gain,
  {sql_rnd(f'-{_RATE} * gl / (hl + {boosted.L2})')} AS low_value, {sql_rnd(f'-{_RATE} * (gs - gl) / (hs - hl + {boosted.L2})')} AS high_value FROM stump_best""")
def _m10s(t):
    _, cuts, models = _stumps(t)
    first = models.select("symbol", F.col("trees")[0].alias("t")).where(F.size("t.splits") > 0).join(cuts, "symbol")
    split, leaf = F.col("t.splits")[0]["value"], F.map_from_entries("t.leaves")
    return first.select("symbol", F.element_at(F.array(*map(F.lit, _PAIR)), split["feature"] + 1).alias("feature"),
                        F.col("cuts")[split["feature"]][split["bin"]].alias("cut"), rnd(F.col("t.gains")[0]["value"]).alias("gain"),
                        rnd(F.element_at(leaf, 2)).alias("low_value"), rnd(F.element_at(leaf, 3)).alias("high_value"))


@query("m10_symbol_stump_scores", f"""
WITH v AS (SELECT r.symbol, r.date, CASE f WHEN 0 THEN {_PAIR[0]} ELSE {_PAIR[1]} END AS v, b.* EXCLUDE (symbol)
  FROM pair_rows r JOIN stump_best b USING (symbol) WHERE NOT is_train),
 p AS (SELECT symbol, date, 1 / (1 + exp(-CASE WHEN v <= cut THEN -{_RATE} * gl / (hl + {boosted.L2}) ELSE -{_RATE} * (gs - gl) / (hs - hl + {boosted.L2}) END)) AS proba FROM v)
SELECT symbol, date, {sql_rnd('proba')} AS proba, CAST(proba > 0.5 AS INT) AS pred_label FROM p""")
def _m10c(t):
    rows, cuts, models = _stumps(t)
    split = models.where(F.size(F.col("trees")[0]["splits"]) > 0)
    scored = boosted.score(split, cuts, rows.filter(~F.col("is_train")), _PAIR, ["symbol"], 1)
    return scored.select("symbol", "date", rnd("proba").alias("proba"), "pred_label")


CTES["stump_rated"] = f"""
WITH v AS (SELECT r.symbol, r.date, CASE f WHEN 0 THEN {_PAIR[0]} ELSE {_PAIR[1]} END AS v, b.* EXCLUDE (symbol) FROM pair_rows r JOIN stump_best b USING (symbol)),
 p AS (SELECT symbol, date, 1 / (1 + exp(-CASE WHEN v <= cut THEN -{_RATE} * gl / (hl + {boosted.L2}) ELSE -{_RATE} * (gs - gl) / (hs - hl + {boosted.L2}) END)) AS proba FROM v)
SELECT symbol, date, lag(proba, {HORIZON}) OVER (PARTITION BY symbol ORDER BY date) AS usable FROM p"""


@query("m14_class_scoring", f"""
WITH d AS (SELECT symbol, max(date) - 30 AS input_date FROM bars GROUP BY symbol),
 days AS (SELECT symbol, input_date, CAST(unnest(generate_series(CAST(input_date - 60 AS TIMESTAMP), CAST(input_date + {HORIZON} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
 work AS (SELECT * FROM days WHERE isodow(date) < 6),
 probes AS (SELECT symbol, input_date, date FROM work WHERE date > input_date
   UNION SELECT symbol, input_date, date FROM work WHERE date <= input_date QUALIFY row_number() OVER (PARTITION BY symbol, input_date ORDER BY date DESC) <= {HORIZON}
   UNION SELECT symbol, input_date, date FROM work WHERE date = input_date),
 told AS (SELECT p.*, u.usable FROM probes p ASOF LEFT JOIN stump_rated u ON p.symbol = u.symbol AND p.date - {HORIZON} >= u.date),
 came AS (SELECT b.symbol, b.date, b.close, f.close AS later FROM bars b ASOF LEFT JOIN bars f ON b.symbol = f.symbol AND b.date + {HORIZON} <= f.date)
SELECT t.symbol, t.input_date, t.date, CAST(usable > 0.5 AS INT) AS predicted_movement, {sql_rnd('usable')} AS prediction_probability,
  c.close AS actual_price, CAST(c.later > c.close AS INT) AS actual_movement FROM told t LEFT JOIN came c ON t.symbol = c.symbol AND t.date = c.date""")
def _m14c(t):
    rows, cuts, models = _stumps(t)
    split = models.where(F.size(F.col("trees")[0]["splits"]) > 0)
    scored = boosted.score(split, cuts, rows, _PAIR, ["symbol"], 1)
    requests = t.bars.groupBy("symbol").agg(F.date_sub(F.max("date"), 30).alias("input_date"))
    out = score_classes(scored, t.bars, requests, HORIZON)
    return out.select("symbol", "input_date", "date", "predicted_movement", rnd("prediction_probability").alias("prediction_probability"), "actual_price", "actual_movement")


def _symbol_models(t):
    rows = _scaled_split(_rows(t))
    train = rows.filter("is_train")
    cuts = land(boosted.quantile_cuts(train, FEATURES, ["symbol"]))
    return rows, cuts, boosted.train(train, cuts, FEATURES, ["symbol"], DEPTH, ROUNDS, _RATE)


@query("m10_symbol_classifiers")
def _m10m(t):
    """A model per symbol on all features: its metrics on the held-out rows and its next direction."""
    rows, cuts, models = _symbol_models(t)
    scored = land(_with_price(boosted.score(models, cuts, rows, FEATURES, ["symbol"], DEPTH)))
    figures = classification_metrics(scored.filter(~F.col("is_train")), ["symbol"], "target", "pred_label")
    return figures.join(future_class(scored, HORIZON, F.col("proba")), "symbol")


@query("m9_symbol_importance")
def _m9s(t):
    return boosted.importances(_symbol_models(t)[2], FEATURES, ["symbol"])
