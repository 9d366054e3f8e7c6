"""Outcomes of predictions, coverage checks and the report queries of the site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.text import clean_responses
from marketframe.operators.asof import asof_join, require_date
from marketframe.operators.select import latest_per_key, top_per_key
from marketframe.sources.tables import upsert

OUTCOME_TOLERANCE_DAYS = 7


def actual_close(models: DataFrame, bars: DataFrame, as_of: Column, end: str = "end_date") -> DataFrame:
    """Close on the first trading day from ``end`` on, at most a week later; rows without one are left out."""
    due = models.filter(F.col(end) <= as_of)
    close = bars.select("symbol", F.col("date").alias("_bar_date"), F.col("close").alias("actual_price"))
    found = asof_join(due, close, ["symbol"], end, "_bar_date", ["actual_price"], "forward",
                      tolerance_days=OUTCOME_TOLERANCE_DAYS)
    return found.filter(F.col("actual_price").isNotNull())


def actual_movement(bars: DataFrame, horizon_days: int) -> DataFrame:
    """Whether the first close from ``horizon_days`` later on is above today's; NULL while it is open."""
    due = bars.select("symbol", "date", "close", F.date_add("date", horizon_days).alias("_due"))
    close = bars.select("symbol", F.col("date").alias("_bar_date"), F.col("close").alias("_future"))
    out = asof_join(due, close, ["symbol"], "_due", "_bar_date", ["_future"], "forward", matched="future_date")
    return out.withColumn("actual_movement", (F.col("_future") > F.col("close")).cast("int")).drop("_due", "_future")


def window_summary(probes: DataFrame, bars: DataFrame) -> DataFrame:
    """Count, first and last day and mean close of each probe's window.

    Needs no row per (probe, bar): running counts and sums at the window's two ends give the answer.
    """
    require_date(bars, "date")
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most one row per symbol and calendar day
    run = bars.select("symbol", F.col("date").alias("_d"), "date", F.count("close").over(w).alias("_n"),
                      F.sum("close").over(w).alias("_s"), "close")
    ends = run.select("symbol", "_d", F.col("_n").alias("n_end"), F.col("_s").alias("s_end"), F.col("date").alias("last_day"))
    starts = run.select("symbol", "_d", (F.col("_n") - 1).alias("n_start"), (F.col("_s") - F.col("close")).alias("s_start"),
                        F.col("date").alias("first_day"))
    out = asof_join(probes, ends, ["symbol"], "end", "_d", ["n_end", "s_end", "last_day"])
    out = asof_join(out, starts, ["symbol"], "start", "_d", ["n_start", "s_start", "first_day"], "forward")
    n = F.coalesce(F.greatest(F.col("n_end") - F.col("n_start"), F.lit(0)), F.lit(0))
    out = out.withColumn("n", n)
    inside = F.col("n") > 0
    return out.withColumns({
        "first_day": F.when(inside, F.col("first_day")), "last_day": F.when(inside, F.col("last_day")),
        "mean_close": F.when(inside, (F.col("s_end") - F.col("s_start")) / F.col("n")),
    }).drop("n_end", "s_end", "n_start", "s_start")


def prediction_difference(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    close = bars.select("symbol", "date", F.col("close").alias("actual_price"))
    return predictions.join(close, ["symbol", "date"], "left").withColumn(
        "difference", F.col("actual_price") - F.col("predicted_price"))


def latest_log(log: DataFrame) -> DataFrame:
    """The last record of each model and date; it replaces the whole entry."""
    return latest_per_key(log, ["model_key", "date"], ["record"])


def merged_predictions(trained: DataFrame, log: DataFrame) -> DataFrame:
    """Predictions made at training with the log laid over them.

    A field the log entry carries wins even when it is empty: ``has_predicted`` tells.
    """
    entry = latest_log(log).select(
        "model_key", "date", F.col("predicted").alias("_logged"), "has_predicted", "last_known_price")
    base = trained.select("model_key", "date", "actual", "predicted")
    return base.join(entry, ["model_key", "date"], "full").withColumn(
        "predicted", F.when(F.col("has_predicted"), F.col("_logged")).otherwise(F.col("predicted"))
    ).drop("_logged", "has_predicted")


def split_requests(requests: DataFrame, models: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests without a model yet, and those that have one."""
    known = models.select(*keys).distinct()
    return requests.join(known, keys, "left_anti"), requests.join(known, keys, "left_semi")


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"))


def data_status(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """Per symbol: how many requested ranges its bars cover, and whether all are."""
    c = coverage(bars).select("symbol", "first_date", "last_date")
    ok = F.coalesce((F.col("start") >= F.col("first_date")) & (F.col("end") <= F.col("last_date")), F.lit(False))
    # requests are counted per range first, so a symbol with many of them joins a few rows
    ranges = requests.groupBy("symbol", "start", "end").agg(F.count(F.lit(1)).alias("_n"))
    return ranges.join(c, "symbol", "left").groupBy("symbol").agg(
        F.sum("_n").alias("requests"), F.bool_and(ok).alias("complete"),
        F.coalesce(F.sum(F.when(ok, F.col("_n"))), F.lit(0)).alias("covered"))


def with_explanation(models: DataFrame, explanations: DataFrame) -> DataFrame:
    return models.join(explanations, "model_key", "left")


def missing_symbols(expected: DataFrame, bars: DataFrame, since: Column) -> DataFrame:
    """Every expected symbol with its last bar and whether that is older than ``since`` or absent."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    return expected.join(last, "symbol", "left").withColumn(
        "stale", F.coalesce(F.col("last_date") < since, F.lit(True)))


def recent_top_models(models: DataFrame, since: Column, score: str, best: str = "high", n: int = 5) -> DataFrame:
    order = F.col(score).desc() if best == "high" else F.col(score).asc()
    return models.filter(F.col("date_created") >= since).orderBy(order, "model_key").limit(n)


def chart_series(merged: DataFrame, as_of: Column) -> DataFrame:
    """Points of a regression chart: the actual price, else the last known one; none after ``as_of``."""
    known = F.coalesce("actual", "last_known_price")
    return merged.select("model_key", "date", F.col("predicted").alias("predicted_price"),
                         F.when(F.col("date") <= as_of, known).alias("actual_price"))


def chart_movements(rows: DataFrame) -> DataFrame:
    """Points of a classification chart: prices as numbers, movements as 0 or 1, NULL where they are no numbers."""
    return rows.select("model_key", "date", F.col("actual_price").try_cast("double").alias("actual_price"),
                       *[F.col(c).try_cast("int").alias(c) for c in ("predicted_movement", "actual_movement")])


def explained(explanations: DataFrame, models: DataFrame, explanation: Column) -> tuple[DataFrame, DataFrame]:
    """The table of explanations with one for each complete model row put in, by model key, and the rows that lack a
    field, with the names of what is missing and the row itself as JSON."""
    needed = ["model_key", "symbol", "prediction_date", "prediction_explanation", "date_created"]
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]), lambda x: x.isNotNull()), ", ")
    marked = models.withColumn("_missing", missing)
    made = marked.filter("_missing = ''").select("model_key", explanation.alias("explanation"), F.col("date_created").alias("created_date"))
    failed = marked.filter("_missing <> ''").select("model_key", F.concat(F.lit("missing: "), "_missing").alias("error"), F.to_json(F.struct(*models.columns)).alias("input"))
    return upsert(explanations, made, ["model_key"], ["created_date"]), failed


def top_features(importances: DataFrame, n: int = 6) -> DataFrame:
    """The n most important features of each model, also relative to the first."""
    top = top_per_key(importances, ["model_key"], [F.col("importance").desc(), "i"], n)
    best = F.max("importance").over(Window.partitionBy("model_key"))
    return top.withColumn("relative", F.try_divide("importance", best))


def latest_rows_json(rows: DataFrame, keys: list[str], order: str, fields: list[str], n: int) -> DataFrame:
    """The n latest rows of each key as one JSON array, newest first."""
    top = top_per_key(rows, keys, [F.col(order).desc()], n)
    ordered = F.sort_array(F.collect_list(F.struct(order, *fields)), asc=False)
    return top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.to_json(ordered, {"dateFormat": "yyyy-MM-dd"}).alias("rows_json"))


def model_cards(models: DataFrame, importances: DataFrame, explanations: DataFrame) -> DataFrame:
    """What the result page shows of each model: figures, parameters, first feature, explanation."""
    first = importances.select("model_key", F.get_json_object("feature_importance", "$.feature.0").alias("first_feature"))
    cards = models.select("model_key", "symbol", "f1", F.get_json_object(
        "model_parameters", "$.hyperparameter_tuning").alias("tuning")).join(first, "model_key")
    return with_explanation(cards, explanations)


def external_calls(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price calls from answer texts, and the answers that hold none, with the reason."""
    m = clean_responses(responses, out="_m")

    def field(name):
        return F.try_element_at("_m", F.lit(name))
    m = m.withColumn("predicted_amount", field("predictedamount").try_cast("double"))
    ok = F.col("predicted_amount").isNotNull()
    good = m.filter(ok).select("model_key", "symbol", F.col("input_date").alias("date"), "prediction_date", "predicted_amount",
                               field("upordown").alias("up_or_down"), field("predictionexplanation").alias("prediction_explanation"), "k")
    error = F.when(F.col("_m").isNull(), "no JSON object").otherwise("no amount")
    return good, m.filter(~ok).select("model_key", error.alias("error"), F.col("text").alias("input"))


def feature_scores(importances: DataFrame) -> DataFrame:
    """Mean importance of each feature over models."""
    return importances.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("importance").alias("score"))


def winners_and_losers(trades: DataFrame, n: int = 3) -> DataFrame:
    def end(kind, order):
        return trades.orderBy(order, "model_key").limit(n).withColumn("kind", F.lit(kind))
    r = F.col("strategy_return")
    return end("winner", r.desc()).unionByName(end("loser", r.asc()))
