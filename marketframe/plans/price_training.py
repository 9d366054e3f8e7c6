"""Price models as one flow: an order per symbol, the fit, forecasts of the held-out rows, metrics, next price and registry rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions import scalars, text
from marketframe.operators import arma, linear, series
from marketframe.operators.evaluate import regression_metrics
from marketframe.operators.landing import land

KEYS = ["symbol"]
TARGET = "log_return_future"


class Trained(NamedTuple):
    models: DataFrame
    forecasts: DataFrame
    figures: DataFrame
    registry: DataFrame


def same_order(rows: DataFrame, p: int, d: int, q: int, season: int) -> DataFrame:
    """One order for every symbol."""
    return rows.select(*KEYS).distinct().select(*KEYS, *[F.lit(v).alias(c) for c, v in zip(arma.ORDER, (p, d, q, season))])


def chosen_orders(train: DataFrame, features: list[str], horizon: int, tuning: str) -> DataFrame:
    """The best order of the search per symbol; a symbol too short for any has none."""
    return linear.order_search(train, features, TARGET, horizon, tuning).filter("best").select(*KEYS, *arma.ORDER)


def price_training(rows: DataFrame, orders: DataFrame, features: list[str], horizon: int, tuning: str,
                   feature_set: str = "basic", ridge: float = arma.RIDGE) -> Trained:
    """``rows`` have symbol, date, price, the features, the target and ``is_train``.

    The next price is the first step after the training rows with the features of a symbol's last row, as in the
    reference flow.  Symbols without a fit have no registry row; ``models`` says why."""
    models = land(arma.order_fit(rows.filter("is_train"), orders, features, TARGET, KEYS, ridge=ridge))
    test = rows.filter(~F.col("is_train"))
    made = arma.order_forecasts(test.select(*KEYS, "date", "price", TARGET, *features), models, features, KEYS)
    forecasts = land(made.withColumns({"predicted_price": scalars.price_from_return(F.col("price"), F.col("pred")),
                                       "actual_price": scalars.price_from_return(F.col("price"), F.col(TARGET))}))
    figures = regression_metrics(forecasts, KEYS, TARGET, "pred")
    # landed, since the planner is slow with filters on many fields of one aggregate
    last = land(rows.groupBy(*KEYS).agg(F.max_by(F.struct("date", "price", *features), "date").alias("_r")).select(*KEYS, "_r.*"))
    ahead = arma.order_forecasts(last, models, features, KEYS).select(
        *KEYS, F.date_add("date", horizon).alias("prediction_date"), F.col("price").alias("last_known_price"),
        scalars.price_from_return(F.col("price"), F.col("pred")).alias("predicted_amount"))
    points = forecasts.select(*KEYS, "date", "actual_price", "predicted_price").unionByName(
        ahead.select(*KEYS, F.col("prediction_date").alias("date"), F.lit(None).cast("double").alias("actual_price"),
                     F.col("predicted_amount").alias("predicted_price")))
    told = F.to_json(F.struct(F.array("p", "d", "q").alias("order"), F.array("p", "d", "q", "season").alias("seasonal_order"),
                              F.lit(tuning).alias("hyperparameter_tuning"), F.lit(feature_set).alias("feature_set"),
                              F.lit(horizon).alias("prediction_horizon")))
    weights = F.map_from_arrays(F.array(*map(F.lit, features)).cast("array<string>"), "coef")
    known = models.filter("reason IS NULL").select(*KEYS, told.alias("model_parameters"), F.to_json(weights).alias("coefficients"))
    rows_of = figures
    for part in (ahead, known, text.predictions_json(points, KEYS, "date", ["actual_price", "predicted_price"])):
        rows_of = series._with_groups(rows_of, part, KEYS)
    key = scalars.model_key(F.lit("ARX"), F.col("symbol"), F.lit(feature_set), F.lit(tuning), F.lit(horizon))
    registry = rows_of.select(key.alias("model_key"), *KEYS, "prediction_date", F.col("rmse").alias("prediction_rmse"), F.col("mae").alias("prediction_mae"),
                              F.col("mape").alias("prediction_mape"), scalars.confidence(F.col("rmse")).alias("prediction_confidence_score"),
                              "last_known_price", "predicted_amount", "model_parameters", "coefficients", "predictions_json")
    return Trained(models, forecasts, figures, registry)
