"""Model quality: regression and classification metrics, ROC AUC, confusion cells, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators import series
from marketframe.operators.landing import land

INFINITE_MAPE = 9999.0


def regression_metrics(rows: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE and MAPE per model.  An error on an actual of 0 makes MAPE infinite: 9999."""
    y, p = F.col(actual), F.col(predicted)
    err = y - p
    infinite = F.coalesce(F.max((y == 0) & (p != 0)), F.lit(False))
    return rows.filter(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        F.when(infinite, F.lit(INFINITE_MAPE)).otherwise(F.avg(F.abs(F.try_divide(err, y))) * 100).alias("mape"))


def confusion_counts(label: str, pred: str) -> dict[str, Column]:
    y, p = F.col(label), F.col(pred)
    return {"tp": F.count_if((y == 1) & (p == 1)), "fp": F.count_if((y == 0) & (p == 1)),
            "fn": F.count_if((y == 1) & (p == 0)), "tn": F.count_if((y == 0) & (p == 0))}


def classification_metrics(rows: DataFrame, keys: list[str], label: str, pred: str) -> DataFrame:
    """Accuracy, precision, recall and F1 per model; 0 where the denominator is 0."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(*keys).agg(
        *[c.alias(n) for n, c in confusion_counts(label, pred).items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.select(*keys, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                         ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                         ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_cells(rows: DataFrame, keys: list[str], label: str, pred: str) -> DataFrame:
    """One row per model and cell: count, share of the model's total in percent, correct or not."""
    cells = rows.filter(F.col(label).isNotNull()).groupBy(
        *keys, F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return cells.withColumn("share", F.col("n") * 100.0 / total).withColumn("correct", F.col("actual") == F.col("predicted"))


def roc_auc(rows: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve per model: for each positive the share of negatives scored below it,
    ties counted half.

    Rows are reduced to counts per score first.  The running count of negatives goes over
    score ranges, so that a model with very many scores is not one task.  Scores lie in 0..1.
    """
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    by_score = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(
        pos.alias("_pos"), neg.alias("_neg"))
    by_score = by_score.withColumns({"_b1": F.floor(F.col("_s") * 256), "_b2": F.floor(F.col("_s") * 65536)})
    # a count per score is small next to the rows and is read several times
    run = series.running(land(by_score), keys, ["_b1", "_b2"], ["_s"], {"_to": F.col("_neg")})
    wins = F.col("_pos") * (F.col("_to") - F.col("_neg") / 2.0)
    return run.groupBy(*keys).agg(F.try_divide(F.sum(wins), F.sum("_pos") * F.sum("_neg")).alias("roc_auc"))


def class_ratio(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Negatives per positive; 1 without positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.groupBy(*keys).agg(F.coalesce(F.try_divide(neg, pos), F.lit(1.0)).alias("ratio"))


def prediction_status(actual: Column, predicted: Column) -> Column:
    return F.when(actual.isNull(), "No Data").when(actual == predicted, "Correct").otherwise("Incorrect")


def accuracy(rows: DataFrame, correct: str) -> DataFrame:
    total, right = F.count(F.lit(1)), F.coalesce(F.sum(correct), F.lit(0))
    return rows.agg(total.alias("total"), right.alias("correct"),
                    F.coalesce(F.try_divide(right, total) * 100, F.lit(0.0)).alias("accuracy"))


def value_counts(rows: DataFrame, column: str, n: int | None = None) -> DataFrame:
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), column).limit(n) if n else counts


def histogram(rows: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins between the least and the greatest value."""
    known = land(rows.filter(F.col(column).isNotNull()).select(column))
    ends = known.agg(F.min(column), F.max(column)).first()
    lo, hi = (F.lit(v).cast(known.schema[column].dataType) for v in ends)
    bin_no = F.least(F.lit(bins), F.coalesce(F.floor(F.try_divide(F.col(column) - lo, (hi - lo) / bins)), F.lit(0)) + 1)
    return known.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def usage_rates(models: DataFrame, is_top: Column) -> DataFrame:
    """Share of top models per horizon bin, lookback bin, feature set and tuning, in one pass."""
    binned = models.select(
        (F.floor(F.col("horizon") / 5) * 5).alias("horizon"), (F.floor(F.col("lookback") / 100) * 100).alias("lookback"),
        "feature_set", "tuning", is_top.cast("int").alias("_top"))
    names = ["horizon", "lookback", "feature_set", "tuning"]
    sets = binned.groupingSets([[n] for n in names], *names).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("_top") * 100).alias("rate"),
        *[F.grouping(n).alias(f"_g_{n}") for n in names])
    which = F.coalesce(*[F.when(F.col(f"_g_{n}") == 0, F.lit(n)) for n in names])
    return sets.select(which.alias("parameter"), F.coalesce(*[
        F.when(F.col(f"_g_{n}") == 0, F.col(n).cast("string")) for n in names]).alias("value"), "n", "rate")


def with_future_rows(history: DataFrame, horizon_days: int) -> DataFrame:
    """History of each model plus its next point: the last forecast, dated ``horizon_days`` after the last row."""
    last = history.groupBy("model_key").agg(F.max("date").alias("_d"), F.max_by("predicted", "date").alias("predicted"))
    nxt = last.select("model_key", F.date_add("_d", horizon_days).alias("date"),
                      F.lit(None).cast("double").alias("actual"), "predicted")
    return history.select("model_key", "date", "actual", "predicted").unionByName(nxt)
