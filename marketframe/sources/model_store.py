"""Fitted models on shared storage, by model key."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.sources.tables import upsert_table

BUCKETS = 64


def _bucket(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def save_linear(models: DataFrame, path: str) -> None:
    """Coefficient rows of many models (``model_key`` and the fit's columns); the rows of a key are replaced together.
    A fixed number of folders by a hash of the key holds any number of models, sorted by key."""
    upsert_table(models.sparkSession, path, models.withColumn("bucket", _bucket("model_key")), ["model_key"], "bucket", one_row=False)


def load_linear(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Read some models, or all; only their buckets are opened, and in them the row groups of the keys."""
    models = spark.read.parquet(path)
    if keys:
        buckets = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(_bucket("k")).distinct().collect()]
        models = models.filter(F.col("bucket").isin(buckets) & F.col("model_key").isin(keys))
    return models.drop("bucket")


def save_classifier(model: GBTClassificationModel, path: str, model_key: str) -> None:
    model.write().overwrite().save(f"{path}/model_key={model_key}")


def load_classifier(path: str, model_key: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(f"{path}/model_key={model_key}")
