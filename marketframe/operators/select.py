"""Splits, folds, scaling, category codes, stationarity and feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators import series
from marketframe.operators.indicators import KEYS, ORDER
from marketframe.operators.landing import land

# Fixed value: 5 % point of the Dickey-Fuller distribution with a constant, long series.
DICKEY_FULLER_5 = -2.86


def stationarity(rows: DataFrame, column: str = "log_return_1", keys: list[str] = KEYS, order: str = ORDER,
                 chunk_rows: int = series.CHUNK_ROWS, critical: float = DICKEY_FULLER_5) -> DataFrame:
    """Dickey-Fuller test (no lagged differences) of one column per series.

    Regresses the change on the value before; sums only, so each series is a partial aggregate.
    """
    known = rows.filter(F.col(column).isNotNull())
    c = series.chunked(known.select(*keys, order, column), keys, order, 1, 0, chunk_rows)
    pairs = c.withColumn("_before", F.lag(column).over(series.chunk_window(keys)))
    return stationarity_of_pairs(series.own_rows(pairs), column, "_before", keys, critical)


def stationarity_of_pairs(rows: DataFrame, column: str, before: str, keys: list[str] = KEYS,
                          critical: float = DICKEY_FULLER_5) -> DataFrame:
    """The same test where each row already carries the value ``before`` it."""
    x, dy = F.col(before), F.col(column) - F.col(before)
    pairs = rows.select(*keys, x.alias("_x"), dy.alias("_dy")).filter("_x IS NOT NULL AND _dy IS NOT NULL")
    s = pairs.groupBy(*keys).agg(
        F.regr_count("_dy", "_x").alias("n"), F.regr_sxx("_dy", "_x").alias("sxx"),
        F.regr_sxy("_dy", "_x").alias("sxy"), F.regr_syy("_dy", "_x").alias("syy"))
    b = F.try_divide(F.col("sxy"), F.col("sxx"))
    err = F.try_divide(F.try_divide(F.col("syy") - F.col("b") * F.col("sxy"), F.col("n") - 2), F.col("sxx"))
    t = F.try_divide(F.col("b"), F.sqrt(F.when(err > 0, err)))
    return s.withColumn("b", b).withColumn("t_stat", t).select(
        *keys, "n", "t_stat", (F.col("t_stat") < critical).alias("stationary"))


def differenced_unless(stationary: str, column: str, before: str):
    """The column where its series passed the test, else its change; an undefined test is not passed."""
    return F.when(F.coalesce(stationary, F.lit(False)), F.col(column)).otherwise(F.col(column) - F.col(before))


def differenced(rows: DataFrame, column: str = "log_return_1", keys: list[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Replace the column by its row-to-row change in series that fail the test."""
    flags = stationarity(rows, column, keys, order).select(*keys, "stationary")
    c = series.chunked(rows, keys, order, 1)
    out = series.own_rows(c.withColumn("_prev", F.lag(column).over(series.chunk_window(keys))))
    return out.join(flags, keys, "left").withColumn(column, differenced_unless("stationary", column, "_prev")).drop("_prev", "stationary")


def chronological_split(rows: DataFrame, keys: list[str] = KEYS, order: str = ORDER, share: float = 0.8) -> DataFrame:
    """Flag the first ``share`` of each series as training rows."""
    p = series.with_position(rows, keys, order)
    return p.withColumn("is_train", F.col(series.POS) < F.floor(F.col(series.SIZE) * share)).drop(series.POS, series.SIZE)


def expanding_folds(rows: DataFrame, keys: list[str] = KEYS, order: str = ORDER, splits: int = 3) -> DataFrame:
    """Each row once per fold it belongs to: everything before a test block trains for it."""
    p = series.with_position(rows, keys, order)
    size = F.floor(F.col(series.SIZE) / (splits + 1))
    p = p.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, splits + 1)])))
    start = F.col(series.SIZE) - (splits + 1 - F.col("fold")) * size
    role = F.when(F.col(series.POS) < start, "train").when(F.col(series.POS) < start + size, "test")
    return p.withColumn("role", role).filter(F.col("role").isNotNull()).drop(series.POS, series.SIZE)


def fold_block(splits: int = 3):
    """Number of the block a row lies in: block 0 only trains, block i is the test block of fold i."""
    size = F.floor(F.col(series.SIZE) / (splits + 1))
    head = F.col(series.SIZE) - splits * size
    return F.when(F.col(series.POS) < head, F.lit(0)).otherwise(
        1 + F.floor(F.try_divide(F.col(series.POS) - head, size))).cast("int")


def scaler(rows: DataFrame, features: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Mean and population deviation per key; a constant feature gets deviation 1."""
    return rows.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in features],
        *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_std") for c in features])


def scaled(rows: DataFrame, fitted: DataFrame, features: list[str], keys: list[str] = KEYS) -> DataFrame:
    return rows.join(fitted, keys).withColumns(
        {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in features}
    ).drop(*[f"{c}_{s}" for c in features for s in ("mean", "std")])


def correlated_features(rows: DataFrame, features: list[str], keys: list[str] = KEYS, threshold: float = 0.95) -> DataFrame:
    """Per key and feature: whether an earlier feature correlates with it above ``threshold``.

    Features are scaled first, so that the sums of products do not cancel.
    """
    from marketframe.operators.gram import correlations, moments
    complete = rows.select(*keys, *features).na.drop()
    pairs = correlations(moments(scaled(complete, scaler(complete, features, keys), features, keys), features, keys), features, keys)
    return pairs.groupBy(*keys, F.col("later").alias("feature")).agg(
        F.coalesce(F.bool_or(F.abs("corr") > threshold), F.lit(False)).alias("dropped"))


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """Code of each distinct value in sorted order from 0; fit on training rows, join anywhere.

    The distinct values are cut into ranges, numbered inside each range and moved on by the sizes of the ranges
    before, so no task sorts all values, whatever prefixes they share.
    """
    values = rows.filter(F.col(column).isNotNull()).select(column).distinct()
    ranges = land(values.repartitionByRange(F.col(column)).withColumn("_range", F.spark_partition_id()))
    return series.running(ranges, [], ["_range"], [column], {"code": F.lit(1)}).select(column, (F.col("code") - 1).alias("code"))


def with_category_code(rows: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    """Missing and unseen values get -1."""
    return rows.join(codes.withColumnRenamed("code", out), column, "left").withColumn(
        out, F.coalesce(out, F.lit(-1).cast("long")))


def present_columns(rows: DataFrame, wanted: list[str]) -> DataFrame:
    return rows.select(*[c for c in wanted if c in rows.columns])


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key as a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def top_per_key(rows: DataFrame, keys: list[str], order: list, n: int, rank: str = "rn") -> DataFrame:
    """First n rows of each key; Spark cuts each partition to n before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
