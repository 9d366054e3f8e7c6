"""Sums of products of features per group, the base of the linear models and correlations.

The products are formed and added up in the JVM (a degree-2 expansion and the vector
summarizer, partial sums first), so a group of any size arrives as one small row.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Per group: row count ``n`` and ``m``, the mean of every feature and product of two."""
    vec = VectorAssembler(inputCols=features, outputCol="_v").transform(rows.select(*keys, *features).na.drop())
    pairs = PolynomialExpansion(degree=2, inputCol="_v", outputCol="_p").transform(vec)
    agg = [F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_p")).alias("m")]
    out = pairs.groupBy(*keys).agg(*agg) if keys else pairs.agg(*agg)
    return out.withColumn("m", vector_to_array("m"))


def product_index(k: int) -> np.ndarray:
    """Where the expansion puts x_i * x_j: x0, x0x0, x1, x0x1, x1x1, x2, x0x2, ..."""
    where = np.zeros((k, k), dtype=int)
    at = 0
    for j in range(k):
        at += 1
        for i in range(j + 1):
            where[i, j] = where[j, i] = at
            at += 1
    return where


def mean_index(k: int) -> np.ndarray:
    return np.array([j * (j + 1) // 2 + j for j in range(k)], dtype=int)


def gram(n: float, m: np.ndarray, k: int) -> np.ndarray:
    """(k+1) x (k+1) sums of products, the constant first."""
    g = np.empty((k + 1, k + 1))
    g[0, 0] = 1.0
    g[0, 1:] = g[1:, 0] = m[mean_index(k)]
    g[1:, 1:] = m[product_index(k)]
    return g * n


def correlations(fitted: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """One row per group and pair of features (earlier, later) with their correlation."""
    k = len(features)
    means, prods = mean_index(k), product_index(k)
    # where each pair's sums lie in ``m``: a constant table, one row per pair
    places = F.array(*[F.struct(
        F.lit(features[i]).alias("earlier"), F.lit(features[j]).alias("later"), F.lit(int(prods[i, j]) + 1).alias("_xy"),
        F.lit(int(prods[i, i]) + 1).alias("_xx"), F.lit(int(prods[j, j]) + 1).alias("_yy"),
        F.lit(int(means[i]) + 1).alias("_x"), F.lit(int(means[j]) + 1).alias("_y"))
        for j in range(k) for i in range(j)])
    x, y, xx, yy, xy = (F.element_at("m", F.col(c)) for c in ("_x", "_y", "_xx", "_yy", "_xy"))
    return fitted.select(*keys, "m", F.inline(places)).select(
        *keys, "earlier", "later", F.try_divide(xy - x * y, F.sqrt((xx - x * x) * (yy - y * y))).alias("corr"))
