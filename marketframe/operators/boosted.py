"""Boosted classification trees, one model per key, all keys trained at once.

Features are cut into bins per key.  A level of a tree is one job for all keys: gradients and hessians of the logistic loss
are summed per (key, node, feature, bin), partial sums first, and the best split of a node is read from the running sums of
its histogram.  So the number of jobs is rounds x (depth + 2), however many keys there are, and no key's rows meet in one task.
A node that cannot be split stays a leaf; a feature without a value counts as the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators import series
from marketframe.operators.landing import land, release

BINS = 32
L2 = 1.0
LEAST_HESSIAN = 1.0
LEAST_GAIN = 1e-9


def quantile_cuts(rows: DataFrame, features: list[str], keys: list[str], bins: int = BINS) -> DataFrame:
    """(keys, cuts): per feature the distinct approximate quantiles of the key's values, ascending."""
    shares = [i / bins for i in range(1, bins)]
    cut = lambda f: F.coalesce(F.array_sort(F.array_distinct(F.percentile_approx(F.col(f).cast("double"), shares))), F.expr("CAST(array() AS array<double>)"))
    return rows.groupBy(*keys).agg(F.array(*(cut(f) for f in features)).alias("cuts"))


def fixed_cuts(rows: DataFrame, cuts: list[list[float]], keys: list[str]) -> DataFrame:
    """The same cuts for every key."""
    return rows.select(*keys).distinct().withColumn("cuts", F.array(*(F.array(*map(F.lit, c)) for c in cuts)))


def binned(rows: DataFrame, cuts: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Adds ``bins``: per feature the number of cuts below the value, so that bin b holds (cut[b-1], cut[b]]."""
    def number(i: int, f: str) -> Column:
        return F.size(F.filter(F.col("cuts")[i], lambda c: F.col(f) > c))
    return series._with_groups(rows, cuts, keys).withColumn("bins", F.array(*(number(i, f) for i, f in enumerate(features)))).drop("cuts")


def _beside(rows: DataFrame, tree: DataFrame | None, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Rows with their key's columns of ``tree``; NULL where the key has none."""
    if tree is None:
        return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})
    other = tree.select(*[F.col(c).alias(f"_of_{c}") for c in keys], *columns)
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], "left").drop(*[f"_of_{c}" for c in keys])


#: What a key's tree is made of: splits and gains by node.
_TREE = {"splits": "map<int, struct<feature: int, bin: int>>", "gains": "map<int, double>"}


def _node(splits: Column, bins: Column, depth: int) -> Column:
    """Number of the node a row reaches: 1 at the top, 2 n and 2 n + 1 below n."""
    node = F.lit(1)
    if not depth:
        return node

    def below(n: Column, _: Column) -> Column:
        s = F.try_element_at(splits, n)
        return F.when(s.isNull(), n).otherwise(2 * n + (F.get(bins, s["feature"]) > s["bin"]).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), node, below)


def gradients(margin: Column, target: Column, weight: Column) -> tuple[Column, Column]:
    p = 1 / (1 + F.exp(-margin))
    return weight * (p - target), weight * p * (1 - p)


def best_splits(histogram: DataFrame, keys: list[str], l2: float = L2, least_hessian: float = LEAST_HESSIAN) -> DataFrame:
    """(keys, node, feature, bin, gain) for ``histogram`` (keys, node, feature, bin, g, h): rows up to ``bin`` go left.  Of equal
    gains the first feature and bin count."""
    one = Window.partitionBy(*keys, "node", "feature")
    so_far = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = histogram.select(*keys, "node", "feature", "bin", F.sum("g").over(so_far).alias("gl"), F.sum("h").over(so_far).alias("hl"),
                            F.sum("g").over(one).alias("gs"), F.sum("h").over(one).alias("hs"))
    score = lambda g, h: g * g / (h + l2)
    gl, hl, gs, hs = (F.col(c) for c in ("gl", "hl", "gs", "hs"))
    gain = score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)
    found = sums.where((hl >= least_hessian) & (hs - hl >= least_hessian)).withColumn("gain", F.round(gain, 9)).where(F.col("gain") > LEAST_GAIN)
    best = found.groupBy(*keys, "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("s"))
    return best.select(*keys, "node", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.gain")


def train(rows: DataFrame, cuts: DataFrame, features: list[str], keys: list[str], depth: int, rounds: int, rate: float, target: str = "target",
          balanced: bool = True, l2: float = L2, least_hessian: float = LEAST_HESSIAN) -> DataFrame:
    """(keys, trees): per round the splits by node, the leaves' values, and the gains by node.

    ``balanced`` weights the rows with target 1 by the key's ratio of negatives to positives."""
    y = F.col(target).cast("double")
    known = rows.where(F.col(target).isNotNull())
    weight = known.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(1 - y), F.sum(y)), F.lit(1.0)).alias("_ratio"))
    w = F.when(y == 1, F.col("_ratio")).otherwise(1.0) if balanced else F.lit(1.0)
    state = land(series._with_groups(binned(known.select(*keys, *features, target), cuts, features, keys), weight, keys)
                 .select(*keys, "bins", y.alias("y"), w.alias("w"), F.lit(0.0).alias("margin")))
    grown = []
    for turn in range(rounds):
        tree, earlier = None, []
        g, h = gradients(F.col("margin"), F.col("y"), F.col("w"))
        for level in range(depth):
            placed = _beside(state, tree, keys, _TREE).select(
                *keys, _node(F.col("splits"), F.col("bins"), level).alias("node"), g.alias("g"), h.alias("h"), F.posexplode("bins").alias("feature", "bin"))
            histogram = placed.groupBy(*keys, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            entries = lambda c: F.map_from_entries(F.collect_list(F.struct("node", c)))
            found = best_splits(histogram, keys, l2, least_hessian).groupBy(*keys).agg(
                entries(F.struct("feature", "bin")).alias("new_splits"), entries(F.col("gain")).alias("new_gains"))
            if tree is None:
                tree = land(found.select(*keys, F.col("new_splits").alias("splits"), F.col("new_gains").alias("gains")))
                continue
            # a node that stayed a leaf finds no split on a later level either, so no node comes twice
            earlier.append(tree)
            grown_on = _beside(tree, found, keys, {f"new_{c}": kind for c, kind in _TREE.items()})
            tree = land(grown_on.select(*keys, *(F.when(F.col(f"new_{c}").isNull(), F.col(c)).otherwise(F.map_concat(c, f"new_{c}")).alias(c) for c in _TREE)))
        placed = _beside(state, tree, keys, _TREE).withColumn("node", _node(F.col("splits"), F.col("bins"), depth))
        leaves = placed.groupBy(*keys, "node").agg((-rate * F.sum(g) / (F.sum(h) + l2)).alias("value"))
        values = leaves.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("node", "value"))).alias("leaves"))
        grown.append(land(_beside(values, tree, keys, _TREE).withColumn("round", F.lit(turn))))
        if turn + 1 < rounds:
            moved = _beside(placed.drop(*_TREE), grown[-1], keys, {"leaves": "map<int, double>"})
            after = land(moved.select(*keys, "bins", "y", "w", (F.col("margin") + F.try_element_at("leaves", F.col("node"))).alias("margin")))
        release(*earlier, tree)
        if turn + 1 < rounds:
            release(state)
            state = after
    every = grown[0]
    for other in grown[1:]:
        every = every.unionByName(other)
    models = land(every.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("round", F.map_entries("splits").alias("splits"),
                  F.map_entries("leaves").alias("leaves"), F.map_entries("gains").alias("gains")))).alias("trees")))
    release(state, *grown)
    return models


def score(models: DataFrame, cuts: DataFrame, rows: DataFrame, features: list[str], keys: list[str], depth: int) -> DataFrame:
    """Rows of the models' keys with ``proba`` and ``pred_label``."""
    value = F.aggregate("trees", F.lit(0.0), lambda m, t: m + F.coalesce(F.try_element_at(
        F.map_from_entries(t["leaves"]), _node(F.map_from_entries(t["splits"]), F.col("bins"), depth)), F.lit(0.0)))
    out = series._with_groups(binned(rows, cuts, features, keys), models.select(*keys, "trees"), keys)
    return out.withColumn("proba", 1 / (1 + F.exp(-value))).withColumn("pred_label", (F.col("proba") > 0.5).cast("int")).drop("bins", "trees")


def importances(models: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, importance): a feature's share of all gains of the key's model."""
    splits = models.select(*keys, F.explode("trees").alias("t")).select(*keys, F.inline(F.arrays_zip("t.splits", "t.gains")))
    gains = splits.groupBy(*keys, F.col("splits.value.feature").alias("i")).agg(F.sum("gains.value").alias("gain"))
    names = F.array(*map(F.lit, features))
    whole = Window.partitionBy(*keys)
    return gains.select(*keys, F.element_at(names, F.col("i") + 1).alias("feature"), (F.col("gain") / F.sum("gain").over(whole)).alias("importance"))
