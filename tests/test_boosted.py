"""Boosted trees of all keys at once against one tree grown by trying every split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.operators import boosted
from marketframe.operators.landing import land, release

X = ["a", "b", "c"]
CUTS = [[-1.0, -0.5, 0.0, 0.5, 1.0], [-1.0, 0.0, 1.0], [0.0]]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    parts = []
    for key, n in (("K", 260), (None, 120), ("one", 30)):
        x = rng.normal(0, 1, (n, 3))
        y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.8) ^ (rng.random(n) < 0.1)).astype(int)
        parts += [(key, *map(float, v), 1 if key == "one" else int(t)) for v, t in zip(x, y)]
    return parts


def grown(data, depth, rounds, rate, balanced):
    """Margins by trying every cut of every feature in every node."""
    x, y = np.array([r[1:4] for r in data]), np.array([r[4] for r in data], float)
    w = np.where(y == 1, (1 - y).sum() / y.sum(), 1.0) if balanced else np.ones(len(y))
    margin, splits = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = w * (p - y), w * p * (1 - p), np.ones(len(y), int)
        for _ in range(depth):
            for k in sorted(set(node)):
                at, best = node == k, None
                for f, cuts in enumerate(CUTS):
                    for b, cut in enumerate(cuts):
                        left, right = at & (x[:, f] <= cut), at & (x[:, f] > cut)
                        if h[left].sum() < 1 or h[right].sum() < 1:
                            continue
                        s = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                        gain = round(s(left) + s(right) - s(at), 9)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, f, b, cut)
                if best:
                    splits.append((int(k), best[1], best[2]))
                    node[at] = 2 * k + (x[at, best[1]] > best[3])
        for k in set(node):
            at = node == k
            margin[at] += -rate * g[at].sum() / (h[at].sum() + 1)
    return 1 / (1 + np.exp(-margin)), splits


@pytest.mark.parametrize("balanced", [False, True])
def test_all_keys_match_their_own_search(spark, rows, balanced):
    df = spark.createDataFrame(rows, "symbol string, a double, b double, c double, target int").repartition(5)
    cuts = land(boosted.fixed_cuts(df, CUTS, ["symbol"]))
    models = boosted.train(df, cuts, X, ["symbol"], 2, 3, 0.3, balanced=balanced)
    trees = {r.symbol: r.trees for r in models.collect()}
    got = boosted.score(models, cuts, df, X, ["symbol"], 2).toPandas()
    assert len(got) == len(rows) and set(trees) == {"K", None, "one"}
    for key in ("K", None):
        data = [r for r in rows if r[0] == key]
        want, splits = grown(data, 2, 3, 0.3, balanced)
        mine = got[got["symbol"].isna()] if key is None else got[got["symbol"] == key]
        order = lambda v: np.lexsort(np.asarray(v, float).T)
        np.testing.assert_allclose(mine["proba"].to_numpy()[order(mine[X])], want[order([r[1:4] for r in data])], rtol=1e-9)
        found = [(s.key, s.value.feature, s.value.bin) for t in trees[key] for s in t.splits]
        assert sorted(found) == sorted(splits)
    shares = boosted.importances(models, X, ["symbol"]).groupBy("symbol").agg(F.sum("importance").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in shares)


def test_quantile_cuts_and_missing_values(spark):
    df = spark.createDataFrame([("K", float(i), 1.0, 3.0 if i == 99 else None) for i in range(100)], "symbol string, a double, b double, c double")
    cuts = boosted.quantile_cuts(df, X, ["symbol"], 4)
    assert cuts.first().cuts == [[24.0, 49.0, 74.0], [1.0], [3.0]]
    got = boosted.binned(df, cuts, X, ["symbol"]).select("a", "bins").collect()
    assert [r.bins[0] for r in sorted(got)] == [0] * 25 + [1] * 25 + [2] * 25 + [3] * 25 and {r.bins[2] for r in got} == {0}  # a missing value is the smallest


def test_every_key_gets_a_model(spark, rows):
    df = spark.createDataFrame([(f"k{i % 50}", *r[1:]) for i, r in enumerate(rows)], "symbol string, a double, b double, c double, target int")
    cuts = boosted.fixed_cuts(df, CUTS, ["symbol"])
    models = boosted.train(df, cuts, X, ["symbol"], 1, 1, 0.3)
    assert models.count() == 50


def test_release_removes_what_was_landed(spark):
    kept, gone = land(spark.range(3)), land(spark.range(4))
    release(gone, None)
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()
