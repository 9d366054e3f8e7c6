"""Linear models, order search and oversampling against numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import linear, series, trees
from marketframe.operators.gram import correlations, moments


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    parts = []
    for s, n in (("A", 240), ("B", 130)):
        x = rng.normal(0, 1, (n, 3))
        y = x @ [0.5, -1.0, 2.0] + 0.3 + rng.normal(0, 0.1, n)
        y[1:] += 0.4 * y[:-1]
        parts.append(pd.DataFrame({"symbol": s, "date": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)],
                                   "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": y, "close": 100.0}))
    return pd.concat(parts, ignore_index=True)


X = ["x1", "x2", "x3"]


def test_fit_is_least_squares(spark, rows):
    got = {r.symbol: r for r in linear.fit(spark.createDataFrame(rows).repartition(5), X, "y", ridge=0.0).collect()}
    for s, g in rows.groupby("symbol"):
        a = np.column_stack([g[X], np.ones(len(g))])
        b, *_ = np.linalg.lstsq(a, g["y"], rcond=None)
        np.testing.assert_allclose([*got[s].coef, got[s].intercept], b, rtol=1e-8)
        assert got[s].sigma == pytest.approx(np.sqrt(np.mean((g["y"] - a @ b) ** 2)))
        assert got[s].n == len(g)


def test_constant_and_repeated_features_are_solved(spark, rows):
    df = spark.createDataFrame(rows).withColumn("one", F.lit(3.0)).withColumn("x1b", F.col("x1"))
    got = linear.fit(df, ["x1", "x1b", "one"], "y").collect()
    assert all(np.isfinite(r.coef).all() and np.isfinite(r.intercept) for r in got)


def test_correlations(spark, rows):
    got = {(r.symbol, r.earlier, r.later): r["corr"] for r in correlations(moments(spark.createDataFrame(rows), [*X, "y"], ["symbol"]), [*X, "y"], ["symbol"]).collect()}
    assert len(got) == 12
    for s, g in rows.groupby("symbol"):
        assert got[(s, "x3", "y")] == pytest.approx(g["x3"].corr(g["y"]))


def test_order_search_low_is_plain_regression(spark, rows):
    got = linear.order_search(spark.createDataFrame(rows), X, "y", 30, "LOW").toPandas()
    assert len(got) == 4 and set(got["season"]) == {7, 30} and got["best"].sum() == 2
    for s, g in rows.groupby("symbol"):
        n, size = len(g), len(g) // 4
        errors = []
        for i in range(3):
            cut = n - (3 - i) * size
            a = np.column_stack([g[X], np.ones(n)])
            b, *_ = np.linalg.lstsq(a[:cut], g["y"][:cut], rcond=None)
            errors.append(np.sqrt(np.mean((g["y"][cut:cut + size] - a[cut:cut + size] @ b) ** 2)))
        np.testing.assert_allclose(got[got["symbol"] == s]["rmse"], np.mean(errors), rtol=1e-5)


def test_order_search_finds_the_lag(spark, rows):
    got = linear.order_search(spark.createDataFrame(rows), X, "y", 30, "MEDIUM").toPandas()
    assert len(got) == 2 * 8 * 2
    best = got[got["best"]]
    assert (best["p"] == 1).all() and (best["d"] == 0).all()
    # one order by hand: p = 1, d = 0, q = 0, season 7
    g = rows[rows["symbol"] == "A"].reset_index(drop=True)
    g["l1"], g["l7"] = g["y"].shift(1), g["y"].shift(7)
    usable = g.copy()
    usable["l30"] = g["y"].shift(61)
    n, size, errors = len(g), len(g) // 4, []
    ok = usable["l30"].notna()
    a = np.column_stack([g[[*X, "l1", "l7"]], np.ones(n)])
    for i in range(3):
        cut = n - (3 - i) * size
        train, test = ok & (g.index < cut), ok & (g.index >= cut) & (g.index < cut + size)
        if not train.any():
            continue
        b, *_ = np.linalg.lstsq(a[train], g["y"][train], rcond=None)
        errors.append(np.sqrt(np.mean((g["y"][test] - a[test] @ b) ** 2)))
    row = got[(got["symbol"] == "A") & (got["p"] == 1) & (got["d"] == 0) & (got["q"] == 0) & (got["season"] == 7)].iloc[0]
    assert row["rmse"] == pytest.approx(np.mean(errors), rel=0.05)
    with pytest.raises(ValueError):
        linear.order_search(spark.createDataFrame(rows), X, "y", 30, "x")


def test_scoring_modes_and_future_point(spark, rows):
    df = spark.createDataFrame(rows[rows["symbol"] == "A"]).withColumn("pred", F.dayofyear("date") / 1000.0)
    end = dt.date(2020, 5, 1)
    req = spark.createDataFrame([("A", end)], "symbol string, input_date date")
    for mode, lag in (("reference", 7), ("corrected", 0)):
        got = {r.date: r.predicted_price for r in linear.score_dates(df, req, 7, mode).collect()}
        due = end - dt.timedelta(days=7)
        want = 100.0 * np.exp((due - dt.timedelta(days=lag)).timetuple().tm_yday / 1000)
        assert got[end] == pytest.approx(want)
    last = rows[rows["symbol"] == "A"]["date"].max()
    p = linear.future_point(df, 7, "corrected").first()
    assert p.date == last + dt.timedelta(days=7) and p.predicted_price == pytest.approx(100 * np.exp(last.timetuple().tm_yday / 1000))


def test_oversample_evens_classes_between_nearest_neighbours(spark, rows):
    pdf = rows.assign(target=(rows.index % 4 == 0).astype(int))
    got = trees.oversample(spark.createDataFrame(pdf), X).toPandas()
    for s, g in pdf.groupby("symbol"):
        few, many = g[g["target"] == 1], g[g["target"] == 0]
        made = got[got["symbol"] == s]
        assert len(made) == len(many) - len(few) and (made["target"] == 1).all()
        pts = few[X].to_numpy()
        for _, r in made.iterrows():
            a = few[few["date"] == r["origin_date"]][X].to_numpy()[0]
            d = np.linalg.norm(pts - a, axis=1)
            near = pts[np.argsort(d)[1:6]]
            m = r[X].to_numpy(dtype=float)
            # on the segment from the row to one of its five nearest
            gap = [np.linalg.norm(m - a) + np.linalg.norm(m - b) - np.linalg.norm(a - b) for b in near]
            assert min(gap) < 1e-9


def test_one_long_series_is_spread_over_tasks(spark):
    df = spark.range(40_000).selectExpr("'HOT' AS symbol", "timestamp_seconds(id * 60) AS ts", "CAST(id % 91 AS DOUBLE) AS close")
    c = series.chunked(df, ["symbol"], "ts", 100, rows=1000, width=3600)
    sizes = c.groupBy("symbol", series.CHUNK).count().toPandas()["count"]
    assert len(sizes) == 40 and sizes.max() <= 1100
    assert c.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert series.own_rows(c).count() == 40_000


def test_every_symbol_and_order_has_a_row(spark, rows):
    from marketframe.operators.linear import _orders
    short = rows[rows["symbol"] == "A"].head(40).assign(symbol="S")
    empty = rows[rows["symbol"] == "A"].head(3).assign(symbol="E", y=None)
    got = linear.order_search(spark.createDataFrame(pd.concat([rows, short, empty.astype({"y": float})])), X, "y", 30, "MEDIUM").toPandas()
    assert len(got) == 4 * len(_orders("MEDIUM", [7, 30]))
    assert (got["rmse"].isna() == got["reason"].notna()).all()
    assert got[got["symbol"] == "E"]["reason"].eq("no complete rows").all() and got[got["symbol"] == "S"]["rmse"].notna().any()
    assert got[got["best"]].groupby("symbol").size().to_dict() == {"A": 1, "B": 1, "S": 1}


def test_an_only_minority_row_is_repeated(spark, rows):
    pdf = rows[rows["symbol"] == "A"].head(20).reset_index(drop=True)
    pdf["target"] = (pdf.index == 4).astype(int)
    made = trees.oversample(spark.createDataFrame(pdf), X).toPandas()
    assert len(made) == 18 and np.allclose(made[X].to_numpy(dtype=float), pdf.loc[4, X].to_numpy(dtype=float)) and (made["target"] == 1).all()


def test_tree_models_learn_and_repeat(spark):
    draw = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({"symbol": np.where(np.arange(n) % 2, "A", "B"), "date": pd.date_range("2020-01-01", periods=n).date,
                        "x1": draw.normal(size=n), "x2": draw.normal(size=n), "x3": draw.normal(size=n), "close": 10.0})
    pdf["target"] = ((pdf.x1 > 0) ^ (pdf.x2 > 0.3)).astype(int)
    pdf["log_return_future"] = pdf.x1 * 2 + draw.normal(size=n) * 0.1
    df = spark.createDataFrame(pdf).cache()
    params = {"max_depth": 3, "n_estimators": 8, "learning_rate": 0.3}
    train, test = df.where("dayofyear(date) % 4 <> 0"), df.where("dayofyear(date) % 4 = 0")
    scored = [trees.classify(trees.train_classifier(train, X, params), test, X).orderBy("date").toPandas() for _ in range(2)]
    assert scored[0]["proba"].tolist() == scored[1]["proba"].tolist()
    right = (scored[0]["pred_label"] == scored[0]["target"]).mean()
    assert right > 0.85 > max(scored[0]["target"].mean(), 1 - scored[0]["target"].mean())
    found = trees.grid_search(df, X, [params, {**params, "n_estimators": 1, "max_depth": 1}]).toPandas()
    assert len(found) == 2 and found["best"].sum() == 1 and found.loc[0, "best"] and found["f1"].between(0, 1).all()
    importance = trees.regression_importance(df, X, trees=10).toPandas().set_index("feature").importance
    assert importance.idxmax() == "x1" and abs(importance.sum() - 1) < 1e-9
    both = trees.classification_importance(df, X, rounds=4).toPandas().set_index("feature").importance
    assert both["x3"] < min(both["x1"], both["x2"])


def test_nearest_in_projection_tables_has_the_true_neighbours(spark):
    """28 features of a few factors, as indicators are; a long symbol in cells, a short one whole."""
    rng = np.random.default_rng(8)
    mixing = rng.normal(0, 1, (6, 28))
    parts, points = [], {}
    for s, n in (("long", 2500), ("short", 60)):
        x = rng.normal(0, 1, (n, 6)) @ mixing + rng.normal(0, 0.3, (n, 28))
        points[s] = x
        parts += [(s, dt.date(2010, 1, 1) + dt.timedelta(days=i), n, *map(float, v)) for i, v in enumerate(x)]
    names = [f"f{i}" for i in range(28)]
    df = spark.createDataFrame(parts, "symbol string, date date, _n long, " + ", ".join(f"{f} double" for f in names)).repartition(4)
    found = {(r.symbol, r.date): {tuple(n["_ov"]) for n in r["_nns"]} for r in trees.nearest(df, names, 5).collect()}
    assert len(found) == 2560
    for s, x in points.items():
        square = (x ** 2).sum(axis=1)
        d = square[:, None] + square - 2 * x @ x.T
        np.fill_diagonal(d, np.inf)
        want = np.argsort(d, axis=1)[:, :5]
        hits = sum(tuple(x[j].tolist()) in found[s, dt.date(2010, 1, 1) + dt.timedelta(days=i)] for i in range(len(x)) for j in want[i])
        assert hits / want.size >= (0.95 if s == "long" else 1.0), (s, hits / want.size)
