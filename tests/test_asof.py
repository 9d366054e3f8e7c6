"""As-of joins on timestamps, in buckets, against pandas and against the join by date."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators.asof import asof_join


def _frames(n=400, seed=5):
    rng = np.random.default_rng(seed)
    at = lambda m: pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20_000, m) * 7, unit="s")
    left = pd.DataFrame({"id": range(n), "k": rng.choice(["a", "b", "c"], n), "t": at(n)})
    right = pd.DataFrame({"k": rng.choice(["a", "b", "d"], n // 8), "u": at(n // 8), "v": rng.integers(0, 9, n // 8)})
    return left, right.drop_duplicates(["k", "u"])


@pytest.mark.parametrize("direction,strict,tolerance,kind", [
    ("backward", False, None, "timestamp"), ("forward", True, None, "timestamp_ntz"), ("backward", True, 0.05, "timestamp_ntz")])
def test_times_as_pandas_finds_them(spark, direction, strict, tolerance, kind):
    left, right = _frames()
    a = spark.createDataFrame(left).withColumn("t", F.col("t").cast(kind))
    b = spark.createDataFrame(right).withColumn("u", F.col("u").cast(kind))
    got = asof_join(a, b, ["k"], "t", "u", ["v"], direction=direction, strict=strict, tolerance_days=tolerance, matched="m", bucket=600).toPandas()
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="k", direction=direction,
                         allow_exact_matches=not strict, tolerance=pd.Timedelta(days=tolerance) if tolerance else None)
    both = got.merge(want, on="id", suffixes=("", "_want"))
    assert len(both) == len(left) and both.v_want.notna().any()
    assert both.v.fillna(-1).tolist() == both.v_want.fillna(-1).tolist()
    assert both.m.dropna().tolist() == both.u.dropna().tolist()


def test_buckets_of_days_change_nothing(spark):
    left, right = _frames()
    a = spark.createDataFrame(left).select("id", "k", F.expr("date_add(DATE '2024-01-01', CAST(unix_timestamp(t) % 997 AS int))").alias("t"))
    b = spark.createDataFrame(right).select("k", "v", F.expr("date_add(DATE '2024-01-01', CAST(unix_timestamp(u) % 997 AS int))").alias("u"))
    for how in ({}, {"direction": "forward", "strict": True}, {"tolerance_days": 20}):
        plain = asof_join(a, b, ["k"], "t", "u", ["v"], matched="m", **how)
        cut = asof_join(a, b, ["k"], "t", "u", ["v"], matched="m", bucket=30, **how)
        assert plain.exceptAll(cut).count() == 0 and cut.count() == len(left)


def test_nulls_nothing_and_types(spark):
    a = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, None, "2024-01-01 10:00:00"), (3, "a", None)], "id int, k string, t string") \
        .withColumn("t", F.to_timestamp("t"))
    b = spark.createDataFrame([("a", "2023-01-01 00:00:00", None), ("a", None, 4), (None, "2023-01-01 00:00:00", 5)], "k string, u string, v int") \
        .withColumn("u", F.to_timestamp("u"))
    got = {r.id: (r.v, r.m is not None) for r in asof_join(a, b, ["k"], "t", "u", ["v"], matched="m", bucket=3600).collect()}
    assert got == {1: (None, True), 2: (None, False), 3: (None, False)}
    assert {r.v for r in asof_join(a, b.where("false"), ["k"], "t", "u", ["v"], bucket=3600).collect()} == {None}
    assert asof_join(a.where("false"), b, ["k"], "t", "u", ["v"], bucket=3600).count() == 0
    with pytest.raises(TypeError):
        asof_join(a, b.withColumn("u", F.to_date("u")), ["k"], "t", "u", ["v"], bucket=3600)


def test_one_key_spreads(spark):
    rows = spark.range(5000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"))
    hits = spark.range(50).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 6000).alias("u"), F.col("id").alias("v"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = asof_join(rows, hits, ["k"], "t", "u", ["v"], bucket=3600)
        assert out.where("v <> floor(unix_timestamp(t) / 6000)").count() == 0
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the rows are sorted by key and bucket; by the key alone only the table of bucket ends is
        assert "_bucket" in plan.split("Window [last(_hit")[1].split("\n")[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
