"""Windows that are cut into buckets equal the undivided ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stackplume.operators import windows as wn


@pytest.mark.parametrize("bucket", ["HOUR", "DAY", "MONTH"])
def test_rolling_means(spark, bucket):
    rng = np.random.default_rng(3)
    n = 3000
    frame = pd.DataFrame(
        {
            "factory_id": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcdef"), n)),
            "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta((rng.exponential(1, n).cumsum() * 700).astype(int), "s"),
            "event_id": np.arange(n),
            "pm25": np.where(rng.random(n) < 0.2, np.nan, rng.normal(50, 20, n)),
        }
    )
    df = spark.createDataFrame(frame).withColumn("pm25", F.when(~F.isnan("pm25"), F.col("pm25")))
    plain = Window.partitionBy("factory_id").orderBy("timestamp", "event_id")
    expected = df.select("event_id", F.avg("pm25").over(plain.rowsBetween(-6, 0)).alias("a"), F.avg("pm25").over(plain.rowsBetween(-29, 0)).alias("b"))
    out = wn.rolling_means(df, "factory_id", "timestamp", "event_id", "pm25", {"a": 7, "b": 30}, bucket)
    joined = out.select("event_id", F.col("a").alias("a2"), F.col("b").alias("b2")).join(expected, "event_id").toPandas()
    assert len(joined) == n
    assert np.allclose(joined["a"], joined["a2"], equal_nan=True) and np.allclose(joined["b"], joined["b2"], equal_nan=True)


def test_split_shares_hold_in_every_stratum(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("bin"))
    out = wn.stratified_split(df, "bin", ["id"])
    assert out.count() == 3000
    counts = {(r["bin"], r["split"]): r["count"] for r in out.groupBy("bin", "split").count().collect()}
    for stratum in (None, 0, 1):
        assert counts[(stratum, "test")] == 150 and counts[(stratum, "val")] == 150 and counts[(stratum, "train")] == 700


def test_sample_is_the_same_on_any_partitioning(spark):
    ids = lambda df: sorted(r["id"] for r in wn.deterministic_sample(df, 50, 42, "id").collect())
    assert ids(spark.range(1000)) == ids(spark.range(1000).repartition(7))


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    out = wn.first_per_key(df, ["k"], [F.col("id").desc()])
    assert sorted((r["k"], r["id"]) for r in out.collect()) == [(0, 999), (1, 997), (2, 998)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
