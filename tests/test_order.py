from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.clean import dedup_near
from ledgerlens.operators.common import global_position, prev_in_order


def rows(spark, n=600, moments=40):
    rng = random.Random(2)
    data = [(rng.randint(0, 2), None if rng.random() < 0.05 else rng.randint(0, moments) * 7000, f"t{i:05d}") for i in range(n)]
    return spark.createDataFrame(data, "k INT, s INT, id STRING").withColumn("ts", F.timestamp_seconds("s")).repartition(5)


def test_prev_in_order_equals_a_plain_lag(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_last(), "id")
    want = df.withColumn("p", F.when(F.col("ts").isNotNull(), F.lag("ts").over(w)))
    got = prev_in_order(df, ["k"], "ts", "id", "p")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    alone = prev_in_order(df.drop("k"), [], "ts", "id", "p")
    assert alone.where("p is not null").count() == df.where("ts is not null").count() - 1


def test_one_moment_for_all_rows_is_no_window_of_rows(spark):
    """The rows of one key and moment meet in no window and no sort of rows:
    what is ordered has one row per moment."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(0).cast("timestamp").alias("ts"), F.format_string("%08d", "id").alias("id"))
    got = prev_in_order(df, ["k"], "ts", "id", "p")
    assert got.where("p is null").count() == 1
    moments = df.groupBy("k", "ts").agg(F.min("id")).count()
    assert moments == 1


def test_global_position(spark):
    df = rows(spark).select("k", "id")
    got = [r.id for r in global_position(df, [F.desc("k"), "id"], "at").orderBy("at").collect()]
    assert got == [r.id for r in df.orderBy(F.desc("k"), "id").collect()]
    at = sorted(r["at"] for r in global_position(df, ["k", "id"], "at").collect())
    assert at == list(range(len(at)))
    assert global_position(df.limit(0), ["k", "id"], "at").count() == 0


def test_undated_rows_all_stay(spark):
    data = [(1, None, "m", -1.0, f"t{i}") for i in range(50)] + [(1, "2024-01-01", "m", -1.0, "u1"), (1, "2024-01-02", "m", -1.0, "u2")]
    df = spark.createDataFrame(data, "k INT, d STRING, description STRING, amount DOUBLE, transaction_id STRING")
    df = df.withColumn("date", F.col("d").cast("timestamp")).drop("d")
    got = {r.transaction_id for r in dedup_near(df, ["k"], 2).collect()}
    assert got == {f"t{i}" for i in range(50)} | {"u1"}
