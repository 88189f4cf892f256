from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anomaly, drift, patterns, stats

SCHEMA = "account_id INT, date TIMESTAMP, description STRING, amount DOUBLE, transaction_id STRING"


def ledger(spark, amounts, account=1):
    rows = [(account, None, f"m{i}", a, f"t{i}") for i, a in enumerate(amounts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("date", F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, cast(substring(transaction_id, 2) as int))"))


@pytest.mark.parametrize("big", [1e13, 1e25, 1e100])
def test_no_amount_fails_a_job(spark, big):
    df = ledger(spark, [-big, -1.25, -2.5, 4.0, 0.0]).withColumn("category", F.lit("subscriptions"))
    t = stats.totals(df, ["account_id"]).first()
    assert t.total_spent == -big - 3.75 and t.total_income == 4.0 and t.expense_count == 3
    assert stats.by_category(df).first().total == big + 3.75
    assert stats.compute_stats(df, ["account_id"]).first().subscription_total == big + 3.75
    scores = {r.transaction_id: r.raw_score for r in anomaly.zscore_scores(anomaly.anomaly_features(df)).collect()}
    assert len(scores) == 3 and scores["t0"] > scores["t1"] >= 0
    assert patterns.detect_patterns(df, ["account_id"]).count() >= 1
    assert drift.category_drift(df, df.where("false")).first().current == pytest.approx(big + 3.75)


def test_sums_are_exact_and_ignore_order(spark):
    amounts = [-0.1, -0.2, -0.3, -1e-8, -123456789.12345678] * 200
    one = stats.totals(ledger(spark, amounts).repartition(1)).first().total_spent
    many = stats.totals(ledger(spark, amounts).repartition(7)).first().total_spent
    assert one == many == -24691357944.691358


def test_sums_beyond_the_decimals_are_added_as_doubles(spark):
    many = spark.range(400).select(F.lit(-9.9e19).alias("amount"))  # each fits, and so does the sum
    assert stats.totals(many).first().total_spent == pytest.approx(-9.9e19 * 400)
    assert stats.totals(many.where("false")).first().total_spent == 0.0


def test_optional_columns_are_not_needed(spark):
    df = ledger(spark, [-5.0, -6.0, 7.0])
    assert stats.compute_stats(df, ["account_id"]).first().subscription_total == 0.0
    assert stats.by_category(df, ["account_id"]).count() == 0
    assert {r.facet for r in stats.stats_facets(df, ["account_id"]).collect()} == {"week", "merchant"}
    assert drift.category_drift(df, df).count() == 0
    found = {r.type for r in patterns.detect_patterns(df, ["account_id"]).collect()}
    assert not found & {"LATE_NIGHT_SPENDING", "SUBSCRIPTION_CREEP", "WEEKEND_SPLURGE", "SINGLE_MERCHANT_DOMINANCE", "RECURRING_FORGOTTEN"}
    for detector in (patterns.late_night_spending, patterns.subscription_creep, patterns.weekend_splurge,
                     patterns.merchant_dominance, patterns.recurring_forgotten):
        assert detector(df, ["account_id"]).count() == 0


def test_facets_agree_with_the_single_aggregates(spark, tmp_path):
    df = ledger(spark, [-float(i % 7 + 1) for i in range(60)]).withColumn("category", F.when(F.col("amount") < -3, "a").otherwise("b"))
    df = df.withColumn("description", F.concat(F.lit("m"), F.pmod(F.hash("transaction_id"), F.lit(30))))
    df.write.parquet(str(tmp_path / "ledger"))
    df = spark.read.parquet(str(tmp_path / "ledger"))
    facets = stats.stats_facets(df, ["account_id"], merchants=5)
    got = {(r.facet, r["name"]): (r.total, r["count"]) for r in facets.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "category"} == {r.category: (r.total, r["count"]) for r in stats.by_category(df).collect()}
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "week"} == {r.week: r.total for r in stats.by_week(df).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "merchant"} == {r.description: (r.total, r["count"]) for r in stats.top_merchants(df, (), 5).collect()}
    plan = stats.stats_facets(df, ["account_id"], merchants=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
    assert stats.stats_facets(df.limit(0), ["account_id"]).count() == 0


def test_shares_of_spend(spark):
    df = ledger(spark, [-10.0, -30.0, 100.0]).withColumn("category", F.when(F.col("amount") == -10, "subscriptions").otherwise("rent"))
    got = {(r.facet, r["name"]): r.pct_of_spend for r in stats.share_of_spend(df, ["account_id"]).collect()}
    assert got == {("category", "subscriptions"): 25.0, ("category", "rent"): 75.0, ("outflow", "subscriptions"): 25.0,
                   ("merchant", "m0"): 25.0, ("merchant", "m1"): 75.0}
