"""Results must not depend on partitioning, and keyed = unkeyed per account."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import anomaly as an
from ledgerlens.operators import patterns as pt
from ledgerlens.operators import stats as st
from ledgerlens.plans.analyze import enrich
from ledgerlens.sources.ledgers import ledger_events

SF = "/root/testdata/sf0.001"
KEYS = ["account_id"]


def _collect(df):
    return sorted(tuple(r) for r in df.collect())


def _facets(spark):
    e = enrich(ledger_events(spark, SF), KEYS)
    return {
        "stats": st.compute_stats(e, KEYS),
        "patterns": pt.detect_patterns(e, KEYS).drop("data"),
        "flags": an.score_anomalies(e, KEYS).select("account_id", "transaction_id", "anomaly_score", "is_anomaly",
                                                    "anomaly_reason"),
    }


def test_partition_count_invariance(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = {k: _collect(v) for k, v in _facets(spark).items()}
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seven = {k: _collect(v) for k, v in _facets(spark).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k in one:
        assert one[k] == seven[k], k


def test_keyed_equals_unkeyed_for_one_account(spark):
    led = ledger_events(spark, SF)
    acct = led.groupBy("account_id").count().orderBy(F.desc("count"), "account_id").first()["account_id"]
    keyed = enrich(led, KEYS)
    k_stats = st.compute_stats(keyed, KEYS).where(F.col("account_id") == acct).drop("account_id")
    single = enrich(led.where(F.col("account_id") == acct), KEYS)
    u_stats = st.compute_stats(single.drop("account_id"), ())
    assert _collect(k_stats) == _collect(u_stats)
    k_week = st.by_week(keyed, KEYS).where(F.col("account_id") == acct).drop("account_id")
    assert _collect(k_week) == _collect(st.by_week(single, ()))
