"""Detectors, anomaly scoring, stats and drift on small frames."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anomaly as an
from ledgerlens.operators import drift as dr
from ledgerlens.operators import patterns as pt
from ledgerlens.operators import stats as st

SCHEMA = ("account_id INT, date TIMESTAMP, description STRING, amount DOUBLE, category STRING, hour INT, "
          "is_weekend BOOLEAN, day_of_week STRING, transaction_id STRING")
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def frame(spark, rows, account=1):
    out = []
    for i, (d, desc, amt, cat, hour) in enumerate(rows):
        dt = datetime.fromisoformat(d) + timedelta(hours=hour)
        out.append((account, dt, desc, amt, cat, hour, dt.weekday() >= 5, DAYS[dt.weekday()], f"t{account}_{i:04d}"))
    return spark.createDataFrame(out, SCHEMA)


def test_late_night_needs_time_of_day(spark):
    same_hour = frame(spark, [("2026-04-01", "Pizza", -10.0, "food_dining", 0)] * 5)
    assert pt.late_night_spending(same_hour).count() == 0
    mixed = frame(spark, [("2026-04-01", "Pizza", -10.0, "food_dining", 23), ("2026-04-02", "Pizza", -10.0,
                                                                              "food_dining", 12)])
    r = pt.late_night_spending(mixed).collect()[0]
    assert r["headline"] == "50% of food spend happens after 10 PM" and r["percentage"] == 50.0


def test_subscription_creep_threshold(spark):
    five = [("2026-04-01", f"Sub{i}", -5.0, "subscriptions", 0) for i in range(5)]
    assert pt.subscription_creep(frame(spark, five)).count() == 0
    six = five + [("2026-04-02", "Sub9", -5.0, "subscriptions", 0)]
    r = pt.subscription_creep(frame(spark, six)).collect()[0]
    assert r["subscription_count"] == 6 and r["headline"] == "6 active subscriptions totalling $30.00"


def test_income_irregularity(spark):
    two = [("2026-01-01", "Pay", 100.0, "income", 0), ("2026-01-20", "Pay", 100.0, "income", 0)]
    assert pt.income_irregularity(frame(spark, two)).count() == 0
    three = two + [("2026-01-22", "Pay", 100.0, "income", 0)]
    r = pt.income_irregularity(frame(spark, three)).collect()[0]
    assert r["income_events"] == 3 and r["avg_gap_days"] == 10.5 and r["std_gap_days"] == 12.0


def test_recurring_needs_two_months(spark):
    rows = [("2026-01-05", "Gym", -30.0, "health", 0), ("2026-02-05", "Gym", -30.0, "health", 0),
            ("2026-01-06", "Netflix", -9.0, "subscriptions", 0), ("2026-02-06", "Netflix", -9.0, "subscriptions", 0),
            ("2026-01-07", "Odd", -5.0, None, 0), ("2026-03-07", "Odd", -5.0, None, 0)]
    got = sorted(r["merchant"] for r in pt.recurring_forgotten(frame(spark, rows)).collect())
    assert got == ["Gym", "Odd"]


def test_anomalous_week_and_dominance(spark):
    rows = [("2026-03-30", "Rent", -1200.0, "housing", 0), ("2026-04-07", "Cafe", -10.0, "food_dining", 0),
            ("2026-04-14", "Cafe", -12.0, "food_dining", 0), ("2026-04-15", "Deli", -30.0, "food_dining", 0)]
    w = pt.anomalous_week(frame(spark, rows)).collect()[0]
    assert w["anomalous_week"] == "2026-03-30/2026-04-05" and w["week_total"] == 1200.0
    dom = {r["merchant"] for r in pt.merchant_dominance(frame(spark, rows)).collect()}
    assert dom == {"Rent", "Cafe", "Deli"}


def test_uniform_amounts_flag_nothing(spark):
    rows = [("2026-04-0%d" % (i + 1), "Same", -10.0, "other", 0) for i in range(6)]
    rows.append(("2026-04-08", "Pay", 100.0, "income", 0))
    out = an.score_anomalies(frame(spark, rows))
    assert out.where("is_anomaly").count() == 0


def test_single_outlier_flagged_with_reason(spark):
    rows = [("2026-04-%02d" % (i + 1), "Coffee", -5.0, "food_dining", 9) for i in range(19)]
    rows.append(("2026-04-21", "Jeweller", -1500.0, "shopping", 9))
    out = an.score_anomalies(frame(spark, rows)).where("is_anomaly").collect()
    assert len(out) == 1 and out[0]["description"] == "Jeweller"
    assert out[0]["anomaly_reason"] == "$1500.00 at Jeweller is 300.0x the median transaction"
    ex = an.extract_anomalies(an.score_anomalies(frame(spark, rows))).collect()
    assert [r["description"] for r in ex] == ["Jeweller"] and ex[0]["date"] == "2026-04-21"


def test_few_expenses_score_zero(spark):
    rows = [("2026-04-0%d" % (i + 1), "X", -float(i + 1), "other", 0) for i in range(4)]
    out = an.score_anomalies(frame(spark, rows)).collect()
    assert all(r["anomaly_score"] == 0.0 and not r["is_anomaly"] for r in out)


def test_contamination_validated(spark):
    with pytest.raises(ValueError):
        an.score_anomalies(frame(spark, [("2026-04-01", "X", -1.0, "other", 0)]), contamination=0.7)


def test_compute_stats_totals(spark):
    rows = [("2026-04-01", "Rent", -1200.0, "housing", 0), ("2026-04-02", "Cafe", -4.25, "food_dining", 0),
            ("2026-04-03", "Cafe", -4.25, "food_dining", 0), ("2026-04-04", "Pay", 3200.0, "income", 0)]
    s = st.compute_stats(frame(spark, rows)).collect()[0]
    assert (s["total_spent"], s["total_income"], s["net"]) == (-1208.5, 3200.0, 1991.5)
    assert (s["expense_count"], s["income_count"], s["largest_description"]) == (3, 1, "Rent")
    assert (s["most_frequent_merchant"], s["most_frequent_count"]) == ("Cafe", 2)


def test_keyed_stats_match_unkeyed(spark):
    rows = [("2026-04-01", "Rent", -1200.0, "housing", 0), ("2026-04-02", "Cafe", -4.25, "food_dining", 0)]
    both = frame(spark, rows, 1).unionByName(frame(spark, rows, 2))
    keyed = {r["account_id"]: r["total_spent"] for r in st.totals(both, ["account_id"]).collect()}
    assert keyed == {1: -1204.25, 2: -1204.25}
    assert st.totals(frame(spark, rows)).collect()[0]["total_spent"] == -1204.25


def test_new_category_drift(spark):
    prev = frame(spark, [("2026-03-01", "Cafe", -10.0, "food_dining", 0)])
    cur = frame(spark, [("2026-04-01", "Cafe", -20.0, "food_dining", 0), ("2026-04-02", "Gym", -30.0, "health", 0)])
    got = {r["category"]: (r["direction"], r["change_pct"], r["hint"]) for r in dr.category_drift(cur, prev).collect()}
    assert got["health"] == ("increased", None, "health is new this period ($30.0)")
    assert got["food_dining"][:2] == ("increased", 100.0)
    with pytest.raises(ValueError):
        dr.category_drift(cur, prev, threshold=1.5)


def test_velocity(spark):
    rows = [("2026-04-01", "A", -10.0, "other", 0), ("2026-04-30", "B", -40.0, "other", 0)]
    assert dr.spending_velocity(frame(spark, rows)).collect()[0]["velocity_trend"] == "accelerating"


def test_single_account_threshold_matches_numpy(spark):
    rows = [("2026-04-%02d" % (i % 28 + 1), f"M{i % 7}", -float(5 + (i * 37) % 101), "other", i % 24)
            for i in range(300)]
    rows.append(("2026-04-28", "Big", -4000.0, "shopping", 3))
    got = an.score_anomalies(frame(spark, rows)).select("amount", "anomaly_score", "is_anomaly").collect()
    x = np.array([abs(r["amount"]) for r in got])
    z = np.abs(x - x.mean()) / (x.std() + 1e-9)
    flagged = z >= np.percentile(z, 95) - 1e-12
    assert [r["is_anomaly"] for r in got] == flagged.tolist() and flagged.any()
    assert np.allclose([r["anomaly_score"] for r in got], z, rtol=1e-9)


def test_forest_finds_a_single_outlier(spark):
    rows = [("2026-04-%02d" % (i % 28 + 1), "M", -20.0 - (i % 5), "other", 12) for i in range(50)]
    rows.append(("2026-04-15", "Big", -5000.0, "other", 12))
    got = an.score_anomalies(frame(spark, rows), method="iforest").orderBy(F.desc("anomaly_score")).collect()
    assert got[0]["description"] == "Big" and got[0]["is_anomaly"]


def test_sub_cent_amounts_add_up(spark):
    rows = [("2026-04-01", "A", -0.004, "other", 0)] * 1000
    assert st.totals(frame(spark, rows)).collect()[0]["total_spent"] == pytest.approx(-4.0)
