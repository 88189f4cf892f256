"""Description cleaning, de-duplication and date features."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from moments import ts
from ledgerlens.functions.text import normalize_description
from ledgerlens.operators.categorize import categorize_keywords
from ledgerlens.operators.clean import dedup_exact, dedup_near, deduplicate, normalize_dates

# raw -> (normalised, category): worked examples from the rule lists.
GOLDEN = [
    ("RENT PAYMENT ACH", "Rent Payment", "housing"),
    ("NETFLIX.COM", "Netflix.Com", "subscriptions"),
    ("TRADER JOE S #142", "Trader Joe'S", "groceries"),
    ("UBER* EATS 3948201", "Uber Eats", "food_dining"),
    ("AMAZON.COM 4827XPQR", "Amazon.Comxpqr", "shopping"),
    ("LYFT *RIDE 8293", "Lyft", "transportation"),
    ("CVS PHARMACY 2841", "Cvs Pharmacy", "shopping"),
    ("CHIPOTLE MEXICAN GRI", "Chipotle Gri", "food_dining"),
    ("MCDONALDS F23904", "Mcdonald'S", "food_dining"),
    ("PARKING 45TH ST MET", "Parking 45Th St Met", "transportation"),
    ("VENMO PAYMENT SENT", "Venmo Payment Sent", "other"),
    ("CHATGPT SUBSCRIPTION", "Openai Chatgpt Subscription", "subscriptions"),
    ("GRUBHUB ORDER 847201", "Grubhub Order", "food_dining"),
    ("UBER* TRIP 6748291", "Uber", "transportation"),
]


def test_normalize_and_keyword_golden(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in GOLDEN], "raw STRING")
    out = categorize_keywords(df.withColumn("description", normalize_description(F.col("raw"))))
    got = {r["raw"]: (r["description"], r["category"], r["category_confidence"]) for r in out.collect()}
    for raw, norm, cat in GOLDEN:
        assert got[raw][0] == norm, raw
        assert got[raw][1] == cat, raw
        assert got[raw][2] == (0.0 if cat == "other" else 0.9)


def _frame(spark, rows):
    return spark.createDataFrame(
        [(ts(d), desc, amt, desc, "generic", tid) for d, desc, amt, tid in rows],
        "date TIMESTAMP, description STRING, amount DOUBLE, raw_description STRING, source STRING, "
        "transaction_id STRING")


def test_near_dup_window(spark):
    rows = [("2026-04-01", "Coffee", -4.5, "a"), ("2026-04-02", "Coffee", -4.5, "b"),
            ("2026-04-10", "Coffee", -4.5, "c")]
    df = _frame(spark, rows)
    assert dedup_near(df, (), 0).count() == 3
    assert sorted(r["transaction_id"] for r in dedup_near(df, (), 2).collect()) == ["a", "c"]


def test_near_dup_chain_collapses_to_first(spark):
    # each row is within 2 days of the previous one: the chain keeps only the first
    rows = [("2026-04-01", "X", -1.0, "a"), ("2026-04-02 12:00:00", "X", -1.0, "b"),
            ("2026-04-04", "X", -1.0, "c"), ("2026-04-05 23:00:00", "X", -1.0, "d")]
    assert [r["transaction_id"] for r in dedup_near(_frame(spark, rows), (), 2).collect()] == ["a"]


def test_near_dup_boundary_inclusive(spark):
    rows = [("2026-04-01 10:00:00", "X", -1.0, "a"), ("2026-04-03 10:00:00", "X", -1.0, "b"),
            ("2026-04-05 10:00:01", "X", -1.0, "c")]
    kept = sorted(r["transaction_id"] for r in dedup_near(_frame(spark, rows), (), 2).collect())
    assert kept == ["a", "c"]  # exactly 2 days is a duplicate, 2 days + 1 s is not


def test_near_dup_keeps_null_dates_and_other_amounts(spark):
    df = spark.createDataFrame(
        [(None, "X", -1.0, "X", "g", "n1"), (None, "X", -1.0, "X", "g", "n2"),
         (ts("2026-04-01"), "X", -1.0, "X", "g", "a"), (ts("2026-04-01"), "X", -2.0, "X", "g", "b")],
        "date TIMESTAMP, description STRING, amount DOUBLE, raw_description STRING, source STRING, "
        "transaction_id STRING")
    assert dedup_near(df, (), 7).count() == 4


@pytest.mark.parametrize("window", [-1, 8])
def test_window_out_of_range(spark, window):
    with pytest.raises(ValueError):
        deduplicate(_frame(spark, [("2026-04-01", "X", -1.0, "a")]), window)


def test_exact_dedup_keeps_first(spark):
    df = spark.createDataFrame(
        [(ts("2026-04-02"), "X", -1.0, "X", "b_src", "t1"), (ts("2026-04-01"), "X", -1.0, "X", "z_src", "t1"),
         (ts("2026-04-01"), "X", -1.0, "X", "a_src", "t1"), (ts("2026-04-03"), "Y", -2.0, "Y", "g", "t2")],
        "date TIMESTAMP, description STRING, amount DOUBLE, raw_description STRING, source STRING, "
        "transaction_id STRING")
    out = {r["transaction_id"]: r["source"] for r in dedup_exact(df).collect()}
    assert out == {"t1": "a_src", "t2": "g"}


def test_keyed_equals_unkeyed_per_account(spark):
    rows = [("2026-04-01", "Coffee", -4.5, "a"), ("2026-04-02", "Coffee", -4.5, "b"),
            ("2026-04-10", "Coffee", -4.5, "c")]
    one = _frame(spark, rows)
    two = one.withColumn("account_id", F.lit(1)).unionByName(one.withColumn("account_id", F.lit(2)))
    keyed = dedup_near(two, ["account_id"], 2)
    assert keyed.count() == 2 * dedup_near(one, (), 2).count()


def test_normalize_dates(spark):
    df = spark.createDataFrame([(ts("2026-04-04 23:15:00"),), (ts("2026-04-06 08:00:00"),)], "date TIMESTAMP")
    rows = normalize_dates(df).orderBy("date").collect()
    assert (rows[0]["day_of_week"], rows[0]["week_of_month"], rows[0]["is_weekend"], rows[0]["hour"]) == \
        ("Saturday", 1, True, 23)
    assert (rows[1]["day_of_week"], rows[1]["is_weekend"], rows[1]["hour"]) == ("Monday", False, 8)
