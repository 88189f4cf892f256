"""Parquet store: insert-if-absent, runs, previous period, merchant merge, narratives."""

from __future__ import annotations

import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from ledgerlens.operators.narrative import migrate_narratives, parse_narratives, quality_guard
from ledgerlens.sources.store import LedgerStore, run_rows

SCHEMA = ("date TIMESTAMP, description STRING, raw_description STRING, amount DOUBLE, source STRING, "
          "category STRING, transaction_id STRING")


def _tx(spark, rows):
    return spark.createDataFrame([(datetime.fromisoformat(d), desc, desc, a, "chase", c, t) for d, desc, a, c, t in rows],
                                 SCHEMA)


def test_save_twice_inserts_nothing(spark):
    store = LedgerStore(spark, tempfile.mkdtemp(prefix="ll-store-"))
    df = _tx(spark, [("2026-04-01", "Cafe", -4.0, "food_dining", "a"), ("2026-04-02", "Rent", -900.0, "housing", "b")])
    assert store.save_transactions(df, "run1") == 2
    assert store.save_transactions(df, "run2") == 0
    assert store.get_transactions("2026-04-02", None).count() == 1
    counts = {r["table_name"]: r["n"] for r in store.db_stats().collect()}
    assert counts == {"transactions": 2, "analysis_runs": 0, "merchants": 0}


def test_previous_period_picks_latest(spark):
    store = LedgerStore(spark, tempfile.mkdtemp(prefix="ll-store-"))
    df = _tx(spark, [("2026-01-10", "A", -1.0, None, "a"), ("2026-02-10", "B", -2.0, None, "b"),
                     ("2026-03-10", "C", -3.0, None, "c")])
    store.save_transactions(df, "r")
    runs = run_rows(df, (), period=F.month("date"))
    store.save_runs(runs)
    cur = spark.createDataFrame([(datetime(2026, 3, 1),)], "current_start TIMESTAMP")
    got = [r["description"] for r in store.get_previous_period(cur).collect()]
    assert got == ["B"]


def test_merchant_upsert_accumulates(spark):
    store = LedgerStore(spark, tempfile.mkdtemp(prefix="ll-store-"))
    df = _tx(spark, [("2026-04-01", "Cafe", -4.0, "food_dining", "a"), ("2026-04-05", "Cafe", -6.0, "food_dining", "b")])
    store.upsert_merchants(df)
    store.upsert_merchants(df)
    r = store.get_merchants(10).collect()[0]
    assert float(r["total_spent"]) == 20.0 and r["transaction_count"] == 4
    assert r["first_seen"] == datetime(2026, 4, 1) and r["last_seen"] == datetime(2026, 4, 5)
    later = _tx(spark, [("2026-05-01", "cafe ", -1.0, "other", "c")])
    store.upsert_merchants(later)
    r = store.get_merchants(10).collect()[0]
    assert r["category"] == "food_dining" and r["first_seen"] == datetime(2026, 4, 1)
    assert r["last_seen"] == datetime(2026, 5, 1) and float(r["total_spent"]) == 21.0


def test_narrative_versions(spark):
    df = spark.createDataFrame([
        ('{"tldr": "old", "insights": "not a list"}',),
        ('{"schema_version": 1, "tldr": "cur", "insights": [{"headline": "h", "detail": "d"}], "next_steps": "n"}',),
        ('{"schema_version": 3, "tldr": "new"}',),
        ('Sure! {"tldr": "x"}',),
    ], "narrative_json STRING")
    p = parse_narratives(df)
    assert [r["valid"] for r in p.collect()] == [True, True, True, False]
    m = {r["tldr"]: r for r in migrate_narratives(p.where("valid")).collect()}
    assert m["old"]["schema_version"] == 0 and m["old"]["n_insights"] == 0 and m["old"]["next_steps"] == ""
    assert m["cur"]["n_insights"] == 1 and not m["cur"]["newer_than_supported"]
    assert m["new"]["newer_than_supported"]


def test_quality_guard(spark):
    df = spark.createDataFrame([("You spent a lot", "on food"), ("Rent is 62% of outflow", "$1,200 at Main St")],
                               "headline STRING, detail STRING")
    assert [r["suppressed"] for r in quality_guard(df).collect()] == [True, False]


def test_previous_period_answers_every_start(spark):
    from ledgerlens.sources.store import previous_period

    runs = spark.createDataFrame([(1, "a", "2024-01-01", "2024-01-31"), (1, "b", "2024-02-01", "2024-02-29"), (1, "c", "2024-02-01", "2024-02-29"),
                                  (2, "d", "2024-01-01", "2024-01-31")], "k int, run_id string, s string, e string")
    runs = runs.selectExpr("k", "run_id", "to_timestamp(s) as period_start", "to_timestamp(e) as period_end")
    tx = spark.createDataFrame([(1, "2024-01-05"), (1, "2024-02-05"), (2, "2024-01-05"), (3, "2024-01-05")], "k int, d string").selectExpr("k", "to_timestamp(d) as date")
    cur = spark.createDataFrame([(1, "2024-02-01"), (1, "2024-02-29"), (1, "2024-03-01"), (1, "2024-03-01"), (2, "2024-01-31"), (2, "2024-06-01"), (3, "2024-06-01"),
                                 (1, None)], "k int, d string").selectExpr("k", "to_timestamp(d) as current_start")
    got = sorted((r.k, str(r.current_start)[:10], r.run_id, str(r.date)[:10]) for r in previous_period(tx, runs, cur, ["k"]).collect())
    assert got == [(1, "2024-02-01", "a", "2024-01-05"), (1, "2024-02-29", "a", "2024-01-05"),  # a run that ends at the start is not before it
                   (1, "2024-03-01", "c", "2024-02-05"), (2, "2024-06-01", "d", "2024-01-05")]
    assert previous_period(tx, runs.limit(0), cur, ["k"]).count() == 0


def test_run_ids_differ_by_period(spark):
    from ledgerlens.sources.store import run_rows

    df = spark.createDataFrame([(1, "2024-01-05"), (1, "2024-02-05")], "k int, d string").selectExpr("k", "to_timestamp(d) as date")
    jan, feb = (run_rows(df.where(f"month(date) = {m}"), ["k"]).first().run_id for m in (1, 2))
    assert jan != feb and jan == run_rows(df.where("month(date) = 1"), ["k"]).first().run_id


def test_insights_are_data(spark):
    from ledgerlens.operators.narrative import guard_insights, migrate_narratives, parse_narratives

    docs = [(1, '{"schema_version": 1, "insights": [{"headline": "Big", "detail": "low hum"}, {"headline": "x", "detail": null}, 5]}'),
            (2, '{"insights": "text"}'), (3, '{"schema_version": 2, "insights": []}'), (4, "no json"), (5, None), (6, "{}")]
    df = migrate_narratives(parse_narratives(spark.createDataFrame(docs, "id int, narrative_json string")))
    got = {r.id: r for r in guard_insights(df, phrases=("LOW hum",)).collect()}
    pairs = lambda x: None if x is None else [tuple(i) if i is not None else None for i in x]
    assert pairs(got[1].suppressed_insights) == [("Big", "low hum")]
    assert pairs(got[1].insights) == [("x", None), (None, None)]
    assert pairs(got[2].insights) == [] == pairs(got[3].insights) and pairs(got[6].insights) == []
    assert got[4].valid is False and got[4].insights is not None
