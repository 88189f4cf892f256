"""A whole run: previous period, drift, report, store; hints and validation."""

from __future__ import annotations

import json
import tempfile
from datetime import datetime

from ledgerlens.operators.drift import drift_hints
from ledgerlens.plans.run import run_analysis
from ledgerlens.sources.parse import STANDARD_COLUMNS, validate
from ledgerlens.sources.store import LedgerStore

LEDGER = "row_id BIGINT, account_id BIGINT, date TIMESTAMP, amount DOUBLE, raw_description STRING"


def month(m, names, account=1):
    return [(100 * m + i, account, datetime(2026, m, 2 + 3 * i), -10.0 * (i + m), n) for i, n in enumerate(names)]


def tables(store):
    tx, runs, m = (store.read(t) for t in LedgerStore.TABLES)
    return tx.count(), runs.count(), {(r.account_id, r.normalized_name): r.transaction_count for r in m.collect()}


def test_run_compares_and_repeats_harmlessly(spark):
    store = LedgerStore(spark, tempfile.mkdtemp(prefix="ll-run-"), ["account_id"])
    jan = spark.createDataFrame(month(1, ["NETFLIX.COM", "STARBUCKS", "SHELL OIL"]) + month(1, ["STARBUCKS"], 2), LEDGER)
    feb = spark.createDataFrame(month(2, ["SPOTIFY", "STARBUCKS", "WHOLE FOODS"]) + month(2, ["STARBUCKS"], 3), LEDGER)
    first = {r.account_id: json.loads(r.report_json) for r in run_analysis(jan, store).collect()}
    assert set(first) == {1, 2} and all("drift" not in r or r["drift"] is None for r in first.values())
    assert {f["facet"] for f in first[1]["stats"]["facets"]} == {"category", "week", "merchant"}
    second = {r.account_id: json.loads(r.report_json) for r in run_analysis(feb, store).collect()}
    assert set(second) == {1, 3} and "drift" not in second[3]  # a new account has no previous period
    assert second[1]["run_id"] != first[1]["run_id"]
    hints = [h["hint"] for h in second[1]["drift"]["hints"]]
    assert any(h.startswith("New merchants this period: ") for h in hints)
    assert any(h.startswith("New subscriptions: ") for h in hints) and any(h.startswith("Cancelled subscriptions: ") for h in hints)
    before = tables(store)
    assert before[:2] == (8, 4)
    run_analysis(feb, store)
    assert tables(store) == before
    assert run_analysis(feb.limit(0), store).count() == 0 and tables(store) == before


def test_hints_name_five_merchants(spark):
    rows = [(i % 2, f"m{i:02d}" if i else None, "other") for i in range(20)]
    cur = spark.createDataFrame(rows, "k int, description string, category string")
    got = drift_hints(cur, cur.limit(0), ["k"]).collect()
    assert {r.k: r.hint for r in got} == {0: "New merchants this period: m02, m04, m06, m08, m10", 1: "New merchants this period: m01, m03, m05, m07, m09"}
    assert drift_hints(cur.drop("category"), cur.drop("category")).count() == 0


def test_validate(spark):
    df = spark.createDataFrame([("x",) * len(STANDARD_COLUMNS)], ", ".join(f"{c} string" for c in STANDARD_COLUMNS))
    assert validate(df) and not validate(df.limit(0)) and not validate(df.drop("amount"))
