"""What the stage that joins scores and ledger holds: finding F3 of round 3."""

from __future__ import annotations

import datetime as dt

from ledgerlens.operators.anomaly import score_anomalies
from ledgerlens.plans import analyze as an


def _ledger(spark, n=60):
    rows = [(i, i % 3 if i % 20 else None, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), -float(i % 7) - 1.0, ["NETFLIX.COM", None, "CAFE 12345"][i % 3])
            for i in range(n)]
    return spark.createDataFrame(rows, "row_id LONG, account_id LONG, date TIMESTAMP, amount DOUBLE, raw_description STRING")


def test_scores_join_limits_of_one_row_per_key(spark):
    """the quantiles' sorts and tables are in no stage of the join with the ledger."""
    e = an.enrich(_ledger(spark), ["account_id"])
    plan = score_anomalies(e, ["account_id"])._jdf.queryExecution().executedPlan().toString()
    assert "_ll_bucket" not in plan and "percentile" not in plan
