"""The registered table counts: finding F5 of round 3."""

from __future__ import annotations

import datetime as dt

from ledgerlens.plans.analyze import enrich
from ledgerlens.plans.catalog import queries
from ledgerlens.plans.materialize import recorded
from ledgerlens.sources.ledgers import ledger_orders


def test_table_counts_write_the_ledger_once(spark, tmp_path):
    """the transactions counted are those that make the merchants."""
    rows = [(i, i, "PFO"[i % 3], 20000.0 * (1 + i % 5), dt.datetime(1996 + i % 4, 1, 1 + i % 28), "1-URGENT") for i in range(80)]
    spark.createDataFrame(rows, "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING"
                          ).write.parquet(str(tmp_path / "orders.parquet"))
    paths = []
    with recorded(paths):
        got = {r["table_name"]: r["n"] for r in queries()["table_counts"](spark, str(tmp_path)).collect()}
    assert len([p for p in paths if "enriched-orders" in p]) == 1
    assert got["transactions"] == enrich(ledger_orders(spark, str(tmp_path)), ["account_id"]).count() and got["merchants"] > 0
