"""Ledgers derived from the driver's Parquet tables.

The driver tables hold no bank data, so two transaction ledgers are derived
from them with fixed rules (events -> card activity with time of day,
orders -> date-only statement lines).  Both are plain projections of one scan:
no shuffle, and every column the rule does not need is pruned at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(key: Column, options: list[str]) -> Column:
    """options[key % len(options)] as a CASE expression."""
    n = len(options)
    expr = None
    for i, text in enumerate(options):
        cond = (key % n) == i
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr


def _money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("double")


# FIXED VALUES — merchant strings of the two derived ledgers.
EVENT_ERROR_MERCHANTS = ["CITY HALL FEE 20241", "WATER UTILITY SVC", "SQ VENDOR PURCHASE"]
EVENT_CLICK_MERCHANTS = ["STARBUCKS #04892", "UBER* EATS 3948201", "CHIPOTLE MEXICAN GRI", "DOORDASH DASHPASS"]
EVENT_VIEW_MERCHANTS = ["NETFLIX.COM", "SPOTIFY USA", "HULU SUBSCRIPTION", "ADOBE CREATIVE CLOUD",
                        "OPENAI *CHATGPT", "DROPBOX PLAN", "PEACOCK TV"]
EVENT_OTHER_MERCHANTS = ["AMAZON.COM 4827XPQR", "TARGET 00012849", "TRADER JOE S #142",
                         "CVS PHARMACY 2841", "WALMART SUPERCENTER"]
PAYROLL = "DIRECT DEPOSIT PAYROLL"


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, account_id, date, amount, raw_description) from ``events``."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    et = F.col("event_type")
    amount = F.when(et == "signup", F.floor("value").cast("long") * 10 + 100).otherwise(
        -(F.floor(F.col("value") / 20.0).cast("long") * 20 + F.lit(4.99).cast("decimal(3,2)")))
    raw = (F.when(et == "signup", F.lit(PAYROLL))
           .when(et == "error", _pick(eid, EVENT_ERROR_MERCHANTS))
           .when(et == "click", _pick(eid, EVENT_CLICK_MERCHANTS))
           .when(et == "view", _pick(eid, EVENT_VIEW_MERCHANTS))
           .otherwise(_pick(eid, EVENT_OTHER_MERCHANTS)))
    return ev.select(
        eid.cast("long").alias("row_id"),
        F.col("user_id").cast("long").alias("account_id"),
        F.col("ts").cast("timestamp").alias("date"),
        _money(amount).alias("amount"),
        raw.alias("raw_description"),
    )


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, account_id, date, amount, raw_description) from ``orders``."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    prio = F.col("o_orderpriority")
    amount = F.when(status == "P", F.floor(F.col("o_totalprice") / 1000.0).cast("long") * 10 + 500).otherwise(
        -(F.floor(F.col("o_totalprice") / 20000.0).cast("long") * 10 + F.lit(9.99).cast("decimal(3,2)")))
    raw = (F.when(status == "P", F.lit(PAYROLL))
           .when(prio == "1-URGENT", F.lit("UBER* TRIP 6748291"))
           .when(prio == "2-HIGH", F.lit("PLANET FITNESS"))
           .when(prio == "3-MEDIUM", F.lit("NETFLIX.COM"))
           .when(prio == "5-LOW", F.lit("COSTCO WHOLESALE"))
           .otherwise(F.lit("RENT PAYMENT ACH")))
    return o.select(
        F.col("o_orderkey").cast("long").alias("row_id"),
        (F.col("o_custkey") % 150).cast("long").alias("account_id"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        _money(amount).alias("amount"),
        raw.alias("raw_description"),
    )


def ledger_text_date(date: Column) -> Column:
    """Export text of a ledger timestamp (what a statement file would show)."""
    return F.date_format(date, "yyyy-MM-dd HH:mm:ss")
