"""Period and sign filters (pushed down to the scan by Catalyst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.rules import PERIOD_MAX_DAYS


def filter_period(df: DataFrame, days: int, as_of: str) -> DataFrame:
    """Rows with ``date >= as_of - days`` (NULL dates drop out).  ``as_of`` is
    explicit so a plan is reproducible."""
    if not 1 <= days <= PERIOD_MAX_DAYS:
        raise ValueError(f"period must be between 1 and {PERIOD_MAX_DAYS} days, got {days}")
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    return df.where(F.col("date") >= cutoff)


def expenses(df: DataFrame) -> DataFrame:
    return df.where(F.col("amount") < 0)


def income(df: DataFrame) -> DataFrame:
    return df.where(F.col("amount") > 0)
