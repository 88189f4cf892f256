"""The analysis pipeline as one lazy plan.

ledger -> transaction ids -> clean descriptions -> de-duplicate -> calendar
features -> categories (-> anomaly scores).  Nothing runs until a sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.anomaly import score_anomalies
from ledgerlens.operators.categorize import categorize_keywords
from ledgerlens.operators.clean import deduplicate, normalize_dates, normalize_descriptions
from ledgerlens.operators.common import Keys
from ledgerlens.operators.filters import filter_period
from ledgerlens.sources.ledgers import ledger_text_date
from ledgerlens.sources.parse import with_transaction_id

DEFAULT_KEYS = ("account_id",)


def with_ledger_ids(ledger: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Standard columns for a derived ledger: ``source`` and a transaction id
    whose 'file' is the account (identical lines are numbered per account)."""
    d = ledger.withColumn("date_text", ledger_text_date(F.col("date"))).withColumn("source", F.lit("ledger"))
    order = ["row_id"] if "row_id" in ledger.columns else []
    return with_transaction_id(d, file_cols=list(keys), order_cols=order).drop("date_text")


def clean(ledger: DataFrame, keys: Keys = DEFAULT_KEYS, near_dup_window_days: int = 2,
          with_category: bool = False, period_days: int | None = None, as_of: str | None = None,
          audit=None) -> DataFrame:
    """ids -> clean descriptions -> de-duplicate -> date features.

    Descriptions are cleaned after the id shuffle: the shuffle carries the raw
    text only, and the rules run on its partitions however few files the scan
    has.  The category is a pure function of the clean description: it is
    computed for the rows that stay and no shuffle carries it."""
    obs = (lambda df, stage: audit.observe(df, stage)) if audit is not None else (lambda df, stage: df)
    if period_days is not None:
        # The period filter comes first, as in the source pipeline; it is a
        # plain predicate on the scan's date column, so it is pushed down.
        ledger = filter_period(ledger, period_days, as_of)
    d = obs(ledger, "parse")
    d = with_ledger_ids(d, keys)
    d = obs(normalize_descriptions(d, src="raw_description"), "normalize_descriptions")
    # ids were numbered per account just above: no two rows of an account
    # share one, so the exact pass is skipped (it stays for unioned loads).
    d = obs(deduplicate(d, near_dup_window_days, keys, ids_unique=True), "deduplicate")
    if with_category:
        d = categorize_keywords(d)
    return obs(normalize_dates(d), "normalize_dates")


def enrich(ledger: DataFrame, keys: Keys = DEFAULT_KEYS, near_dup_window_days: int = 2,
           period_days: int | None = None, as_of: str | None = None, audit=None) -> DataFrame:
    """Cleaned, de-duplicated, dated and keyword-categorised ledger."""
    return clean(ledger, keys, near_dup_window_days, with_category=True, period_days=period_days,
                 as_of=as_of, audit=audit)


def analyze(ledger: DataFrame, keys: Keys = DEFAULT_KEYS, near_dup_window_days: int = 2,
            method: str = "zscore", contamination: float = 0.05, top_n: int = 3,
            period_days: int | None = None, as_of: str | None = None, audit=None) -> DataFrame:
    """Enriched ledger with anomaly columns (the frame every report reads)."""
    e = enrich(ledger, keys, near_dup_window_days, period_days, as_of, audit)
    s = score_anomalies(e, keys, method=method, contamination=contamination, top_n=top_n)
    if audit is not None:
        s = audit.observe(s, "fit_predict", anomalies_found=F.sum(F.col("is_anomaly").cast("long")))
    return s
