"""Model-based queries without a SQL oracle (rows-only check)."""

from __future__ import annotations

from ledgerlens.operators import anomaly as an
from ledgerlens.plans.catalog import KEYS, enriched_events, register


@register("anomaly_iforest")
def q_iforest(spark, d):
    s = an.score_anomalies(enriched_events(spark, d, once=True), KEYS, method="iforest")
    return s.select("account_id", "transaction_id", "anomaly_score", "is_anomaly", "anomaly_reason")


from ledgerlens.plans import catalog_pipeline  # noqa: E402,F401
