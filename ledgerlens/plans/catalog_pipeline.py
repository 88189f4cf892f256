"""Pipeline-level queries (report)."""

from __future__ import annotations

from ledgerlens.operators.anomaly import score_anomalies
from ledgerlens.plans.catalog import KEYS, enriched_events, register
from ledgerlens.plans.materialize import materialize
from ledgerlens.plans.report import analysis_report


@register("analysis_report")
def q_report(spark, d):
    scored = materialize(score_anomalies(enriched_events(spark, d, once=True), KEYS), "scored-events")
    return analysis_report(scored, KEYS)
