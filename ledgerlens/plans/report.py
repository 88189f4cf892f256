"""Per-account analysis report as one JSON row: run id, statistics with their
facets, patterns, anomalies and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.anomaly import extract_anomalies
from ledgerlens.operators.common import Keys, join_on_keys
from ledgerlens.operators.drift import category_drift, drift_hints, spending_velocity
from ledgerlens.operators.patterns import detect_patterns
from ledgerlens.operators.stats import compute_stats, stats_facets
from ledgerlens.sources.store import run_rows


def _list(df: DataFrame, keys: Keys, out: str, *cols: str) -> DataFrame:
    """Rows of a key as one sorted array."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(out))


def analysis_report(scored: DataFrame, keys: Keys = ("account_id",), anomaly_limit: int = 5,
                    previous: DataFrame | None = None, drift_threshold: float = 0.20) -> DataFrame:
    """(keys..., report_json).  ``scored`` is the enriched ledger with anomaly
    columns; ``previous`` the transactions of each key's previous period.

    Lists hold findings, not rows of the ledger: patterns (bounded by merchants
    and categories), categories, weeks, the first 20 merchants, the top
    ``anomaly_limit`` anomalies, changed categories and hints.  drift is null
    without ``previous`` and for keys that have no row in it."""
    keys = list(keys)
    stats = compute_stats(scored, keys)
    parts = [
        run_rows(scored, keys).select(*keys, "run_id"),
        _list(stats_facets(scored, keys), keys, "facets", "facet", "rank", "name", "total", "count", "avg"),
        _list(detect_patterns(scored, keys), keys, "patterns", "severity_rank", "detector_order", "type", "headline", "severity", "data"),
        _list(extract_anomalies(scored, keys, anomaly_limit), keys, "anomalies", "rank", "date", "description", "amount", "score", "reason"),
    ]
    drift = F.lit(None).cast("string")
    if previous is not None:
        known = previous.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ll_before"))
        parts += [
            known,
            _list(category_drift(scored, previous, keys, drift_threshold), keys, "_ll_categories",
                  "category", "direction", "current", "previous", "change_pct", "hint"),
            _list(drift_hints(scored, previous, keys), keys, "_ll_hints", "kind", "hint"),
            spending_velocity(scored, keys).select(*keys, "velocity_trend"),
        ]
        found = F.struct(F.coalesce("_ll_categories", F.array()).alias("categories"),
                         F.coalesce("_ll_hints", F.array()).alias("hints"), "velocity_trend")
        drift = F.when(F.col("_ll_before") > 0, found)
    r = stats
    for p in parts:
        r = join_on_keys(r, p, keys, "left")
    stat_cols = [c for c in stats.columns if c not in keys]
    body = F.struct("run_id", F.struct(*stat_cols, F.coalesce("facets", F.array()).alias("facets")).alias("stats"),
                    F.coalesce("patterns", F.array()).alias("patterns"),
                    F.coalesce("anomalies", F.array()).alias("anomalies"), drift.alias("drift"))
    return r.select(*keys, F.to_json(body).alias("report_json"))


def write_report(report: DataFrame, path: str, keys: Keys = ("account_id",)) -> None:
    """JSON lines, one document per account."""
    report.write.mode("overwrite").json(path)
