"""Stage audit: row counts and stage metrics via ``DataFrame.observe``.

Metrics are collected as a side effect of the action that runs the plan (no
extra job).  Plans are lazy, so durations belong to actions: ``timed`` wraps
an action and records its wall time.
"""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class AuditLog:
    def __init__(self, run_id: str | None = None):
        self.run_id = run_id
        self.started_at = datetime.now(timezone.utc).isoformat()
        self._stages: list[tuple[str, Observation]] = []
        self._actions: list[tuple[str, str, float]] = []

    def observe(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """Attach row count + named metrics for ``stage`` to ``df``."""
        obs = Observation(stage)
        exprs = [F.count(F.lit(1)).alias("output_rows")] + [e.alias(k) for k, e in metrics.items()]
        self._stages.append((stage, obs))
        return df.observe(obs, *exprs)

    @contextmanager
    def timed(self, action: str):
        start = datetime.now(timezone.utc).isoformat()
        t0 = time.monotonic()
        try:
            yield
        finally:
            self._actions.append((action, start, round((time.monotonic() - t0) * 1000, 2)))

    def events(self, spark: SparkSession) -> DataFrame:
        """(run_id, kind, name, started_at, duration_ms, output_rows, metadata)
        — one row per observed stage or timed action (small, driver-side)."""
        rows = []
        for stage, obs in self._stages:
            m = dict(obs.get)
            n = m.pop("output_rows", None)
            rows.append((self.run_id, "stage", stage, None, None, n, json.dumps(m, default=str, sort_keys=True)))
        for action, start, ms in self._actions:
            rows.append((self.run_id, "action", action, start, ms, None, "{}"))
        return spark.createDataFrame(rows, "run_id STRING, kind STRING, name STRING, started_at STRING, "
                                           "duration_ms DOUBLE, output_rows BIGINT, metadata STRING")
