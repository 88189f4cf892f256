"""A whole analysis run against the store.

period filter -> clean -> categories -> anomalies -> previous period -> report
with drift -> run row, new transactions, merchants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.common import Keys, join_on_keys
from ledgerlens.plans.analyze import analyze
from ledgerlens.plans.materialize import materialize
from ledgerlens.plans.report import analysis_report
from ledgerlens.sources.store import LedgerStore, previous_period, run_rows


def run_analysis(ledger: DataFrame, store: LedgerStore, source_file: str | None = None, save: bool = True,
                 compare: bool = True, drift_threshold: float = 0.20, **options) -> DataFrame:
    """Analyse ``ledger``, compare each key with its previous stored period and
    save the run; returns the written report (keys, report_json).

    ``options`` go to :func:`analyze`.  The scored ledger is written once and
    feeds every part.  Merchants count only rows the store did not have; each
    write leaves out or replaces what an earlier attempt has written, so a
    repeated run adds nothing and one that died half-way is completed by the
    next attempt.  An empty ledger gives an empty report and saves nothing."""
    keys = store.keys
    scored = materialize(analyze(ledger, keys, **options), "run-scored")
    if scored.isEmpty():
        return analysis_report(scored, keys) if keys else analysis_report(scored, keys).limit(0)
    runs, stored = store.read("analysis_runs"), store.read("transactions")
    previous = None
    if compare and runs is not None and stored is not None:
        starts = scored.groupBy(*keys).agg(F.min("date").alias("current_start"))
        previous = previous_period(stored, runs, starts, keys).select(*keys, *[c for c in stored.columns if c not in keys and c not in ("run_id", "load")])
    # Written before the store changes: the report is about what was stored before.
    report = materialize(analysis_report(scored, keys, previous=previous, drift_threshold=drift_threshold), "run-report")
    if save:
        row = materialize(run_rows(scored, keys, source_file=source_file), "run-rows")
        store.save_runs(row)
        # Every stored row names its own key's run, and the load that stored it.
        load = _load_name(row)
        store.save_transactions(_with_run_id(scored, row, keys), F.col("run_id"), load)
        # From the rows that this load has stored, in whichever attempt.
        store.upsert_merchants(store.transactions_of(load, scored), load)
    return report


def _with_run_id(scored: DataFrame, runs: DataFrame, keys: Keys) -> DataFrame:
    """``scored`` with its key's run_id; rows of a null key have a run too."""
    if not keys:
        return join_on_keys(scored, runs.select("run_id"), keys)
    ids = runs.select("run_id", *(F.col(k).alias(f"_ll_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_ll_{k}")) for k in keys]
    return scored.join(ids, same).drop(*(f"_ll_{k}" for k in keys))


def _load_name(runs: DataFrame) -> str:
    """One name for a set of runs, the same in every attempt."""
    n, h = runs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("run_id"))).first()
    return f"runs-{n}-{h & (1 << 64) - 1:016x}"
