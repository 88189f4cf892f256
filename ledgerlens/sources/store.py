"""Persistent tables on Parquet: transactions, analysis runs, merchants.

The table logic is pure DataFrame operators (anti join, additive full-outer
merge, as-of lookup); :class:`LedgerStore` only adds reads and writes: appends
and replaced partitions, never a whole table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.money import MONEY
from ledgerlens.functions.text import normalized_name
from ledgerlens.operators.common import Keys
from ledgerlens.plans.materialize import materialize, scratch

TRANSACTION_TYPES = {"transaction_id": "string", "date": "timestamp", "description": "string", "raw_description": "string",
                     "amount": "double", "source": "string", "category": "string", "category_confidence": "double",
                     "cluster_id": "int", "anomaly_score": "double", "is_anomaly": "boolean", "is_weekend": "boolean",
                     "day_of_week": "string", "run_id": "string"}
TRANSACTION_COLUMNS = tuple(TRANSACTION_TYPES)
READ_COLUMNS = ("transaction_id", "date", "description", "raw_description", "amount", "source",
                "category", "category_confidence", "anomaly_score", "is_anomaly")


# ---------------------------------------------------------------------------
# Pure table operators
# ---------------------------------------------------------------------------

def insert_new(batch: DataFrame, existing: DataFrame, keys: Keys = ()) -> DataFrame:
    """Rows of ``batch`` whose (keys, transaction_id) is not stored yet; null
    keys are equal."""
    names = [*keys, "transaction_id"]
    known = existing.select(*(F.col(c).alias(f"_ll_{c}") for c in names))
    return batch.join(known, [F.col(c).eqNullSafe(F.col(f"_ll_{c}")) for c in names], "left_anti")


def to_transaction_rows(df: DataFrame, run_id, keys: Keys = ()) -> DataFrame:
    """Project an enriched frame onto the stored transaction columns."""
    cols = []
    for c in TRANSACTION_COLUMNS:
        if c == "run_id":
            cols.append((run_id if not isinstance(run_id, str) else F.lit(run_id)).alias("run_id"))
        elif c in df.columns:
            cols.append(F.col(c))
        elif c == "is_anomaly":
            cols.append(F.lit(False).alias(c))
        else:
            cols.append(F.lit(None).alias(c))
    return df.select(*keys, *cols)


def in_months_of(tx: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the month-partitioned ``tx`` between the first and the last month
    of ``batch`` (and the undated ones, if it has any): two numbers and a flag
    come to the driver, and the scan reads those partitions only."""
    month = F.year("date") * 100 + F.month("date")
    lo, hi, undated = batch.agg(F.min(month), F.max(month), F.count_if(F.col("date").isNull()) > 0).first()
    at = F.col("year") * 100 + F.col("month")
    inside = F.lit(False) if lo is None else at.between(lo, hi)
    return tx.where(inside | at.isNull() if undated else inside)


def read_range(tx: DataFrame, start=None, end=None) -> DataFrame:
    """Stored transactions with start <= date <= end (either bound optional).

    The date predicates are pushed into the Parquet scan; when the table is
    partitioned by year/month (as the store writes it) the same bounds are
    also stated on the partition columns, so whole months are pruned."""
    out = tx
    ym = ("year" in tx.columns and "month" in tx.columns)
    if start is not None:
        ts = F.to_timestamp(F.lit(start))
        out = out.where(F.col("date") >= ts)
        if ym:
            out = out.where(F.col("year") * 100 + F.col("month") >= F.year(ts) * 100 + F.month(ts))
    if end is not None:
        ts = F.to_timestamp(F.lit(end))
        out = out.where(F.col("date") <= ts)
        if ym:
            out = out.where(F.col("year") * 100 + F.col("month") <= F.year(ts) * 100 + F.month(ts))
    return out


def run_rows(df: DataFrame, keys: Keys = (), period=None, source_file: str | None = None,
             narrative: DataFrame | None = None) -> DataFrame:
    """One analysis-run row per key: period bounds and row count.

    ``run_id`` is the first 12 hex digits of a hash of the keys and the period
    (its label, or else its first and last date), so a re-run of the same job
    yields the same id and another period another one (random ids would change
    on a task retry)."""
    grp = [*keys] + ([period.alias("_ll_period")] if period is not None else [])
    g = df.groupBy(*grp).agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"),
                             F.count(F.lit(1)).alias("transaction_count"))
    span = ["_ll_period"] if period is not None else ["period_start", "period_end"]
    ident = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*keys, *span]]
    g = g.withColumn("run_id", F.substring(F.sha2(F.concat_ws("|", *ident), 256), 1, 12))
    g = (g.withColumn("created_at", F.col("period_end") + F.expr("INTERVAL 1 DAY"))
          .withColumn("source_file", F.lit(source_file).cast("string")))
    if narrative is not None:
        g = g.join(narrative, "run_id", "left")
    elif "narrative_json" not in g.columns:
        g = g.withColumn("narrative_json", F.lit(None).cast("string"))
    return g.drop("_ll_period")


def previous_period(tx: DataFrame, runs: DataFrame, current: DataFrame, keys: Keys = ()) -> DataFrame:
    """Transactions of the latest run that ended strictly before a period's
    start (as-of join), selected by date range, with ``current_start``.

    ``current`` holds (keys, current_start); every start of a key is answered
    for itself, repeated ones once.  Runs that end together rank by run_id.
    Runs and starts are laid in one order of time per key, a start before the
    runs that end at its moment, and each start takes the last run before it
    (a window over runs and starts only).  The range step is an equi-join on
    keys plus a BETWEEN filter."""
    from ledgerlens.operators.common import join_on_keys
    run = F.struct("run_id", "period_start", "period_end")
    ends = runs.where(F.col("period_end").isNotNull()).select(*keys, F.col("period_end").alias("_ll_at"), F.lit(1).alias("_ll_kind"), "run_id",
                                                              run.alias("_ll_r"), F.lit(None).cast("timestamp").alias("current_start"))
    starts = (current.where(F.col("current_start").isNotNull()).select(*keys, "current_start").distinct()
              .select(*keys, F.col("current_start").alias("_ll_at"), F.lit(0).alias("_ll_kind"), F.lit(None).cast("string").alias("run_id"),
                      F.lit(None).cast(ends.schema["_ll_r"].dataType).alias("_ll_r"), "current_start"))
    before = F.last("_ll_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_ll_at", "_ll_kind", "run_id"))
    latest = (ends.unionByName(starts).withColumn("_ll_r", before).where((F.col("_ll_kind") == 0) & F.col("_ll_r").isNotNull())
              .select(*keys, "current_start", "_ll_r.*"))
    j = join_on_keys(tx, latest, keys)
    return j.where(F.col("date").between(F.col("period_start"), F.col("period_end")))


def merchant_delta(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Expense summary per merchant of one batch: total, count, first/last seen
    and the category of its earliest categorised row.  An amount of 1e20 or
    more counts, but no money column holds it, so it is not in the total."""
    e = df.where(F.col("amount") < 0).withColumn("normalized_name", normalized_name(F.col("description")))
    has_cat = "category" in df.columns
    aggs = [F.min("description").alias("name"),
            F.try_sum(F.abs("amount").try_cast(MONEY)).alias("total_spent"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.min("date").alias("first_seen"), F.max("date").alias("last_seen")]
    if has_cat:
        aggs.append(F.min_by(F.col("category"), F.when(F.col("category").isNotNull(),
                                                         F.struct("date", "transaction_id"))).alias("category"))
    g = e.groupBy(*keys, "normalized_name").agg(*aggs)
    if not has_cat:
        g = g.withColumn("category", F.lit(None).cast("string"))
    return g.select(*keys, "name", "normalized_name", "category", "first_seen", "last_seen",
                    "total_spent", "transaction_count")


def merge_merchants(base: DataFrame, delta: DataFrame, keys: Keys = ()) -> DataFrame:
    """Additive upsert on (keys, normalized_name): totals and counts add,
    last_seen takes the batch value, name/category/first_seen stay from the
    first insert.  Re-applying a batch doubles its totals (as the source)."""
    on = [*keys, "normalized_name"]
    b = base.select(*on, *[F.col(c).alias("b_" + c) for c in
                          ("name", "category", "first_seen", "last_seen", "total_spent", "transaction_count")],
                    F.lit(True).alias("_ll_b"))
    d = delta.select(*on, *[F.col(c).alias("d_" + c) for c in
                           ("name", "category", "first_seen", "last_seen", "total_spent", "transaction_count")],
                     F.lit(True).alias("_ll_d"))
    j = b.join(d, on, "full_outer")
    inb = F.coalesce("_ll_b", F.lit(False))
    ind = F.coalesce("_ll_d", F.lit(False))
    zero = F.lit(0).cast(MONEY)
    return j.select(
        *on,
        F.when(inb, F.col("b_name")).otherwise(F.col("d_name")).alias("name"),
        F.when(inb, F.col("b_category")).otherwise(F.col("d_category")).alias("category"),
        F.when(inb, F.col("b_first_seen")).otherwise(F.col("d_first_seen")).alias("first_seen"),
        F.when(ind, F.col("d_last_seen")).otherwise(F.col("b_last_seen")).alias("last_seen"),
        (F.coalesce(F.col("b_total_spent").cast(MONEY), zero)
         + F.coalesce(F.col("d_total_spent").cast(MONEY), zero)).cast(MONEY).alias("total_spent"),
        (F.coalesce("b_transaction_count", F.lit(0)) + F.coalesce("d_transaction_count", F.lit(0)))
        .cast("long").alias("transaction_count"),
    )


def fold_merchants(deltas: DataFrame, keys: Keys = ()) -> DataFrame:
    """Merchants from the batch summaries of all loads, as :func:`merge_merchants`
    applied in the order of loads gives them: totals and counts add, last_seen
    is the last load's, name, category and first_seen are the first one's."""
    at = F.struct("loaded_at", "load")
    return deltas.groupBy(*keys, "normalized_name").agg(
        *(F.min_by(c, at).alias(c) for c in ("name", "category", "first_seen")), F.max_by("last_seen", at).alias("last_seen"),
        F.try_sum("total_spent").try_cast(MONEY).alias("total_spent"), F.sum("transaction_count").alias("transaction_count"))


def top_merchants_table(merchants: DataFrame, keys: Keys = (), limit: int = 50) -> DataFrame:
    """Merchants by lifetime spend, ``limit`` per key (ties: name)."""
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    order = [F.col("total_spent").desc(), F.col("normalized_name")]
    if not keys:
        return merchants.orderBy(*order).limit(limit)
    # One row per merchant: a per-key window over merchant rows.
    w = Window.partitionBy(*keys).orderBy(*order)
    return merchants.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


NARRATIVE_SCHEMA = ("STRUCT<schema_version: INT, tldr: STRING, "
                    "insights: ARRAY<STRUCT<headline: STRING, detail: STRING>>, "
                    "next_steps: STRING, generated_at: STRING>")


def history(runs: DataFrame) -> DataFrame:
    """Runs newest first with the narrative's tldr pulled out."""
    return (runs.select("run_id", "created_at", "period_start", "period_end", "source_file",
                        "transaction_count", F.get_json_object("narrative_json", "$.tldr").alias("tldr"))
            .orderBy(F.col("created_at").desc(), F.col("run_id")))


def run_detail(runs: DataFrame, run_id: str) -> DataFrame:
    """One run with its parsed narrative (pushdown on run_id)."""
    from ledgerlens.operators.narrative import migrate_narratives, parse_narratives
    r = runs.where(F.col("run_id") == run_id)
    return migrate_narratives(parse_narratives(r, "narrative_json"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) for each table, as one union of global counts."""
    out = None
    for name, df in tables.items():
        c = df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


# ---------------------------------------------------------------------------
# Parquet-backed store
# ---------------------------------------------------------------------------

class LedgerStore:
    """Plain Parquet tables under ``root`` (a folder that driver and executors
    share), written by Spark alone.

    * ``transactions``: appended, partitioned by year and month.  A batch is
      compared with the months it touches only: an id holds the date, so equal
      ids lie in one month.
    * ``analysis_runs``: appended, one row per run_id.
    * ``merchants``: one partition of batch summaries per load, folded when the
      table is read.  A load that is written again replaces its own partition.

    A repeated or resumed save therefore adds nothing; no table is rewritten.
    """

    TABLES = ("transactions", "analysis_runs", "merchants")

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ()):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _stored(self, table: str) -> DataFrame | None:
        """The table's rows as written, None before the first write."""
        try:
            return self.spark.read.parquet(self._path(table))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def read(self, table: str) -> DataFrame | None:
        rows = self._stored(table)
        return fold_merchants(rows, self.keys) if rows is not None and table == "merchants" else rows

    # -- transactions -----------------------------------------------------
    def save_transactions(self, df: DataFrame, run_id: str | Column, load: str | None = None) -> int:
        """Append rows whose id is new, one per id, marked with the name of the
        ``load``; returns the number appended."""
        rows = to_transaction_rows(df, run_id, self.keys)
        rows = rows.select(*self.keys, *(F.col(c).cast(t) for c, t in TRANSACTION_TYPES.items()))
        with scratch(self.spark):
            # Written first: the bounds, the count and the append must see the same rows.
            rows = materialize(rows.dropDuplicates([*self.keys, "transaction_id"]), "batch")
            existing = self._stored("transactions")
            if existing is not None:
                rows = materialize(insert_new(rows, in_months_of(existing, rows), self.keys), "new")
            n = rows.count()
            if n:
                (rows.withColumn("load", F.lit(load).cast("string"))
                 .withColumn("year", F.year("date")).withColumn("month", F.month("date"))
                 .write.mode("append").partitionBy("year", "month").parquet(self._path("transactions")))
        return n

    def get_transactions(self, start=None, end=None) -> DataFrame:
        tx = self.read("transactions")
        if tx is None:
            return self.spark.createDataFrame([], "transaction_id STRING, date TIMESTAMP")
        return read_range(tx, start, end).select(*self.keys, *READ_COLUMNS)

    def transactions_of(self, load: str, batch: DataFrame) -> DataFrame:
        """Rows that the named load has stored, in the months of ``batch``."""
        return in_months_of(self.read("transactions"), batch).where(F.col("load") == load)

    # -- runs -------------------------------------------------------------
    def save_runs(self, runs: DataFrame) -> int:
        """Append runs whose run_id is not stored yet; returns their number."""
        existing = self._stored("analysis_runs")
        new = runs.dropDuplicates(["run_id"])
        if existing is not None:
            new = new.join(existing.select("run_id"), "run_id", "left_anti").select(*runs.columns)
        with scratch(self.spark):
            new = materialize(new, "runs")
            n = new.count()
            if n:
                new.write.mode("append").parquet(self._path("analysis_runs"))
        return n

    def get_previous_period(self, current: DataFrame) -> DataFrame:
        return previous_period(self.read("transactions"), self.read("analysis_runs"), current, self.keys)

    def get_analysis_history(self) -> DataFrame:
        return history(self.read("analysis_runs"))

    def get_analysis_run(self, run_id: str) -> DataFrame:
        return run_detail(self.read("analysis_runs"), run_id)

    # -- merchants --------------------------------------------------------
    def upsert_merchants(self, df: DataFrame, load: str | None = None) -> None:
        """Add a batch to the merchants.  ``load`` names the batch: the same
        name again replaces what it added before and keeps its place in the
        order of loads.  Without a name every call adds."""
        load = f"load-{load or uuid.uuid4().hex}"  # never read back as a number
        stored = self._stored("merchants")
        first = None if stored is None else stored.where(F.col("load") == load).agg(F.min("loaded_at")).first()[0]
        delta = (merchant_delta(df, self.keys)
                 .withColumn("loaded_at", F.current_timestamp() if first is None else F.lit(first))
                 .withColumn("load", F.lit(load)))
        # Only the partitions in the batch, this load's, are replaced.
        (delta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load")
         .parquet(self._path("merchants")))

    def get_merchants(self, limit: int = 50) -> DataFrame:
        merchants = self.read("merchants")
        if merchants is None:
            return self.spark.createDataFrame([], f"normalized_name STRING, name STRING, total_spent {MONEY}, transaction_count BIGINT")
        return top_merchants_table(merchants, self.keys, limit)

    def db_stats(self) -> DataFrame:
        tables = {t: self.read(t) for t in self.TABLES}
        present = {k: v for k, v in tables.items() if v is not None}
        empty = [t for t, v in tables.items() if v is None]
        out = table_counts(present) if present else None
        if empty:
            z = self.spark.createDataFrame([(t, 0) for t in empty], "table_name STRING, n BIGINT")
            out = z if out is None else out.unionByName(z)
        return out


def narrative_json(tldr, insights, next_steps, version) -> str:
    """Serialise a narrative the way the runs table stores it (tests/helpers)."""
    return json.dumps({"schema_version": version, "tldr": tldr, "insights": insights, "next_steps": next_steps})
