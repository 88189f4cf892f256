"""Incremental ledger ingestion with Structured Streaming.

New standardised transaction files (Parquet) landing in a folder are read as
a stream; each micro-batch is enriched and written to the store with the
insert-if-absent (transactions) and additive (merchants) merges.  Each epoch of
a stream is one named load, so an epoch that is replayed after a failure
replaces what it has written.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.categorize import categorize_keywords
from ledgerlens.operators.clean import deduplicate, normalize_dates, normalize_descriptions
from ledgerlens.plans.materialize import materialize, scratch
from ledgerlens.sources.store import LedgerStore

STANDARD_DDL = ("date TIMESTAMP, description STRING, amount DOUBLE, raw_description STRING, source STRING, "
                "transaction_id STRING")


def process_batch(batch: DataFrame, epoch: int, store: LedgerStore, near_dup_window_days: int = 2,
                  stream: str = "stream") -> None:
    """Enrich one micro-batch and add it to the store as the load
    ``<stream>-<epoch>``; a replayed epoch is the same load and adds nothing."""
    load = f"{stream}-{epoch}"
    with scratch(store.spark):
        e = materialize(categorize_keywords(normalize_dates(deduplicate(
            normalize_descriptions(batch, src="raw_description"), near_dup_window_days, store.keys))), "epoch")
        store.save_transactions(e, load)
        store.upsert_merchants(e, load)


def start_ingest(spark: SparkSession, landing: str, store_root: str, checkpoint: str,
                 keys=(), ddl: str = STANDARD_DDL, available_now: bool = True) -> StreamingQuery:
    store = LedgerStore(spark, store_root, keys)
    # Named by its checkpoint, so a restarted stream keeps its name and two streams into one store differ.
    name = "stream-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:8]
    key_ddl = "".join(f"{k} BIGINT, " for k in keys)
    stream = spark.readStream.schema(key_ddl + ddl).parquet(landing)
    writer = stream.writeStream.foreachBatch(lambda df, epoch: process_batch(df, epoch, store, stream=name)) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
