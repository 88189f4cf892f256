"""Write an intermediate result once and read it back.

Used where one enriched ledger feeds several facets (stats, detectors,
anomalies, drift): the plan is computed once instead of once per facet, and
the lineage is cut.  Tables go to the shared checkpoint folder the cluster
names (``spark.checkpoint.dir``), never to a machine-local folder, so a lost
executor does not lose them.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import ensure_checkpoint_dir

_state = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_state, "scopes"):
        _state.scopes = []
    return _state.scopes


def materialize(df: DataFrame, name: str = "stage", keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.  Inside
    :func:`scratch` the table is deleted with the scope; ``keep`` hands it to
    the scope around that one."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/ledgerlens-{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(path)
    scopes = _scopes()[:-1] if keep else _scopes()
    if scopes:
        scopes[-1].append(path)
    return spark.read.parquet(path)


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Add the paths of the tables written inside to ``paths``."""
    _scopes().append(paths)
    try:
        yield
    finally:
        _scopes().pop()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside when the block ends; what is read from
    them must be written by then."""
    paths: list[str] = []
    with recorded(paths):
        try:
            yield
        finally:
            drop_tables(spark, paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
