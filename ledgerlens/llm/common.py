"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.plans.materialize import materialize
from ledgerlens.session import configure, ensure_checkpoint_dir

__all__ = ["broadcast_if_small", "connected_components", "configure", "ensure_checkpoint_dir", "fresh_name", "materialize",
           "release_memory", "star_forest", "stretch", "table", "with_fields"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when ``df`` (a written table or a small aggregate) has
    at most ``max_rows`` rows; beyond that Spark joins by shuffle.  Either way
    the result is the same."""
    return F.broadcast(df) if df.count() <= max_rows else df


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with further (name, type) fields."""
    extra = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    return T.StructType(list(df.schema.fields) + list(extra.fields))


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` begins with it."""
    while any(c.lower().startswith(base.lower()) for c in df.columns):
        base += "_"
    return base


def stretch(spark: SparkSession) -> int:
    """The cluster's own number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable by edges.

    Alternating large-star and small-star rounds (each two aggregations and
    joins, written to the shared folder) until the edge set no longer changes;
    nodes without an edge do not appear.  Self-loops and repeated edges are
    allowed; nulls are not.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        # Large star: every larger neighbour of u points at the smallest of u's neighbourhood.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of u and u itself point at the smallest.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
             .union(least.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(e, "cc")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def release_memory() -> None:
    """Give memory that a worker's task no longer uses back to the machine, so
    idle workers hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def star_forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A star forest with the components of the links (a, b)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, new[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    star = label != np.arange(len(nodes))
    return list(zip(nodes[star].tolist(), nodes[label[star]].tolist()))
