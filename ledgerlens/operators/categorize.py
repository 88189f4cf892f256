"""Category assignment: keyword vocabulary, seed centroids, nearest centroid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.rules import SEED_VOCAB
from ledgerlens.functions.text import keyword_category, keyword_confidence
from ledgerlens.operators.common import join_on_keys


def categorize_keywords(df: DataFrame, vocab=SEED_VOCAB, src: str = "description") -> DataFrame:
    """category / category_confidence / cluster_id from the keyword vocabulary."""
    cat = keyword_category(F.col(src), vocab)
    return (df.withColumn("category", cat)
              .withColumn("category_confidence", keyword_confidence("category"))
              .withColumn("cluster_id", F.lit(-1)))


def seed_centroids(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Element-wise mean vector per label: (label, dim, centroid ARRAY<DOUBLE>).

    Exploded to (label, position) so the average is a plain partial
    aggregate; the per-label array is reassembled from ``dim`` values only.
    """
    exploded = df.select(F.col(label).alias("label"), F.posexplode(vec).alias("pos", "x"))
    means = exploded.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return (means.groupBy("label")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("_ll_m"))
            .select("label", F.size("_ll_m").alias("dim"),
                    F.transform("_ll_m", lambda s: s["mean"]).alias("centroid")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def categorize_embeddings(df: DataFrame, centroids: DataFrame | Sequence[tuple[object, Sequence[float]]],
                          vec: str = "embedding", label_type: str = "int") -> DataFrame:
    """Nearest centroid by cosine ``dot/(|a||b|+1e-9)``; ties -> first centroid
    in label order.  Adds ``category`` and ``category_confidence``; without
    centroids both are NULL.

    The centroids travel as ONE row holding an array of (label, vector, norm),
    attached by a constant key.  There is one entry per category, whatever the
    number of rows, and the plan does not grow with their number."""
    if not isinstance(centroids, DataFrame):
        centroids = df.sparkSession.createDataFrame(
            [(lab, [float(x) for x in c]) for lab, c in centroids], f"label {label_type}, centroid ARRAY<DOUBLE>")
    c = centroids.select(F.col("label").cast(label_type).alias("label"),
                         F.transform("centroid", lambda x: x.cast("double")).alias("centroid"))
    table = c.agg(F.sort_array(F.collect_list(
        F.struct("label", "centroid", _norm(F.col("centroid")).alias("norm")))).alias("_ll_cents"))
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    j = join_on_keys(df.withColumn("_ll_v", v).withColumn("_ll_vn", _norm(F.col("_ll_v"))), table, ())
    best = F.array_max(F.transform("_ll_cents", lambda e, i: F.struct(
        (_dot(F.col("_ll_v"), e["centroid"]) / (F.col("_ll_vn") * e["norm"] + F.lit(1e-9))).alias("sim"),
        (-i).alias("neg_i"), e["label"].alias("label"))))
    return (j.withColumn("_ll_best", best)
             .withColumn("category", F.col("_ll_best.label"))
             .withColumn("category_confidence", F.col("_ll_best.sim"))
             .drop("_ll_best", "_ll_cents", "_ll_v", "_ll_vn"))
