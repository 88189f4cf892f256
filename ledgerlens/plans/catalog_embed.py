"""Embedding queries: seed centroids, nearest-centroid categories, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.money import round_half_up
from ledgerlens.operators.categorize import categorize_embeddings, seed_centroids
from ledgerlens.operators.cluster import cluster_embeddings
from ledgerlens.plans import oracle as o
from ledgerlens.plans.catalog import register
from ledgerlens.sources.ledgers import table

_C = """c AS (SELECT label, pos, avg(x) AS mean FROM (
        SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
      GROUP BY label, pos)"""


@register("seed_centroids", f"WITH {_C} SELECT label, pos, {o.rhu('mean', 6)} AS mean FROM c")
def q_centroids(spark, d):
    c = seed_centroids(table(spark, d, "embeddings"))
    return (c.select("label", F.posexplode("centroid").alias("pos", "mean"))
            .select("label", "pos", round_half_up(F.col("mean"), 6).alias("mean")))


def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda acc, y: acc + y)"


@register("nearest_centroid", f"""WITH {_C},
cl AS (SELECT label AS cat, list(mean ORDER BY pos) AS cen FROM c GROUP BY label),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT vec_id, label, cat, {_dot('e', 'cen')} / (sqrt({_dot('e', 'e')}) * sqrt({_dot('cen', 'cen')}) + 1e-9) AS sim
      FROM v, cl)
SELECT vec_id, label, cat AS category, {o.rhu('sim', 6)} AS category_confidence FROM s
QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY sim DESC, cat) = 1""")
def q_nearest(spark, d):
    emb = table(spark, d, "embeddings")
    out = categorize_embeddings(emb, seed_centroids(emb))
    return out.select("vec_id", "label", "category",
                      round_half_up(F.col("category_confidence"), 6).alias("category_confidence"))


#: The tables' vectors lie about 1.1 from their nearest neighbours; this cut
#: gives some clusters and much noise.
CLUSTER_EPS = 1.05

_CLUSTERS = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
near AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b
         WHERE a.vec_id <> b.vec_id AND sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) <= {CLUSTER_EPS}),
reach(x, y) AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
c AS (SELECT x, least(x, min(y)) AS first FROM reach GROUP BY x),
k AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS cluster_id FROM (SELECT DISTINCT first FROM c))
SELECT v.vec_id, CAST(coalesce(k.cluster_id, -1) AS INTEGER) AS cluster_id
FROM v LEFT JOIN c ON v.vec_id = c.x LEFT JOIN k ON c.first = k.first"""


@register("description_clusters", _CLUSTERS)
def q_clusters(spark, d):
    return cluster_embeddings(table(spark, d, "embeddings"), eps=CLUSTER_EPS)


from ledgerlens.plans import catalog_models  # noqa: E402,F401
