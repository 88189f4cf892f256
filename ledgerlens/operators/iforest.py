"""Isolation-forest scores (Liu, Ting & Zhou, ICDM 2008) on Spark.

Per key: each tree is grown on a hash-selected sample of about
``sample_size`` expense rows.  A key of at most ``ROWS_PER_BUCKET`` rows is one
bounded group: its rows are shuffled once, each with the list of its trees, and
its forest is grown and applied in the same call, so neither the trees' samples
nor the nodes are shuffled (a small key has about 200 nodes per row).  For a
larger key the samples make one group and rows are scored by co-grouping row
buckets with the key's forest, each bucket carrying a copy (≤ trees·(2·sample-1)
nodes), so no task holds a whole account.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.common import Keys

FEATURES = ("amount_abs", "dow", "hour", "category_encoded", "days_since_prev")
ROWS_PER_BUCKET = 10_000


def c_factor(n):
    """Average path length of an unsuccessful BST search among n points
    (vectorised; 0 for n <= 1, 1 for n == 2)."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    big = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, big))


def grow_forest(x: np.ndarray, tree_of_row: np.ndarray, rng: np.random.Generator, max_depth: int) -> pd.DataFrame:
    """Grow all trees of one key level by level.

    Every node splits on a feature chosen uniformly among those not constant
    in the node, at a threshold uniform in (min, max); nodes with one row,
    no usable feature or at ``max_depth`` are leaves.  Returns one row per
    node with global node ids (children point at global ids)."""
    trees = np.unique(tree_of_row)
    node_of_row = np.searchsorted(trees, tree_of_row)          # roots are 0..T-1
    tree, size = trees, np.bincount(node_of_row, minlength=len(trees))
    level, thr = np.zeros(len(trees), dtype=int), np.zeros(len(trees))
    feat, left, right = (np.full(len(trees), -1) for _ in range(3))
    open_nodes = np.arange(len(trees))
    for depth in range(max_depth):
        rows = np.flatnonzero(np.isin(node_of_row, open_nodes))
        if rows.size == 0:
            break
        rows = rows[np.argsort(node_of_row[rows], kind="stable")]
        nodes, first, inv, n = np.unique(node_of_row[rows], return_index=True, return_inverse=True, return_counts=True)
        lo, hi = np.fmin.reduceat(x[rows], first), np.fmax.reduceat(x[rows], first)
        usable = (hi > lo) & (n[:, None] > 1)
        u = np.where(usable, rng.random(usable.shape), -1.0)
        f = u.argmax(axis=1)
        at = np.arange(len(nodes))
        t = lo[at, f] + rng.random(len(nodes)) * (hi[at, f] - lo[at, f])
        split = np.flatnonzero(usable.any(axis=1))
        base, new = len(tree), 2 * split.size
        # route rows of split nodes to children
        pos = np.full(len(nodes), -1)
        pos[split] = np.arange(split.size)
        moving = pos[inv] >= 0
        mr = rows[moving]
        go_left = x[mr, f[inv[moving]]] < t[inv[moving]]
        child = base + 2 * pos[inv][moving] + np.where(go_left, 0, 1)
        node_of_row[mr] = child
        parent = nodes[split]
        feat[parent], thr[parent] = f[split], t[split]
        left[parent], right[parent] = base + 2 * np.arange(split.size), base + 2 * np.arange(split.size) + 1
        tree, level = np.concatenate([tree, np.repeat(tree[parent], 2)]), np.concatenate([level, np.full(new, depth + 1)])
        size = np.concatenate([size, np.bincount(child - base, minlength=new)])
        thr = np.concatenate([thr, np.zeros(new)])
        feat, left, right = (np.concatenate([c, np.full(new, -1)]) for c in (feat, left, right))
        open_nodes = base + np.arange(new)
    return pd.DataFrame({"tree_id": tree.astype(np.int32), "node": np.arange(len(tree)), "feature": feat, "threshold": thr,
                         "left": left, "right": right, "size": size, "depth": level})


def _build_fn(keys: Sequence[str], sample_size: int, seed: int):
    """Grow every tree of one key.  The group is the key's tree samples:
    about trees x sample_size rows at most, however large the key is."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(FEATURES)].to_numpy(dtype=float)
        # The depth limit follows the rows a tree really has: a small account's
        # trees are grown on all its rows, fewer than ``sample_size``.
        rows = min(sample_size, int(pdf["tree_id"].value_counts().max()))
        max_depth = int(math.ceil(math.log2(max(rows, 2))))
        rng = np.random.default_rng([seed, len(pdf)])
        res = grow_forest(x, pdf["tree_id"].to_numpy(), rng, max_depth)
        roots = res[res["depth"] == 0].set_index("tree_id")["size"]
        res["psi"] = res["tree_id"].map(roots).astype("int64")
        for k in reversed(list(keys)):
            res.insert(0, k, pdf[k].iloc[0])
        return res

    return build


def path_lengths(x: np.ndarray, nodes: pd.DataFrame) -> np.ndarray:
    """Mean over trees of depth + c(leaf size), all rows x trees at once."""
    nodes = nodes.sort_values("node")
    feat = nodes["feature"].to_numpy()
    thr = nodes["threshold"].to_numpy()
    left = nodes["left"].to_numpy()
    right = nodes["right"].to_numpy()
    size = nodes["size"].to_numpy()
    depth = nodes["depth"].to_numpy()
    roots = np.flatnonzero(depth == 0)
    cur = np.tile(roots, (len(x), 1))
    rows = np.arange(len(x))[:, None].repeat(len(roots), axis=1)
    active = feat[cur] >= 0
    while active.any():
        c = cur[active]
        go_left = x[rows[active], feat[c]] < thr[c]
        cur[active] = np.where(go_left, left[c], right[c])
        active = feat[cur] >= 0
    return (depth[cur] + c_factor(size[cur])).mean(axis=1)


def _score_fn(keys: Sequence[str]):
    def score(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*keys, "transaction_id"]].copy()
        if rows.empty or nodes.empty:
            out["raw_score"] = 0.0
            return out
        x = rows[list(FEATURES)].to_numpy(dtype=float)
        eh = path_lengths(x, nodes)
        psi = float(nodes.loc[nodes["depth"] == 0, "psi"].mean())
        cn = float(c_factor(psi))
        out["raw_score"] = np.power(2.0, -eh / cn) if cn > 0 else 0.0
        return out

    return score


def _grow_and_score_fn(keys: Sequence[str], n_trees: int, sample_size: int, seed: int):
    """Grow the forest of one small key and score its rows.  ``picks`` holds
    the trees of a row, null for all of them."""
    build, score = _build_fn(keys, sample_size, seed), _score_fn(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = [np.arange(n_trees) if p is None else p for p in pdf["picks"]]
        sample = pdf.iloc[np.repeat(np.arange(len(pdf)), [len(t) for t in trees])].drop(columns="picks")
        sample = sample.assign(tree_id=np.concatenate(trees).astype(np.int32))
        return score(pdf, sample if sample.empty else build(sample))

    return run


def iforest_scores(feats: DataFrame, keys: Keys = (), n_trees: int = 100, sample_size: int = 256,
                   seed: int = 42, forest: DataFrame | None = None) -> DataFrame:
    """``feats`` (from ``anomaly_features``) + ``raw_score`` = 2^(-E[h]/c(psi))."""
    keys = list(keys)
    work = feats if keys else feats.withColumn("_ll_all", F.lit(0))
    kk = keys or ["_ll_all"]
    counts = work.groupBy(*kk).agg(F.count(F.lit(1)).alias("_ll_n"))
    w = work.join(counts, kk).select(*kk, "_ll_n", "transaction_id", *FEATURES)
    kschema = ", ".join(f"{k} {dict(work.dtypes)[k]}" for k in kk)
    out_schema = kschema + ", transaction_id STRING, raw_score DOUBLE"
    small, scored = F.col("_ll_n") <= ROWS_PER_BUCKET, None
    if forest is None:
        rate = F.least(F.lit(1.0), F.lit(float(sample_size)) / F.col("_ll_n"))
        # All 53 bits a double holds, so the rate may be as low as any key needs.
        u = lambda t: (F.shiftrightunsigned(F.xxhash64(F.col("transaction_id"), t, F.lit(seed)), 11)
                       / F.lit(2.0 ** 53))
        picks = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: u(t) < rate)
        few = w.where(small).select(*kk, "transaction_id", *FEATURES, F.when(rate < 1.0, picks).alias("picks"))
        scored = few.groupBy(*kk).applyInPandas(_grow_and_score_fn(kk, n_trees, sample_size, seed), out_schema)
        w, counts = w.where(~small), counts.where(~small)
        sample = w.select(*kk, *FEATURES, F.explode(picks).alias("tree_id"))
        node_schema = kschema + \
            ", tree_id INT, node BIGINT, feature BIGINT, threshold DOUBLE, left BIGINT, right BIGINT, " \
            "size BIGINT, depth BIGINT, psi BIGINT"
        forest = sample.groupBy(*kk).applyInPandas(_build_fn(kk, sample_size, seed), node_schema)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_ll_n") / F.lit(float(ROWS_PER_BUCKET)))).cast("int")
    rows = w.withColumn("_ll_b", F.pmod(F.xxhash64("transaction_id"), buckets).cast("int")) \
        .select(*kk, "_ll_b", "transaction_id", *FEATURES)
    per_key_b = counts.select(*kk, F.explode(F.sequence(F.lit(0), buckets - 1)).alias("_ll_b"))
    nodes = forest.join(per_key_b, kk)
    many = (rows.groupBy(*kk, "_ll_b").cogroup(nodes.groupBy(*kk, "_ll_b"))
            .applyInPandas(_score_fn(kk), out_schema))
    scored = many if scored is None else scored.unionByName(many)
    return feats.join(scored.drop("_ll_all") if not keys else scored, [*keys, "transaction_id"])
