"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` fixed random directions.  Two
vectors at cosine t are sqrt(2 - 2t) apart, so their projections differ by
about that over sqrt(d): a window around the query's projection holds its near
neighbours.  The first two projections deal the work: each vector has a home
cell and is copied to the neighbour cells its window reaches, so a query finds
all its neighbours in its own home cell.  Inside a cell each further
projection is sorted, a query's window is the run of ranks between two binary
searches, and the runs that hold a vector are counted per pair.  Pairs with
at least the calibrated count are verified by their cosine in double precision.

The count is calibrated for recall: at the threshold a projection collides
with probability P(|N| <= ``Z``), and the largest count is taken that a
binomial reaches with probability 1 - ``MISS``.

Equal vectors of a label collapse to one representative first.  A cell of any
size is dealt as query blocks by member blocks of bounded size; a block sends
counts and a spanning forest of its links, not the links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import connected_components, materialize, star_forest

THRESHOLD = 0.98
PROJECTIONS = 18
LEAD_Z, Z, MISS = 4.5, 3.0, 1e-6
QUERY_BLOCK, MEMBER_BLOCK = 1024, 2048
_SEED = 20240229


def directions(dim: int) -> np.ndarray:
    d = np.random.default_rng([_SEED, dim]).normal(size=(PROJECTIONS, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def window(dim: int, threshold: float, z: float) -> float:
    """Half width: z deviations, but never more than the distance itself."""
    dist = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    return min(dist, z * dist / math.sqrt(dim))


def calibrated_count(m: int) -> int:
    """The largest count reached by Binomial(m, P(|N| <= Z)) with probability 1 - MISS."""
    p = math.erf(Z / math.sqrt(2))
    below = 0.0
    for c in range(m + 1):
        below += math.comb(m, c) * p ** c * (1 - p) ** (m - c)
        if below > MISS:
            return c
    return m


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(x, np.float64) for x in raw])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def compare_block(q_ids, q_raw, m_ids, m_raw, m_copies, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of the query rows to the member rows: weighted counts and a forest."""
    u, v = _unit(q_raw), _unit(m_raw)
    d = directions(u.shape[1])
    pu, pv = u @ d.T, v @ d.T
    w = window(u.shape[1], threshold, Z)
    count = np.zeros((len(u), len(v)), np.uint8)
    for j in range(2, PROJECTIONS):
        order = np.argsort(pv[:, j], kind="stable")
        ranks = np.empty(len(v), np.int32)
        ranks[order] = np.arange(len(v))
        line = pv[order, j]
        lo, hi = np.searchsorted(line, pu[:, j] - w, "left"), np.searchsorted(line, pu[:, j] + w, "right")
        count += (ranks[None, :] >= lo[:, None]) & (ranks[None, :] < hi[:, None])
    near = count >= calibrated_count(PROJECTIONS - 2)
    if near.mean() > 0.05:
        near &= (u @ v.T) >= threshold
        i, j = np.nonzero(near)
    else:
        i, j = np.nonzero(near)
        cos = np.concatenate([(u[i[s:s + 100_000]] * v[j[s:s + 100_000]]).sum(1) for s in range(0, len(i), 100_000)] or [np.zeros(0)])
        i, j = i[cos >= threshold], j[cos >= threshold]
    other = q_ids[i] != m_ids[j]
    i, j = i[other], j[other]
    return np.bincount(i, m_copies[j], minlength=len(u)).astype(np.int64), star_forest(q_ids[i], m_ids[j])


def _keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, k1, k2, label, dim, raw): 128-bit key of (label, vector); rows
    that link with nothing have null keys."""
    def run(batches):
        for b in batches:
            k1, k2, dims, raws = [], [], [], []
            for label, vec in zip(b.column(1).to_pylist(), b.column(2)):
                x = None
                if label is not None and vec.is_valid and vec.values.null_count == 0:
                    x = vec.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if len(x) == 0 or not np.isfinite(x).all() or not np.any(x):
                        x = None
                    else:  # the direction alone counts; scaling keeps extreme norms finite
                        x = x / np.abs(x).max()
                if x is None:
                    for out in (k1, k2, dims, raws):
                        out.append(None)
                    continue
                h = hashlib.blake2b(f"{label}|{len(x)}|".encode() + x.tobytes(), digest_size=16).digest()
                k1.append(int.from_bytes(h[:8], "little", signed=True))
                k2.append(int.from_bytes(h[8:], "little", signed=True))
                dims.append(len(x))
                raws.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), b.column(1), pa.array(dims, pa.int32()),
                 pa.array(raws, pa.binary())], names=["vec_id", "k1", "k2", "label", "dim", "raw"])
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, k1 long, k2 long, label string, dim int, raw binary")


def _cells(reps: DataFrame, threshold: float) -> DataFrame:
    """Each representative in its home cell and in the cells its window reaches."""
    def run(batches):
        for b in batches:
            dims, raws = b.column(3).to_pylist(), b.column(4).to_pylist()
            at, c1, c2, home = [], [], [], []
            for i, (dim, raw) in enumerate(zip(dims, raws)):
                w = window(dim, threshold, LEAD_Z)
                p = directions_of(dim)[:2] @ np.frombuffer(raw, np.float64)
                p = p / np.linalg.norm(np.frombuffer(raw, np.float64))
                c = [math.floor(x / (2 * w)) for x in p]
                reach = [[c[k], *([c[k] - 1] if p[k] - 2 * w * c[k] <= w else []), *([c[k] + 1] if 2 * w * (c[k] + 1) - p[k] <= w else [])]
                         for k in (0, 1)]
                for x in reach[0]:
                    for y in reach[1]:
                        at.append(i)
                        c1.append(x)
                        c2.append(y)
                        home.append(x == c[0] and y == c[1])
            t = pa.RecordBatch.from_arrays(b.columns, names=b.schema.names).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(home, pa.bool_())],
                                             names=[*b.schema.names, "c1", "c2", "home"])
    cache: dict[int, np.ndarray] = {}

    def directions_of(dim):
        if dim not in cache:
            cache[dim] = directions(dim)
        return cache[dim]
    src = reps.select("rep", "copies", "label", "dim", "raw")
    return src.mapInArrow(run, "rep long, copies long, label string, dim int, raw binary, c1 long, c2 long, home boolean")


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other rows of the same label at cosine ``threshold`` or
    more; component_id is the smallest vec_id reachable by links (itself
    included).  Null labels, null, empty and zero vectors and vectors with a
    null or non-finite component link with nothing; vectors of different length
    do not link.  Equal vectors under different ids, and repeated rows, link
    like any others.  Reads vec_id, label and embedding only.
    """
    keyed = materialize(_keyed(vectors), "vectors")
    reps = materialize(keyed.where("k1 is not null").groupBy("k1", "k2", "label", "dim", "raw")
                       .agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
                       .withColumn("rep", F.monotonically_increasing_id()), "vector-reps")
    cell = ["label", "dim", "c1", "c2"]
    dealt = materialize(_cells(reps, threshold), "cells")
    sizes = dealt.groupBy(*cell).agg(F.ceil(F.sum(F.col("home").cast("long")) / QUERY_BLOCK).alias("nq"),
                                     F.ceil(F.count("*") / MEMBER_BLOCK).alias("nm")).where("nq > 0")
    dealt = dealt.join(sizes, cell)
    q = dealt.where("home").select(*cell, F.pmod(F.xxhash64("rep"), F.col("nq")).alias("qb"),
                                   F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)).alias("mb"), "rep", "copies", "raw", F.lit(True).alias("query"))
    m = dealt.select(*cell, F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"),
                     F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nm")).alias("mb"), "rep", "copies", "raw", F.lit(False).alias("query"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        n, forest = compare_block(a["rep"].to_numpy(), a["raw"].tolist(), b["rep"].to_numpy(), b["raw"].tolist(),
                                  b["copies"].to_numpy(), threshold)
        some = n > 0
        ids = a["rep"].to_numpy()[some]
        left, right = [list(x) for x in zip(*forest)] if forest else ([], [])
        return pd.DataFrame({"a": np.concatenate([ids, np.array(left, np.int64)]), "b": np.concatenate([ids, np.array(right, np.int64)]),
                             "n": np.concatenate([n[some], np.zeros(len(left), np.int64)])})

    found = materialize(q.unionByName(m).groupBy(*cell, "qb", "mb").applyInPandas(compare, "a long, b long, n long"), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("rep"), "component")
    of = (reps.select("k1", "k2", "rep", "first", "copies").join(counts, "rep", "left").join(comp, "rep", "left")
          .withColumn("component", F.coalesce("component", "rep")))
    of = materialize(of, "vector-classes")
    lead = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(lead, "component").select("k1", "k2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.select("vec_id", "k1", "k2").join(of, ["k1", "k2"], "left")
    none = F.col("k1").isNull()
    comp_id = F.when(none, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.col("vec_id").eqNullSafe(comp_id).alias("kept"))
