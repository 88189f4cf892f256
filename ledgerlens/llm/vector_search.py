"""Exact top-k inner-product search, term at a time.

Components become integers, floor(``SCALE`` * x).  A dimension is a term: its
postings are the members of a block with a nonzero value there.  A query is a
sparse row; each of its terms scatters weight times value into a dense array of
scores, one place per member of the block.  The k best of a block come from a
partial selection, and the blocks' lists merge by rank.

All queries meet all members: members are dealt into blocks of
``MEMBER_BLOCK`` rows, queries into blocks of ``QUERY_BLOCK`` rows, and a task
holds one block of each.  No index prunes, so the result is exact.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import materialize

SCALE = 1024
TOP_K = 10
EVERY = 100  # a row whose id this divides is a query
QUERY_BLOCK, MEMBER_BLOCK = 8192, 4096
_LONG = (-(1 << 63), (1 << 63) - 1)


def _integers(vectors: list[np.ndarray], scale: int) -> np.ndarray:
    """(row, dimension) of floor(scale * x); a shorter vector ends in zeros.
    Python integers where a product sum could leave 64 bits."""
    dim = max((len(v) for v in vectors), default=0)
    x = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        x[i, :len(v)] = v
    if np.abs(x).max(initial=0.0) * scale < 2.0 ** 31 / max(dim, 1) ** 0.5:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[Fraction(c) * scale // 1 for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def best_of_block(queries: np.ndarray, q_rows: np.ndarray, members: np.ndarray, m_rows: np.ndarray, k: int):
    """(query, member, score) positions of each query's k best members, the
    earlier member first among equal scores; its own row is no candidate.
    ``members`` are in the order of the tie rule."""
    if members.dtype != queries.dtype:
        queries, members = queries.astype(object), members.astype(object)
    dim = min(queries.shape[1], members.shape[1])
    postings = []
    for t in range(dim):
        at = np.flatnonzero(members[:, t])
        postings.append((at, members[at, t]))
    own = {r: i for i, r in enumerate(m_rows.tolist())}
    out_q, out_m, out_s = [], [], []
    for i, weights in enumerate(queries):
        scores = np.zeros(len(members), dtype=members.dtype)
        for t in np.flatnonzero(weights[:dim]):
            at, value = postings[t]
            scores[at] += weights[t] * value
        if scores.dtype == object:
            scores = np.array([min(max(x, _LONG[0]), _LONG[1]) for x in scores], dtype=np.int64)
        mine = own.get(int(q_rows[i]))
        ids = np.arange(len(scores)) if mine is None else np.delete(np.arange(len(scores)), mine)
        s = scores[ids]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            above, ties = np.flatnonzero(s > least), np.flatnonzero(s == least)
            pick = np.concatenate([above, ties[:k - len(above)]])
        else:
            pick = np.arange(len(s))
        out_q += [i] * len(pick)
        out_m += ids[pick].tolist()
        out_s += s[pick].tolist()
    return out_q, out_m, out_s


def _search(scale: int, k: int):
    def run(block: pa.Table) -> pa.Table:
        left, right = block.filter(block.column("asking")), block.filter(pc.invert(block.column("asking")))
        right = right.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # null ids last
        q, m, s = best_of_block(_integers([v.values.to_numpy() for v in left.column("vector").combine_chunks()], scale),
                                left.column("row").to_numpy(),
                                _integers([v.values.to_numpy() for v in right.column("vector").combine_chunks()], scale),
                                right.column("row").to_numpy(), k)
        q, m = pa.array(q, pa.int64()), pa.array(m, pa.int64())
        return pa.table({"query_row": left.column("row").take(q), "query_id": left.column("vec_id").take(q),
                         "row": right.column("row").take(m), "vec_id": right.column("vec_id").take(m), "score": pa.array(s, pa.int64())})
    return run


def top_k(vectors: DataFrame, queries: Column | None = None, k: int = TOP_K, scale: int = SCALE,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the
    highest integer inner product with each query row, all where there are fewer.

    Queries are the rows for which ``queries`` (a condition on ``id_col``) holds;
    by default those whose id ``EVERY`` divides.  Every row but the query's own
    is a candidate, also one with the same id or vector.  Ties go to the smaller
    id, null ids last; rows with equal id and score are alike in the result.
    Null vectors and vectors with a null or non-finite component take no part;
    zero and empty vectors score 0; the missing components of a shorter vector
    are 0.  A score outside 64 bits counts as the nearest long.  Repeated query
    rows are answered each.  Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = materialize(rows.where(F.col("vector").isNotNull() & ~bad).withColumn("row", F.monotonically_increasing_id()), "search-vectors")
    asked = rows.where(queries if queries is not None else F.col("vec_id") % EVERY == 0)
    # Numbers of blocks grow with the table, so a task's two blocks keep their size.
    nm, nq = max(1, -(-rows.count() // MEMBER_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    q = (asked.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(nq)))
         .withColumn("mb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nm - 1).cast("long")))))
    m = (rows.withColumn("mb", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(nm)))
         .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long")))))
    columns = ["qb", "mb", "row", "vec_id", "vector"]
    both = q.select(*columns, F.lit(True).alias("asking")).unionByName(m.select(*columns, F.lit(False).alias("asking")))
    found = (both.groupBy("qb", "mb")
             .applyInArrow(_search(scale, k), "query_row long, query_id long, row long, vec_id long, score long"))
    # Each map task passes on its own k best of a query only; the lists then merge.
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
