"""Density clustering of description embeddings.

With min_samples = 1 the mutual-reachability distance is the plain distance,
so the hierarchy is single linkage.  :func:`single_linkage` gives its merges up
to a distance ``eps`` (the minimum spanning forest of the eps-graph) and
:func:`cluster_embeddings` the flat clusters at that cut.

* **eps-graph by pivot cells.**  A cell's members are dealt to its pivots: each
  has its home at the nearest one and is copied to every pivot at most 2 eps
  farther away, so a member meets all its neighbours in its own home cell (two
  points within eps differ by at most eps in their distance to any pivot).  A
  cell is split again while that halves the comparisons (counted before any
  copy is made); cells that no pivots can split are compared in blocks of
  bounded size, each pair of blocks once.  A row goes to at most about
  2 BLOCKS pairs, so what is shuffled grows with the rows, not their square.
* **Forests instead of edges.**  A block sends the minimum spanning forest of
  its edges only; the forest of all edges is the forest of the blocks' forests.
* **Borůvka rounds.**  Every component takes its least outgoing edge, hooked
  components are joined by pointer jumping, until no edge leaves a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.common import global_position
from ledgerlens.plans.materialize import materialize

CELL = 2048  # members of a cell that is not split
PIVOTS = 24
GAIN = 0.5  # a split must leave at most this share of the comparisons
QUERY_BLOCK, MEMBER_BLOCK = 1024, 4096  # vectors compared at a time
BLOCKS, LARGEST_BLOCK = 48, 32_768  # a cell makes at most BLOCKS blocks of each kind, until they hold LARGEST_BLOCK rows
BROADCAST_SIZES = 500_000  # (cell, nq, nm) rows sent to all tasks
BROADCAST_CELLS = 500  # pivot sets (PIVOTS vectors each) sent to all tasks; more are joined by shuffle
_SLACK = 1e-9


def spanning_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the minimum spanning forest's edges, ordered by (d, a, b)."""
    order = np.lexsort((b, a, d))
    nodes, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label, taken, live = np.arange(len(nodes)), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        live = live[label[x[live]] != label[y[live]]]
        if not len(live):
            return order[taken]
        least = np.full(len(nodes), len(a))
        np.minimum.at(least, label[x[live]], live)
        np.minimum.at(least, label[y[live]], live)
        pick = np.unique(least[least < len(a)])
        taken[pick] = True
        while True:  # components of the picked edges: the smallest label spreads
            low = np.minimum(label[x[pick]], label[y[pick]])
            spread = np.arange(len(nodes))
            np.minimum.at(spread, label[x[pick]], low)
            np.minimum.at(spread, label[y[pick]], low)
            while (spread[spread] != spread).any():
                spread = spread[spread]
            label = spread[label]
            if (label[x[pick]] == label[y[pick]]).all():
                break


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    if len(pc.unique(pc.list_value_length(lists))) != 1:
        raise ValueError("vectors must have one length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _compare(eps: float, query_block: int, member_block: int):
    """The forest of the edges between the asking rows and the others, or
    among the asking rows where a block meets itself."""
    def near(p, u, q, v, above):
        # u.v - (|u|^2 + |v|^2)/2 = -d^2/2 by one product, a little slack for its rounding; d itself is taken plainly.
        half = (1 - 1e-6) / 2
        left = np.column_stack([u, -half * (u * u).sum(1), np.ones(len(u))])
        right = np.column_stack([v, np.ones(len(v)), -half * (v * v).sum(1)])
        i, j = np.nonzero(left @ right.T >= -(eps * eps + 1e-6) / 2)
        keep = (p[i] != q[j]) & (j > i + above)
        i, j = i[keep], j[keep]
        d = np.concatenate([np.zeros(0), *(np.sqrt(((u[i[s:s + 50_000]] - v[j[s:s + 50_000]]) ** 2).sum(1)) for s in range(0, len(i), 50_000))])
        i, j, d = i[d <= eps], j[d <= eps], d[d <= eps]
        return np.minimum(p[i], q[j]), np.maximum(p[i], q[j]), d

    def forest(parts):
        a, b, d = (np.concatenate(c) for c in zip(*parts))
        keep = spanning_forest(a, b, d) if len(a) else np.zeros(0, np.int64)
        return a[keep], b[keep], d[keep]

    def run(block: pa.Table) -> pa.Table:
        itself = block.column("qb")[0].as_py() == block.column("mb")[0].as_py()
        left = block.filter(block.column("asking"))
        right = left if itself else block.filter(pc.invert(block.column("asking")))
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            p, q = left.column("p").to_numpy(), right.column("p").to_numpy()
            u, v = _matrix(left.column("v")), _matrix(right.column("v"))
            for s in range(0, len(p), query_block):
                for t in range(s if itself else 0, len(q), member_block):
                    e, m = s + query_block, t + member_block
                    parts.append(near(p[s:e], u[s:e], q[t:m], v[t:m], s - t if itself else -len(p)))
                    if sum(len(x[0]) for x in parts) > 500_000:  # bounded memory
                        parts = [forest(parts)]
        a, b, d = forest(parts)
        return pa.table({"a": a, "b": b, "d": d})
    return run


def _deal(eps: float, count: bool = False):
    """Rows (cell, p, v, home, pivots) -> (parent, pivot, p, v, home): one row
    per cell the member enters; or only their numbers (parent, pivot, members, homes)."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for cell in pc.unique(table.column("cell")).to_pylist():
                rows = table.filter(pc.equal(table.column("cell"), cell))
                v = _matrix(rows.column("v"))
                pivots = np.array(rows.column("pivots")[0].as_py())
                d = np.sqrt(np.maximum(((v[:, None, :] - pivots[None]) ** 2).sum(2), 0))
                near = d.argmin(axis=1)
                i, j = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * eps + _SLACK)
                home = rows.column("home").to_numpy()[i] & (j == near[i])
                if count:
                    members, homes = (np.bincount(j[x], minlength=len(pivots)) for x in (slice(None), home))
                    yield pa.RecordBatch.from_pydict({"parent": pa.array(np.full(len(pivots), cell)), "pivot": pa.array(range(len(pivots)), pa.int64()),
                                                      "members": pa.array(members), "homes": pa.array(homes)})
                    continue
                take = rows.take(pa.array(i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), cell)), pa.array(j, pa.int64()), take.column("p").combine_chunks(),
                     take.column("v").combine_chunks(), pa.array(home)], names=["parent", "pivot", "p", "v", "home"])
    return run


def _cells(points: DataFrame, eps: float) -> list[DataFrame]:
    """Tables (cell, p, v, home): together the final cells."""
    cols = ["cell", "p", "v", "home"]
    todo = points.select(F.lit(0).cast("long").alias("cell"), "p", "v", F.lit(True).alias("home"))
    out, level = [], 0
    while True:
        level += 1
        size = todo.groupBy("cell").agg(F.count("*").alias("members"), F.count_if("home").alias("homes"))
        large = materialize(size.where((F.col("members") > CELL) & (F.col("homes") > 0)), "large-cells")
        n_large = large.count()
        small = size.where((F.col("members") <= CELL) & (F.col("homes") > 0)).select("cell")
        out.append(todo.join(small, "cell", "left_semi").select(*cols))
        if not n_large:
            return out
        members = materialize(todo.join(large.select("cell"), "cell", "left_semi").select(*cols), "cell-members")
        rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("p", F.lit(level)), "p"))
        pivots = (members.withColumn("r", rank).where(F.col("r") <= PIVOTS)  # each task passes on PIVOTS rows of a cell at most
                  .groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("pivots")))
        with_pivots = members.join(F.broadcast(pivots) if n_large <= BROADCAST_CELLS else pivots, "cell")
        asked = with_pivots.select(*cols, "pivots")
        cost = (asked.mapInArrow(_deal(eps, count=True), "parent long, pivot long, members long, homes long")
                .groupBy("parent", "pivot").agg((F.sum("members").cast("double") * F.sum("homes")).alias("pairs"))
                .groupBy("parent").agg(F.sum("pairs").alias("pairs")))
        worth = (large.join(cost, large.cell == cost.parent)
                 .where(F.col("pairs") <= GAIN * F.col("members") * F.col("homes")).select("cell"))
        worth = materialize(worth, "split-cells")
        out.append(members.join(worth, "cell", "left_anti").select(*cols))
        dealt = asked.join(worth, "cell", "left_semi").mapInArrow(_deal(eps), "parent long, pivot long, p long, v array<double>, home boolean")
        todo = materialize(dealt.withColumn("cell", F.xxhash64("parent", "pivot", F.lit(level))).select(*cols), "dealt")


def _edges(points: DataFrame, eps: float) -> DataFrame:
    """(a, b, d): forests of the cells' blocks, a < b, d <= eps."""
    cells = _cells(points, eps)
    cells = materialize(cells[0] if len(cells) == 1 else _union(cells), "cells")
    count = lambda n: F.greatest(F.least(F.ceil(n / MEMBER_BLOCK), F.lit(BLOCKS)), F.ceil(n / LARGEST_BLOCK))
    size = cells.groupBy("cell").agg(count(F.count_if("home")).alias("nq"), count(F.count_if(~F.col("home"))).alias("nm")).where("nq > 0")
    size = materialize(size, "cell-sizes")
    # Home blocks are 0 .. nq-1, the others nq .. nq+nm-1; a home block meets itself and each other block once.
    block = F.when(F.col("home"), F.pmod(F.xxhash64("p"), F.col("nq"))).otherwise(F.col("nq") + F.pmod(F.xxhash64("p"), F.col("nm")))
    met = F.sequence(F.lit(0).cast("long"), F.col("nq") + F.when(F.col("home"), F.col("nm")).otherwise(0) - 1)
    sized = cells.join(F.broadcast(size) if size.count() <= BROADCAST_SIZES else size, "cell")
    rows = sized.select("cell", block.alias("block"), F.explode(met).alias("met"), "p", "v")
    rows = rows.select("cell", F.least("block", "met").alias("qb"), F.greatest("block", "met").alias("mb"), "p", "v",
                       (F.col("block") <= F.col("met")).alias("asking"))
    # Dealt by block: rows that a join has placed by cell would count as grouped, and a cell's blocks all be one task's.
    found = rows.repartition("cell", "qb", "mb").groupBy("cell", "qb", "mb").applyInArrow(_compare(eps, QUERY_BLOCK, MEMBER_BLOCK), "a long, b long, d double")
    return materialize(found.groupBy("a", "b").agg(F.min("d").alias("d")), "cell-forests")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, d) of the minimum spanning forest, and (p, component) of its
    nodes; component is the smallest p of the tree."""
    e = edges.select("a", "b", "d", F.col("a").alias("ca"), F.col("b").alias("cb"))
    nodes = edges.select(F.col("a").alias("p")).union(edges.select(F.col("b").alias("p"))).distinct()
    of = materialize(nodes.select("p", F.col("p").alias("component")), "components")
    merges = []
    while e.head(1):
        side = e.select(F.col("ca").alias("c"), F.struct("d", "a", "b", F.col("cb").alias("to")).alias("least")).union(
            e.select(F.col("cb").alias("c"), F.struct("d", "a", "b", F.col("ca").alias("to")).alias("least")))
        least = materialize(side.groupBy("c").agg(F.min("least").alias("least")).select("c", "least.*"), "least-edges")
        merges.append(least.select("a", "b", "d").distinct())
        # Two components that take the same edge: the smaller is the root.
        back = least.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
        up = (least.join(back, ["c", "to"], "left")
              .select("c", F.when(F.col("mutual") & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")))
        up = materialize(up, "hooks")
        while True:  # pointer jumping: half the distance to the root is left each time
            far = up.select(F.col("c").alias("root"), F.col("root").alias("next"))
            longer = materialize(up.join(far, "root").select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "hooks")
            up = longer.select("c", "root")
            if not longer.where("moved").head(1):
                break
        of = materialize(of.join(up.select(F.col("c").alias("component"), "root"), "component", "left")
                         .select("p", F.coalesce("root", "component").alias("component")), "components")
        e = (e.join(up.select(F.col("c").alias("ca"), F.col("root").alias("ra")), "ca").join(up.select(F.col("c").alias("cb"), F.col("root").alias("rb")), "cb")
             .where("ra <> rb").select("a", "b", "d", F.col("ra").alias("ca"), F.col("rb").alias("cb")))
        e = materialize(e, "outgoing-edges")
    first = of.groupBy("component").agg(F.min("p").alias("first"))
    of = of.join(first, "component").select("p", F.col("first").alias("component"))
    return (_union(merges) if merges else edges), of


def _points(df: DataFrame, id_col: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: (row, id, v) with v null where a vector cannot be
    compared, and the distinct vectors (p, v, n), p the first row of n."""
    v = F.transform(vec, lambda x: x.cast("double") + F.lit(0.0))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size(v) == 0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.when(~bad, v).alias("v"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    points = rows.where("v is not null").groupBy("v").agg(F.min("row").alias("p"), F.count("*").alias("n"))
    return rows, materialize(points.select("p", "v", "n"), "points")


def single_linkage(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", eps: float = 0.5) -> DataFrame:
    """(a, b, distance): the merges of single linkage up to ``eps``, ids with
    a row of either side; equal vectors merge at distance 0 and are not
    listed.  Ties in distance are broken by row."""
    rows, points = _points(df, id_col, vec)
    merges, _ = _boruvka(_edges(points, eps))
    ids = rows.select("row", "id")
    return (merges.join(ids.select(F.col("row").alias("a"), F.col("id").alias("ia")), "a")
            .join(ids.select(F.col("row").alias("b"), F.col("id").alias("ib")), "b")
            .select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), F.col("d").alias("distance")))


def cluster_embeddings(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", eps: float = 0.5,
                       min_cluster_size: int = 2) -> DataFrame:
    """(id, cluster_id) per row: components of the eps-graph (Euclidean
    distance <= ``eps``) with at least ``min_cluster_size`` rows, numbered 0, 1,
    ... in the order of their smallest id; -1 for noise.

    Vectors must have one length.  Null and empty vectors and those with a null
    or non-finite component are noise.  Equal vectors count each and cluster
    together; null ids are numbered last; an empty table gives no rows.
    """
    if eps < 0 or min_cluster_size < 1:
        raise ValueError("eps must not be negative and min_cluster_size must be positive")
    rows, points = _points(df, id_col, vec)
    _, of = _boruvka(_edges(points, eps))
    member = points.join(of, "p", "left").select("v", F.coalesce("component", "p").alias("component"))
    tagged = materialize(rows.join(member, "v", "left").select("id", "component"), "tagged")
    clusters = (tagged.where("component is not null").groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("first"))
                .where(F.col("n") >= min_cluster_size))
    numbered = global_position(clusters, [F.asc_nulls_last("first"), "component"], "cluster_id")
    return (tagged.join(numbered.select("component", "cluster_id"), "component", "left")
            .select(F.col("id").alias(id_col), F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id")))
