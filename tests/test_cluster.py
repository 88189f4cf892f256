from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cluster as c

SCHEMA = "vec_id long, embedding array<double>, p long, cluster_id string"


def brute(rows, eps, least=2):
    """Cluster of every row by a full distance matrix and flood fill."""
    ok = [n for n, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([rows[n][1] for n in ok])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    seen, groups = set(), []
    for s in range(len(ok)):
        if s in seen:
            continue
        todo, group = [s], {s}
        while todo:
            for t in np.flatnonzero(near[todo.pop()]).tolist():
                if t not in group:
                    group.add(t)
                    todo.append(t)
        seen |= group
        groups.append([ok[t] for t in group])
    groups = sorted((g for g in groups if len(g) >= least), key=lambda g: min(rows[n][0] for n in g))
    label = {n: k for k, g in enumerate(groups) for n in g}
    return sorted((rows[n][0], label.get(n, -1)) for n in range(len(rows)))


def blobs(n, centres, spread, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim))
    return [(i, (at[i % centres] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_clusters_equal_brute_force_with_splits(spark, monkeypatch):
    rows = blobs(240, 12, 0.05) + [(1000 + i, v) for i, v in blobs(30, 30, 1.0, seed=2)]
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2002, None), (2003, []), (2004, [1.0, None] + [0.0] * 4), (2005, [float("nan")] * 6),
             (2006, [9.0] * 6), (2007, [9.0] * 6)]
    assert got(c.cluster_embeddings(frame(spark, rows), eps=0.2)) == brute(rows, 0.2)
    monkeypatch.setattr(c, "CELL", 12)
    monkeypatch.setattr(c, "PIVOTS", 5)
    monkeypatch.setattr(c, "QUERY_BLOCK", 16)
    monkeypatch.setattr(c, "MEMBER_BLOCK", 16)
    monkeypatch.setattr(c, "BROADCAST_CELLS", 1)
    assert got(c.cluster_embeddings(frame(spark, rows), eps=0.2)) == brute(rows, 0.2)


def test_merges_are_the_minimum_spanning_forest(spark):
    rows = blobs(60, 4, 0.3, dim=3)
    x = np.array([v for _, v in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    group, want = list(range(60)), []
    for e, i, j in sorted((d[i, j], i, j) for i in range(60) for j in range(i) if d[i, j] <= 0.6):
        if group[i] != group[j]:
            want.append(round(e, 9))
            group = [group[j] if g == group[i] else g for g in group]
    merges = c.single_linkage(frame(spark, rows), eps=0.6).collect()
    assert sorted(round(r.distance, 9) for r in merges) == sorted(want)
    assert all(abs(d[r.a, r.b] - r.distance) < 1e-9 for r in merges)


def test_cells_keep_the_comparisons_of_grouped_data_flat(spark, monkeypatch):
    """Comparisons per vector do not grow with the table where vectors lie in groups."""
    monkeypatch.setattr(c, "CELL", 40)
    per = []
    for n in (400, 1600):
        points = frame(spark, blobs(n, n // 10, 0.01, dim=4)).select(F.col("vec_id").alias("p"), F.col("embedding").alias("v"))
        cells = c._union(c._cells(points, 0.1))
        pairs = cells.groupBy("cell").agg((F.count("*") * F.count_if("home")).alias("n")).agg(F.sum("n")).first()[0]
        assert cells.where("home").select("p").distinct().count() == cells.where("home").count() == n
        per.append(pairs / n)
    assert per[1] < 1.5 * per[0] and per[1] < 1600 / 4


def test_minimum_size_ties_and_empty_tables(spark):
    rows = [(5, [0.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 2.0]), (9, [5.0, 5.0]), (8, [5.0, 6.0]), (1, [50.0, 0.0])]  # equal distances
    assert got(c.cluster_embeddings(frame(spark, rows), eps=1.0)) == brute(rows, 1.0)
    assert got(c.cluster_embeddings(frame(spark, rows), eps=1.0, min_cluster_size=3)) == brute(rows, 1.0, 3)
    assert got(c.cluster_embeddings(frame(spark, rows), eps=0.0)) == [(i, -1) for i in (1, 3, 4, 5, 8, 9)]
    assert c.cluster_embeddings(frame(spark, [])).count() == 0
    assert got(c.cluster_embeddings(frame(spark, [(1, None)]))) == [(1, -1)]
    with pytest.raises(ValueError):
        c.cluster_embeddings(frame(spark, rows), eps=-1.0)


def test_spanning_forest_joins_every_component():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 80, 400), rng.integers(80, 160, 400)
    d = rng.integers(0, 5, 400).astype(float)
    keep = c.spanning_forest(a, b, d)
    parent = list(range(160))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    total = 0.0
    for e, i, j in sorted(zip(d, a, b)):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            total += e
    assert d[keep].sum() == total


def test_blocks_meet_once_and_rows_are_not_copied_to_every_block(spark, monkeypatch):
    """The pairs of blocks a row enters are bounded, however many rows a cell has."""
    rows = blobs(300, 300, 1.0, seed=4)  # one cell that no pivots split
    monkeypatch.setattr(c, "CELL", 20)
    monkeypatch.setattr(c, "MEMBER_BLOCK", 8)
    monkeypatch.setattr(c, "QUERY_BLOCK", 3)
    monkeypatch.setattr(c, "BLOCKS", 5)
    assert got(c.cluster_embeddings(frame(spark, rows), eps=1.5)) == brute(rows, 1.5)


def test_the_blocks_of_one_cell_are_several_tasks(spark, monkeypatch):
    """One cell's blocks are dealt over the tasks, also where its sizes are joined by shuffle."""
    from pyspark import TaskContext
    monkeypatch.setattr(c, "MEMBER_BLOCK", 20)
    monkeypatch.setattr(c, "BROADCAST_SIZES", 0)
    monkeypatch.setattr(c, "_compare", lambda *_: lambda block: pa.table({"a": [TaskContext.get().partitionId()], "b": [block.num_rows], "d": [0.0]}))
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(was, ("-1", "false")):
            spark.conf.set(k, v)
        points = frame(spark, blobs(200, 200, 1.0)).select(F.col("vec_id").alias("p"), F.col("embedding").alias("v"))
        assert c._edges(points, 0.5).select("a").distinct().count() > 1
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
