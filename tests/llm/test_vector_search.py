from __future__ import annotations

import math
from fractions import Fraction

import numpy as np


def brute(rows, k=10):
    ok = [(n, i, v) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = {n: [math.floor(Fraction(x) * 1024) for x in v] for n, _, v in ok}
    out = []
    for n, i, _ in ok:
        if i is None or i % 100:
            continue
        scores = {m: max(-(1 << 63), min(sum(a * b for a, b in zip(ints[n], ints[m])), (1 << 63) - 1)) for m, _, _ in ok}
        got = sorted((-scores[m], j is None, j or 0) for m, j, _ in ok if m != n)
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(got[:k], 1)]
    return sorted(map(str, out))


def vectors(n=260, dim=12):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, dim)).astype(np.float32).astype(float).tolist()
    rows = [(i, base[i % 40]) for i in range(n)]  # ties everywhere
    rows += [(300, None), (400, [1.0, None] + [0.0] * 10), (500, [float("nan")] * dim), (600, [float("inf")] * dim), (700, [0.0] * dim),
             (800, []), (900, [0.5, -0.25]), (100, base[3]), (100, base[3]), (None, base[0])]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label string, rank int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, 0.5) for i, v in rows], SCHEMA).repartition(4)


def test_search_equals_brute_force(spark, monkeypatch):
    from ledgerlens.llm import vector_search as s

    rows = vectors()
    want = brute(rows)
    assert sorted(str(tuple(r)) for r in s.top_k(frame(spark, rows)).collect()) == want
    monkeypatch.setattr(s, "MEMBER_BLOCK", 37)
    monkeypatch.setattr(s, "QUERY_BLOCK", 2)
    assert sorted(str(tuple(r)) for r in s.top_k(frame(spark, rows)).collect()) == want


def test_fewer_rows_than_k_and_large_components(spark):
    from ledgerlens.llm.vector_search import top_k

    rows = [(0, [1e9, -3e8]), (1, [2e9, 1e9]), (2, [1e300, 1.0]), (3, [-0.0001, 5e-324])]
    assert sorted(str(tuple(r)) for r in top_k(frame(spark, rows)).collect()) == brute(rows)


def test_empty_table_and_no_query(spark):
    from ledgerlens.llm.vector_search import top_k

    assert top_k(frame(spark, [])).count() == 0
    assert top_k(frame(spark, [(1, [1.0]), (2, [2.0])])).count() == 0
    assert top_k(frame(spark, [(100, [1.0])])).count() == 0
