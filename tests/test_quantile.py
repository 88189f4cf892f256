"""Exact distributed quantile against numpy (linear interpolation)."""

from __future__ import annotations

import collections

import numpy as np

from ledgerlens.operators.common import exact_quantile


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in [(1, 1), (2, 2), (3, 7), (4, 1000), (5, 20000)]:
        vals = rng.normal(size=n).round(2) if k != 4 else np.repeat([1.0, 2.0, 3.0], [500, 300, 200])
        rows += [(k, float(v)) for v in vals]
    df = spark.createDataFrame(rows, "k INT, v DOUBLE")
    by = collections.defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    for q in (0.5, 0.95, 0.0, 1.0):
        # small accuracy so the sketch-bracket path runs on the large key
        got = {r["k"]: r["quantile"] for r in exact_quantile(df, ["k"], "v", q, accuracy=100).collect()}
        for k, vs in by.items():
            exp = float(np.percentile(vs, q * 100))
            assert got[k] is not None and abs(got[k] - exp) <= 1e-12 * max(1.0, abs(exp)), (q, k)
    g = exact_quantile(df, [], "v", 0.95, accuracy=100).collect()[0]["quantile"]
    assert abs(g - float(np.percentile([v for _, v in rows], 95))) < 1e-12


def test_buckets_of_the_bracket_give_the_same_quantile(spark):
    rng = np.random.default_rng(2)
    groups = {1: np.exp(rng.normal(0, 3, 3000)), 2: np.concatenate([np.zeros(900), rng.normal(size=900)]), 3: np.array([-1.7e308, 0.0, 1.0, 1.7e308]),
              4: np.array([5.0] * 50), 5: rng.integers(0, 3, 500).astype(float), 6: np.array([1.0, np.nextafter(1.0, 2.0)])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(7, None)], "k INT, v DOUBLE").repartition(5)
    for q, accuracy, buckets in ((0.5, 20, 3), (0.95, 20, 1), (0.37, 5, 4096), (0.999, 100, 2)):
        got = {r["k"]: r["quantile"] for r in exact_quantile(df, ["k"], "v", q, accuracy=accuracy, buckets=buckets).collect()}
        want = {}
        for k, vs in groups.items():
            s, pos = np.sort(vs), (len(vs) - 1) * q
            lo, hi = s[int(np.floor(pos))], s[int(np.ceil(pos))]
            with np.errstate(over="ignore"):
                want[k] = lo + (hi - lo) * (pos - np.floor(pos))
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == want[k] or abs(got[k] - want[k]) <= 1e-12 * abs(want[k]), (k, q, got[k], want[k])


def test_no_window_holds_a_key(spark):
    df = spark.createDataFrame([(1, 1.0)], "k INT, v DOUBLE")
    plan = exact_quantile(df, ["k"], "v", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [ln for ln in plan.splitlines() if "Window [" in ln]
    assert len(windows) == 2 and all("_ll_bucket" in ln for ln in windows)
