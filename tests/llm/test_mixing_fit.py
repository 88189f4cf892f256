"""The fitted rates against their targets, repeated ids and edge rows."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerlens.llm import mixing
from ledgerlens.llm.mixing import TOLERANCE, fit_rates, labelled_sample, mix_to_targets, replay

SCORED = "mix_tokens long, mix_domains array<double>"


def posteriors(spark, rows=300, k=3):
    rng = np.random.default_rng(4)
    n, p = rng.integers(1, 200, rows), rng.dirichlet(np.full(k, 0.4), rows)
    return n.astype(float), p, spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], SCORED).repartition(4)


def test_reachable_targets_are_met(spark):
    n, p, scored = posteriors(spark)
    want = (n @ p) * np.array([0.4, 1.0, 1.7])
    hist, scale, step, missed = fit_rates(scored, want)
    x = replay(p, hist, scale, step)[0]
    assert missed < TOLERANCE and (x >= 0).all() and np.allclose((n * x) @ p, want, rtol=2e-3)


def test_a_fit_that_ends_short_says_so(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_ITERATIONS", 3)
    n, p, scored = posteriors(spark)
    want = (n @ p) * np.array([0.02, 1.0, 1.0])
    hist, scale, step, missed = fit_rates(scored, want)
    sums = (n * replay(p, hist, scale, step)[1]) @ p
    assert len(hist) == 3 and missed > TOLERANCE and np.isclose(missed, np.abs(sums / want - 1).max())


def test_a_repeated_id_has_one_domain(spark):
    rows = [(1, "b", "x y"), (1, "a", "x y"), (2, None, None), (3, "a", ""), (None, "a", "t"), (4, "b", "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "doc_id long, quality int")
    for parts in (1, 4):
        got = [(i, d) for i, d, _ in labelled_sample(docs.repartition(parts), labels)]
        assert got == [(1, "a/q1"), (2, "none/q1"), (3, "a/q1"), (4, "b/q1")]


@pytest.mark.parametrize("empty", [True, False])
def test_rows_pass_through(spark, empty):
    rows = [] if empty else [(1, "a", "one two"), (1, "a", "one two"), (None, None, None), (2, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "7 as mix_residual")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = mix_to_targets(docs, labels).collect()
    assert len(got) == len(rows) and all(r.mix_rate >= 0 and r.mix_residual != 7 for r in got)
