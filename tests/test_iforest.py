from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import iforest as f

SCHEMA = "account_id long, transaction_id string, amount_abs double, dow int, hour int, category_encoded int, days_since_prev double"


def rows(accounts, seed=3):
    rng = np.random.default_rng(seed)
    return [(a, f"{a}-{i}", float(rng.integers(1, 500)), int(rng.integers(7)), int(rng.integers(24)), int(rng.integers(4)), float(rng.random()))
            for a, n in accounts.items() for i in range(n)]


def scores(df):
    return sorted((r.account_id, r.transaction_id, r.raw_score) for r in df.collect())


def test_small_keys_score_as_keys_in_buckets(spark, monkeypatch):
    feats = spark.createDataFrame(rows({1: 5, 2: 1, 3: 40, 4: 400}), SCHEMA).repartition(3)
    whole = scores(f.iforest_scores(feats, ["account_id"]))
    monkeypatch.setattr(f, "ROWS_PER_BUCKET", 30)  # accounts 3 and 4 go the way of large keys
    assert len(whole) == 446 and whole == scores(f.iforest_scores(feats, ["account_id"]))


def test_a_small_key_is_one_group_of_its_rows():
    """Its rows enter once, whatever the number of trees, and no node leaves the call."""
    pdf = pd.DataFrame(rows({7: 30}), columns=[x.split()[0] for x in SCHEMA.split(", ")])
    out = f._grow_and_score_fn(["account_id"], 100, 256, 42)(pdf.assign(picks=None))
    sample = pd.concat([pdf.assign(tree_id=np.int32(t)) for t in range(100)])
    want = f._score_fn(["account_id"])(pdf, f._build_fn(["account_id"], 256, 42)(sample))
    assert len(out) == 30 and out["raw_score"].tolist() == pytest.approx(want["raw_score"].tolist(), abs=0)
    none = f._grow_and_score_fn(["account_id"], 100, 256, 42)(pdf.assign(picks=[np.zeros(0, int)] * 30))
    assert none["raw_score"].tolist() == [0.0] * 30
