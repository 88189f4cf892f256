from __future__ import annotations

import numpy as np
import pytest

from ledgerlens.llm import quality_lm as q


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_places_are_those_of_a_binary_search(n):
    rng = np.random.default_rng(n)
    keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
    keys[-1] = np.uint64(2**64 - 1)
    near = np.sort(np.concatenate([keys, keys[0] + np.arange(1, 20, dtype=np.uint64), keys[:1]]))  # many in one slot, one twice
    for k in (keys, near):
        h = rng.permutation(np.repeat(k, 2))
        assert (q.places(k, *q.first_places(k), h) == np.searchsorted(k, h)).all()
    assert len(q.places(keys[:0], *q.first_places(keys[:0]), keys[:0])) == 0
