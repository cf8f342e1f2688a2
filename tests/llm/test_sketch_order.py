"""The odd sketch orders pairs and drops none."""

import numpy as np
from pagewright.llm import near_dup


def test_pairs_far_apart_by_sketch_are_still_compared():
    sketch = np.zeros((2, (near_dup.SKETCH_BITS + near_dup.SET_BITS) // 64), np.uint64)
    sketch[1, :2] = np.uint64(2**64 - 1)  # 128 flips: far beyond what most pairs at 0.8 have
    rows = (sketch, np.array([1, 2]), np.array([100, 90]))
    for nearest in (None, 2):
        found = list(near_dup.close_pairs(rows, rows, percent=80, same=True, nearest=nearest))
        assert (0, 1) in [(int(i), int(j)) for i, j in found]
    sketch[1, -1] = np.uint64(2**64 - 1)  # 64 members apart: no link of these sizes
    assert not list(near_dup.close_pairs(rows, rows, percent=80, same=True, nearest=None))
