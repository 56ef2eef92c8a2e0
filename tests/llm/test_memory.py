"""Memory that one step of a task takes at the largest size it may meet."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from medialake.llm import neardup
from medialake.llm.texts import PART, slices


def _peak(step) -> float:
    """MB that ``step`` takes at most, besides what was there."""
    tracemalloc.start()
    try:
        step()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_near_copies_that_meet_in_two_full_blocks():
    n = 2 * neardup.BLOCK
    rng = np.random.default_rng(3)
    words = rng.integers(1, 1 << 62, 24)
    alike = pa.table({
        "node": np.arange(n), "label": np.arange(n), "n_shingles": np.full(n, 24), "set": [words] * n,
        "__sketch": [np.full(neardup.BITS // 64, 7)] * n, "__bands": [np.arange(neardup.BANDS)] * n})
    # all pairs are alike and share band 0, so band 1 has to look at all of them and leaves them to band 0
    found = []
    assert _peak(lambda: found.append(neardup.links_within(alike, 85, 1))) < 48
    assert len(found[0][0]) == 0
    a, b = neardup.links_within(alike.slice(0, 700), 85, 0)
    assert len(a) == 699 and len(np.union1d(a, b)) == 700


def test_signatures_of_many_short_texts():
    column = pa.array([f"the small bird number {i} sings in the tree" for i in range(PART)])
    (t,) = slices(column)
    neardup.signatures(t, 3)
    got = []
    assert _peak(lambda: got.append(neardup.signatures(t, 3))) < 40
    some = [neardup.signatures(s, 3) for s in slices(column, 1000)]  # runs change nothing
    for k, axis in ((0, 0), (1, 1), (2, 0), (3, 0)):
        assert np.array_equal(got[0][k], np.concatenate([s[k] for s in some], axis))
