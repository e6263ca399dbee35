"""The filter on parity sketches: it loses no alike sets and lets few others through."""

import numpy as np

from riskspark.llm.neardup import _may_link, brief_sketch, folded, own_sketch


def _passes(rng, size, common):
    """Whether two sets of ``size`` members with ``common`` shared ones pass at a similarity of 0.8."""
    members = rng.integers(1, 2**63, 2 * size - common, dtype=np.uint64)
    a, b = np.sort(members[:size]), np.sort(members[size - common :])
    n = np.array([size])
    one, two = folded([np.frombuffer(own_sketch(x), np.uint64) for x in (a, b)])
    return bool(_may_link(n, n, one[None], two[None], 8, 10)[0])


def test_sets_a_little_less_alike_than_asked_for_are_told_apart():
    rng = np.random.default_rng(5)
    for size in (360, 540, 900, 1800):
        assert all(_passes(rng, size, -(-8 * size // 9)) for _ in range(20))  # 0.8 or a little more
        assert sum(_passes(rng, size, round(2 * size * 0.765 / 1.765)) for _ in range(20)) <= 4


def test_groups_hold_brief_sketches_that_lose_no_alike_sets():
    """A node is in many groups, so there its sketch has two bits a member at most, or 16 bytes."""
    rng = np.random.default_rng(7)
    for size in (1, 20, 64, 65, 500, 4000):
        members = rng.integers(1, 2**63, 2 * size, dtype=np.uint64)
        a, b = np.sort(members[:size]), np.sort(members[size - -(-8 * size // 9) :][:size])
        short = [brief_sketch(own_sketch(x)) for x in (a, b)]
        assert all(len(x) <= max(16, 2 * size / 8) for x in short)
        n = np.array([size])
        one, two = folded([np.frombuffer(x, np.uint64) for x in short])
        assert _may_link(n, n, one[None], two[None], 8, 10)[0]
