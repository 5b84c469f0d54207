"""Patience alignment of stretches that have no line once in both documents."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from glucoflow.llm import linededup


def best_alignment(a: list[int], b: list[int]) -> tuple[int, int]:
    """Most matches, and the fewest blocks (negative) with that many, over all alignments."""
    top = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    ends = [[None] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            if x == y:
                n, c = top[i - 1][j - 1]
                ends[i][j] = n + 1, c - 1
                if ends[i - 1][j - 1]:
                    n, c = ends[i - 1][j - 1]
                    ends[i][j] = max(ends[i][j], (n + 1, c))
            top[i][j] = max(top[i - 1][j], top[i][j - 1], ends[i][j] or (0, 0))
    return top[-1][-1]


def blocks(m: list[tuple[int, int]]) -> int:
    return sum(k == 0 or (i - 1, j - 1) != m[k - 1] for k, (i, j) in enumerate(m))


@settings(deadline=None, max_examples=400)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_longest_common(a, b):
    m = linededup.longest_common(a, b)
    assert all(a[i] == b[j] for i, j in m)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert (len(m), -blocks(m)) == best_alignment(a, b)


def test_passage_held_twice():
    """a = X P Y P Z, b = Q P R and the reverse: one copy of P is deleted, whole."""
    p = [1, 2, 3, 4]
    twice, once = [10, *p, 11, *p, 12], [20, *p, 21]
    assert linededup.common_blocks(twice, once, [3] * len(once)) == [1, 2, 3, 4]
    gone = linededup.common_blocks(once, twice, [3] * len(twice))
    assert gone in ([1, 2, 3, 4], [6, 7, 8, 9])
    assert linededup.common_blocks(twice, [30, *p, 31, *p, 32], [3] * 11) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_long_stretches():
    rng = random.Random(1)
    a, b = [rng.randrange(6) for _ in range(700)], [rng.randrange(6) for _ in range(900)]
    m = linededup.longest_common(a, b)
    assert (len(m), -blocks(m)) == best_alignment(a, b)
