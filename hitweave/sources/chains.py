"""Chains of records of differing length in an array, followed by numpy."""

from __future__ import annotations

import numpy as np


def followed(jump: np.ndarray, start: int, end: int, hops: int = 6) -> np.ndarray:
    """The places ``start``, ``jump[start]``, ``jump[jump[start]]``, ... below ``end``. ``jump`` rises and is its own value from ``end`` on.

    Every ``2 ** hops``-th place is found one after another by a table of that many jumps; from all these the places between are followed together.
    """
    far = jump
    for _ in range(hops):
        far = far[far]
    heads, at = [], start
    while at < end:
        heads.append(at)
        at = int(far[at])
    lanes = np.empty((1 << hops, len(heads)), jump.dtype)
    lanes[0] = heads
    for k in range(1, 1 << hops):
        lanes[k] = jump[lanes[k - 1]]
    found = lanes.T.ravel()
    return found[found < end]


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``count[i]`` of them, for every i, end to end."""
    upto = np.cumsum(count)
    return np.repeat(first - upto + count, count) + np.arange(int(upto[-1]) if len(upto) else 0)
