"""Suffix arrays by difference cover (Kärkkäinen and Sanders' skew algorithm).

Vectorised: the sampled triples (positions 1 and 2 modulo 3) are sorted and
named, names that are not yet distinct are sorted by recursion, the remaining
suffixes are sorted by their first symbol and the rank behind it, and the two
orders are merged by counting, for each remaining suffix, the sampled ones
before it.
"""

from __future__ import annotations

import numpy as np

_LIMIT = 2**62


def _packed(high: np.ndarray, low: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    """high * base + low, with ``high`` renamed to dense ranks where it would overflow."""
    top = int(high.max(initial=0)) + 1
    if top * base >= _LIMIT:
        high = np.unique(high, return_inverse=True)[1].astype(np.int64)
        top = int(high.max(initial=0)) + 1
    return high * base + low, top * base


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The start positions of all suffixes of ``symbols`` (integers > 0), in order."""
    s = np.asarray(symbols, dtype=np.int64)
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    p = np.concatenate((s, np.zeros(3, dtype=np.int64)))
    top = int(s.max()) + 1
    # a triple at n, all padding, ends the part of positions 1 modulo 3 where n is 1 modulo 3
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sampled = np.concatenate((one, two))
    key, base = _packed(p[sampled], p[sampled + 1], top)
    key, _ = _packed(key, p[sampled + 2], top)
    order = np.argsort(key, kind="stable")
    lead = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    names = np.empty(len(sampled), dtype=np.int64)
    names[order] = np.cumsum(lead)
    if not lead.all():
        order = suffix_array(names)
    sampled_order = sampled[order]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sampled_order] = np.arange(1, len(order) + 1)

    zero = np.arange(0, n, 3)
    width = len(order) + 2
    zero = zero[np.argsort(_packed(p[zero], rank[zero + 1], width)[0], kind="stable")]
    sampled_order = sampled_order[sampled_order < n]
    first = sampled_order[sampled_order % 3 == 1]
    second = sampled_order[sampled_order % 3 == 2]
    before = np.searchsorted(p[first] * width + rank[first + 1], p[zero] * width + rank[zero + 1])
    pair, _ = _packed(np.concatenate((p[second], p[zero])), np.concatenate((p[second + 1], p[zero + 1])), top)
    full, _ = _packed(pair, np.concatenate((rank[second + 2], rank[zero + 2])), width)
    before = before + np.searchsorted(full[: len(second)], full[len(second) :])

    out = np.empty(n, dtype=np.int64)
    at = np.arange(len(zero)) + before
    taken = np.zeros(n, dtype=bool)
    taken[at] = True
    out[at] = zero
    out[~taken] = sampled_order
    return out


def equal_prefix_classes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For windows at ``starts`` in suffix order: the number of each one's class.

    Neighbours with the same first ``width`` bytes are of one class. The last
    bytes are compared first: neighbours in suffix order differ late.
    """
    same = np.arange(1, len(starts))
    windows = np.lib.stride_tricks.sliding_window_view(data, 20)
    for at in range(width - 20, -20, -20):
        at = max(at, 0)
        kept = []
        for block in np.array_split(same, 1 + len(same) // 200_000):
            kept.append(block[(windows[starts[block] + at] == windows[starts[block - 1] + at]).all(axis=1)])
        same = np.concatenate(kept)
    lead = np.ones(len(starts), dtype=np.int64)
    lead[same] = 0
    return np.cumsum(lead)
