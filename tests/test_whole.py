"""Graphs that tasks hold whole: hop counts by bits or by pairs, sizes and diameters, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from echotrail.functions import reach as R
from echotrail.operators import graphs as G


def _hops(edges, start: int) -> dict[int, int]:
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    seen, front = {start: 0}, [start]
    while front:
        front = [b for a in front for b in after.get(a, []) if b not in seen and seen.setdefault(b, seen[a] + 1)]
    return seen


@pytest.mark.parametrize("seed", range(12))
def test_hops_by_bits_and_by_pairs(seed, monkeypatch):
    rng = random.Random(seed)
    for name, values in {"PAIRS": (3, 50, 1 << 20), "KEPT": (0, 1, 8), "PAIR_COST": (0, 1, 64, 10**9), "ROWS": (2, 5, 4096), "ASKED": (0, 2, 8)}.items():
        monkeypatch.setattr(R, name, rng.choice(values))
    n = rng.choice([5, 40, 90, 200])
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([n // 2, n, 3 * n, 8 * n]))}
    edges |= {(i, i + 1) for i in range(n - 1)} if seed % 3 == 0 else set()
    edges |= {(b, a) for a, b in edges} if seed % 2 == 0 else set()
    held = R.Held(n, *(np.array([e[i] for e in sorted(edges)], dtype=np.int32) for i in (0, 1)), seed % 2 == 0)
    targets = sorted(rng.sample(range(n), rng.choice([1, n // 2, n])))
    far = {x: _hops(edges, x) for x in range(n)}
    want = Counter((x, far[x][t]) for x in far for t in targets if far[x].get(t))
    for reach in (None, 2):
        got = {(x, d + 1): int(c[x]) for d, c in enumerate(held.hops(np.array(targets, dtype=np.int32), reach)) for x in np.flatnonzero(c)}
        assert got == {k: v for k, v in want.items() if reach is None or k[1] <= reach}
    assert {x: int(d) for x, d in enumerate(held.depths(targets[0])) if d >= 0} == far[targets[0]]


def _never(*_):
    raise AssertionError("hop by hop")


@pytest.mark.parametrize("both", [True, False])
def test_sizes_in_tasks_and_hop_by_hop(spark, monkeypatch, both):
    rng = random.Random(8)
    half = {(rng.randrange(70) * 10**12, rng.randrange(70) * 10**12) for _ in range(150)}
    edges = half | ({(b, a) for a, b in half} if both else set())
    frame = spark.createDataFrame(list(edges), "src long, dst long")
    want = Counter((x, d) for x in {a for a, _ in edges} for d in _hops(edges, x).values() if 0 < d <= 4)
    sizes = lambda: {(r.node, r.distance): r.n for r in G.neighbourhood_sizes(frame, 4).collect()}
    with monkeypatch.context() as m:
        m.setattr(G, "hop_counts", _never)
        assert sizes() == dict(want)
    monkeypatch.setattr(G, "HELD_EDGES", 0)
    assert sizes() == dict(want)


def test_diameters_in_tasks(spark, monkeypatch):
    """A shallow graph, and a ring with tails that is too deep for bits: one search by fragments."""
    rng = random.Random(9)
    shallow = {(a, b) for a in range(50) for b in rng.sample(range(50), 3) if a != b} | {(100, 101)}
    ring = {(i, (i + 1) % 60) for i in range(60)} | {(7, 70), (70, 71), (30, 80)}
    calls, distances = [], G.Fragments.distances
    monkeypatch.setattr(G.Fragments, "distances", lambda self, *a: calls.append(1) or distances(self, *a))
    monkeypatch.setattr(G, "hop_counts", _never)
    for half in (shallow, ring):
        edges = half | {(b, a) for a, b in half}
        calls.clear()
        found = G.diameter(spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, w long")).first()
        assert found.diameter == max(max(_hops(edges, x).values()) for x, _ in edges) and len(calls) == 1
