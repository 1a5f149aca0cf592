"""Hop counts by bits, and diameters of shallow graphs, against brute force."""

from __future__ import annotations

import random
from collections import Counter

from echotrail.operators import graphs as G


def _hops(edges: set, start: int) -> dict[int, int]:
    seen, front = {start: 0}, [start]
    while front:
        front = [b for a in front for x, b in edges if x == a and b not in seen and seen.setdefault(b, seen[a] + 1)]
    return seen


def test_counts_of_one_way_edges_over_several_words(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(90), rng.randrange(90)) for _ in range(200)} | {(200, 201), (7, 7)}
    frame = spark.createDataFrame(list(edges) * 2, "src long, dst long")
    want = Counter((x, d) for x in {a for a, _ in edges} for d in _hops(edges, x).values() if 0 < d <= 3)
    for at_once in (30, None):
        assert {(r.node, r.distance): r.n for r in G.neighbourhood_sizes(frame, 3, at_once).collect()} == dict(want)


def test_shallow_graph_is_searched_once_by_fragments(spark, monkeypatch):
    rng = random.Random(5)
    half = {(a, b) for a in range(60) for b in rng.sample(range(60), 4) if a != b}
    edges = half | {(b, a) for a, b in half} | {(100, 101), (101, 100)}
    calls, distances = [], G.Fragments.distances
    monkeypatch.setattr(G.Fragments, "distances", lambda self, *a: calls.append(1) or distances(self, *a))
    frame = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, w long")
    for at_once in (7, None):
        calls.clear()
        assert G.diameter(frame, at_once=at_once).first().diameter == max(max(_hops(edges, x).values()) for x in {a for a, _ in edges})
        assert len(calls) == 1
