"""Distances by fragments, routes, diameter by bounds and neighbourhood estimates, against searches in one process."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest

from echotrail.operators import graphs as G


def _graph(seed: int, nodes: int, edges: int, top: int = 9) -> dict[tuple[int, int], int]:
    rng = random.Random(seed)
    out = {}
    for _ in range(edges):
        a, b = rng.sample(range(nodes), 2)
        out[a, b] = out[b, a] = rng.randint(1, top)
    return out


def _far(weight: dict[tuple[int, int], int], source: int, hops: bool = False) -> dict[int, int]:
    near = defaultdict(list)
    for (a, b), w in weight.items():
        near[a].append((b, 1 if hops else w))
    found, heap = {}, [(0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in found:
            found[v] = d
            for to, w in near[v]:
                heapq.heappush(heap, (d + w, to))
    return found


def _frame(spark, weight):
    return spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src long, dst long, w long")


@pytest.mark.parametrize("fragments, hub", [(1, 10**6), (5, 10**6), (3, 2)])
def test_distances_do_not_depend_on_fragments(spark, monkeypatch, fragments, hub):
    """Also where most nodes count as hubs; sources that are not in the graph reach themselves alone."""
    monkeypatch.setattr(G, "HUB", hub)
    monkeypatch.setattr(G, "SOURCES_OF_A_TASK", 2)
    monkeypatch.setattr(G, "EDGES_AT_ONCE", 7)
    weight = _graph(3, 60, 110)
    sources = [0, 7, 19, 999]
    got = {(r.source, r.node): r.distance for r in G.shortest_paths(_frame(spark, weight), spark.createDataFrame([(s,) for s in sources], "node long"), fragments=fragments).collect()}
    assert got == {(s, v): d for s in sources for v, d in _far(weight, s).items()}


def test_paths_have_no_cap_on_hops(spark):
    """A chain of 1,000 nodes: distances, the route, and the diameter from few searches."""
    n = 1000
    weight = {(a, b): 1 for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))}
    edges = _frame(spark, weight)
    far = G.save(G.shortest_paths(edges, spark.createDataFrame([(0,)], "node long")), "far")
    assert {r.node: r.distance for r in far.collect()} == {i: i for i in range(n)}
    before = G.predecessors(edges, far)
    found = G.routes(before, spark.createDataFrame([(0, 999), (0, 0), (0, 5555)], "source long, target long")).collect()
    assert sorted((r.target, r.place, r.node) for r in found) == [(0, 0, 0)] + [(999, i, i) for i in range(n)]
    row = G.diameter(edges).first()
    assert row.diameter == 999 and row.searched <= 100
    with pytest.raises(RuntimeError):
        G.shortest_paths(edges, spark.createDataFrame([(0,)], "node long"), max_rounds=1, fragments=8)


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_are_shortest_and_go_by_the_least_node(spark, seed):
    weight = _graph(seed, 25, 45, top=3)
    edges, far = _frame(spark, weight), _far(weight, 0)
    distances = G.save(G.shortest_paths(edges, spark.createDataFrame([(0,)], "node long")), "far")
    before = G.predecessors(edges, distances)
    rows = before.collect()
    for r in rows:
        entered = [a for (a, b), w in weight.items() if b == r.node and a in far and far[a] + w == far[r.node]]
        assert r.distance == far[r.node] and r.previous == (min(entered) if entered else None)
    previous, want = {r.node: r.previous for r in rows}, set()
    for v in far:
        way = [v]
        while previous[way[-1]] is not None:
            way.append(previous[way[-1]])
        want |= {(v, place, node) for place, node in enumerate(reversed(way))}
    found = G.routes(before, before.selectExpr("source", "node as target")).collect()
    assert {(r.target, r.place, r.node) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("nodes, edges, weighted", [(40, 60, True), (40, 30, False), (30, 200, True)])
def test_diameter_is_that_of_all_pairs(spark, nodes, edges, weighted):
    """Several components; a dense graph whose bounds are loose."""
    weight = _graph(nodes + edges, nodes, edges)
    want = max(max(_far(weight, s, not weighted).values()) for s, _ in weight)
    row = G.diameter(_frame(spark, weight), weighted).first()
    assert row.diameter == want and row.searched <= len({s for s, _ in weight})


def test_diameter_of_one_way_edges(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 2, 1)], "src long, dst long, w long")
    assert G.diameter(edges).first().diameter == 3


def test_estimates_are_within_ten_percent(spark):
    """95 of 100 within 10 %, at every distance; the seed alone decides the ranks."""
    weight = _graph(11, 1500, 3000, top=1)
    edges = _frame(spark, weight)
    exact = {}
    nodes = sorted({a for a, _ in weight})
    for v in nodes[::5]:
        hops = np.array(list(_far(weight, v, True).values()))
        exact |= {(v, d): int((hops <= d).sum()) for d in range(1, 5)}
    got = {(r.node, r.distance): r.within for r in G.neighbourhood_estimates(edges, 4).collect()}
    assert len(got) == 4 * len(nodes)
    for d in range(1, 5):
        off = np.array([abs(got[k] / n - 1) for k, n in exact.items() if k[1] == d])
        assert np.quantile(off, 0.95) < 0.125 and off.mean() < 0.06
    few = edges.filter("src < 40 and dst < 40")
    again = [sorted((r.node, r.distance, r.within) for r in G.neighbourhood_estimates(few.repartition(n), 2, ranks=8, seed=s).collect()) for n, s in ((1, 1), (3, 1), (3, 2))]
    assert again[0] == again[1] != again[2]


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long, w long")
    assert G.diameter(none).first().diameter is None and G.neighbourhood_estimates(none, 2).count() == 0
    assert G.connected_components(none).count() == 0
    assert [tuple(r) for r in G.shortest_paths(none, spark.createDataFrame([(1,)], "node long")).collect()] == [(1, 1, 0.0)]
