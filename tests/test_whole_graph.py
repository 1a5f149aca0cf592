"""Graph queries over the whole event graph, light edges too, against brute force on a small events table."""

from __future__ import annotations

import datetime as dt
import itertools
from collections import Counter, deque

import pytest

from echotrail.operators import graphs as G
from echotrail.operators import pattern as P
from echotrail.plans import catalog, feature_queries

#: Users of successive events; 7-8-9 hang on by single transactions, 5 and 6 by two.
VISITS = [1, 2, 1, 2, 1, 2, 3, 2, 3, 2, 3, 4, 3, 4, 1, 4, 5, 4, 5, 6, 5, 6, 1, 7, 8, 9, 7]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("events")
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), u, "click" if i % 3 else "view", 1.0) for i, u in enumerate(VISITS)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{at}/events.parquet")
    weight = Counter(frozenset(p) for p in itertools.pairwise(VISITS))
    return str(at), {(a, b): w for e, w in weight.items() for a, b in itertools.permutations(e)}


def _hops(edges: dict, start: int) -> dict[int, int]:
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for a, b in edges:
            if a == x and b not in seen:
                seen[b] = seen[x] + 1
                queue.append(b)
    return seen


@pytest.mark.parametrize(
    ("name", "pattern", "least"),
    [("pattern_star_topk", P.STAR, 3), ("pattern_square_topk", P.SQUARE, 2), ("pattern_path4_topk", P.PATH4, 3), ("pattern_edge_distinct_path4", P.PATH4, 3)],
)
def test_patterns_use_light_edges(spark, small, name, pattern, least):
    path, edges = small
    distinct = name == "pattern_edge_distinct_path4"
    found = []
    for nodes in itertools.product(sorted({a for a, _ in edges}), repeat=pattern.roles):
        used = [(nodes[i], nodes[j]) for i, j in pattern.edges]
        apart = len({frozenset(e) for e in used}) == len(used) if distinct else len(set(nodes)) == len(nodes) and all(nodes[i] < nodes[j] for i, j in pattern.order_constraints())
        if apart and all(e in edges for e in used):
            found.append((-sum(edges[e] for e in used), *nodes))
    assert any(edges[nodes[i], nodes[j]] < least for _, *nodes in sorted(found)[:10] for i, j in pattern.edges)
    got = [(-r.score, *[r[f"n_{i}"] for i in range(pattern.roles)]) for r in catalog.QUERIES[name](spark, path).collect()]
    assert sorted(got) == sorted(found)[:10]


def test_components_distances_and_sizes_use_light_edges(spark, small):
    path, edges = small
    nodes = sorted({a for a, _ in edges})
    run = lambda name: catalog.QUERIES[name](spark, path).collect()
    hops = {x: _hops(edges, x) for x in nodes}
    assert {r.node: r.component for r in run("connected_components")} == {x: min(hops[x]) for x in nodes}
    far = {nodes[0]: 0}
    for _ in nodes:
        for (a, b), w in edges.items():
            if a in far:
                far[b] = min(far.get(b, 10**9), far[a] + w)
    assert {r.node: r.distance for r in run("shortest_paths")} == far
    assert run("graph_diameter")[0].diameter == max(max(h.values()) for h in hops.values())
    sizes = Counter((x, d) for x in nodes for d in hops[x].values() if d)
    assert {(r.node, r.distance): r.n for r in run("neighbourhood_sizes")} == dict(sizes)


def test_node_sets_use_light_edges(spark, small):
    path, edges = small
    found = []
    for nodes in itertools.permutations(sorted({a for a, _ in edges}), 4):
        used = [(nodes[i], nodes[j]) for i, j in P.SQUARE.edges]
        if all(e in edges for e in used):
            found.append((-sum(edges[e] for e in used), *nodes))
    best: dict = {}
    for minus, *nodes in sorted(found)[:1000]:
        own = (-minus, *nodes)
        best[frozenset(nodes)] = min(best.get(frozenset(nodes), own), own)
    got = {frozenset((r.n_0, r.n_1, r.n_2, r.n_3)): (r.score, r.n_0, r.n_1, r.n_2, r.n_3) for r in catalog.QUERIES["pattern_dedup_nodeset"](spark, path).collect()}
    assert got == best and got


def test_distances_by_blocks_and_within_reach(spark, small):
    path, edges = small
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, w long")
    hops = {x: _hops(edges, x) for x in {a for a, _ in edges}}
    for at_once in (2, 100):
        assert G.diameter(frame, at_once=at_once).first().diameter == max(max(h.values()) for h in hops.values())
        sizes = Counter((x, d) for x, h in hops.items() for d in h.values() if 0 < d <= 2)
        assert {(r.node, r.distance): r.n for r in G.neighbourhood_sizes(frame, 2, at_once).collect()} == dict(sizes)
    assert G.diameter(frame.limit(0)).first().diameter is None and G.neighbourhood_sizes(frame.limit(0)).count() == 0


def test_activity_counts_all_event_types(spark, small, monkeypatch):
    path, _ = small
    pairs = [(a, b) for a, b in itertools.pairwise(VISITS) if a != b]
    counts = Counter(x for p in pairs for x in p)
    least = 10
    monkeypatch.setattr(feature_queries, "ACTIVE", least)
    active = {x for x, n in counts.items() if n >= least}
    assert {r.user: r.n for r in catalog.QUERIES["active_users_bag"](spark, path).collect()} == {x: counts[x] for x in active} and active
    assert {tuple(r) for r in catalog.QUERIES["active_user_pairs"](spark, path).collect()} == {(a, b) for a, b in pairs if a in active and b in active}
