"""The matcher against enumeration on small random graphs, and pattern planning."""

from __future__ import annotations

import random
from itertools import permutations, product

import pytest

from echotrail.operators import pattern as P
from echotrail.operators import signatures as S


def _graph(seed: int, nodes: int = 8, share: float = 0.5, top: int = 3):
    rng = random.Random(seed)
    weight = {(a, b): rng.randint(1, top) for a in range(nodes) for b in range(a + 1, nodes) if rng.random() < share}
    return weight, {n: rng.randint(1, 2) for n in range(nodes)}


def _frames(spark, weight, types):
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()] + [(b, a, w) for (a, b), w in weight.items()], "src long, dst long, w long")
    return edges, spark.createDataFrame(list(types.items()), "node long, type int")


def _enumerate(weight, types, pattern, injective):
    """All assignments by definition: typed, injective or else edge-distinct."""
    nodes, out = sorted(types), []
    edge = lambda x, y: weight.get((min(x, y), max(x, y)))
    for t in permutations(nodes, pattern.roles) if injective else product(nodes, repeat=pattern.roles):
        used = [frozenset((t[i], t[j])) for i, j in pattern.edges]
        if any(len(u) < 2 or edge(*u) is None for u in used) or len(set(used)) < len(used):
            continue
        if pattern.types and any(types[n] != k for n, k in zip(t, pattern.types, strict=True)):
            continue
        out.append((*t, sum(edge(*u) for u in used)))
    return out


def _one_of_each(found, pattern):
    group = pattern.automorphisms()
    return {min((*[m[p[i]] for i in range(pattern.roles)], m[-1]) for p in group) for m in found}


PATTERNS = [P.EDGE, P.PATH3, P.PATH4, P.STAR, P.TRIANGLE, P.SQUARE, P.Pattern(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))), P.Pattern(((0, 1), (1, 2), (0, 2), (2, 3)))]


@pytest.mark.parametrize("pattern", PATTERNS, ids=lambda p: str(p.edges))
def test_matches_are_all_there(spark, pattern):
    weight, types = _graph(len(pattern.edges) * 7 + pattern.roles)
    edges, _ = _frames(spark, weight, types)
    want = _enumerate(weight, types, pattern, True)
    every = [tuple(r) for r in P.matches(edges, pattern, all_images=True).collect()]
    assert sorted(every) == sorted(want)
    single = [tuple(r) for r in P.matches(edges, pattern).collect()]
    assert len(single) == len(_one_of_each(want, pattern)) and _one_of_each(single, pattern) == _one_of_each(want, pattern)


@pytest.mark.parametrize("pattern", [P.PATH4, P.SQUARE, P.STAR], ids=lambda p: str(p.edges))
def test_edge_distinct_matches(spark, pattern):
    weight, types = _graph(3, 6)
    found = P.matches(_frames(spark, weight, types)[0], pattern, injective=False, all_images=True)
    assert sorted(tuple(r) for r in found.collect()) == sorted(_enumerate(weight, types, pattern, False))


@pytest.mark.parametrize("types_of", [(1, 2, 2), (1, 1, 2), (2, 1, 2)])
def test_typed_matches(spark, types_of):
    weight, types = _graph(11, 9, 0.7)
    pattern = P.Pattern(P.TRIANGLE.edges, types_of)
    edges, frame = _frames(spark, weight, types)
    assert sorted(tuple(r) for r in P.matches(edges, pattern, frame, all_images=True).collect()) == sorted(_enumerate(weight, types, pattern, True))


def test_top_k_with_ties_and_in_batches(spark):
    weight, types = _graph(5, 10, 0.6, 2)
    edges, _ = _frames(spark, weight, types)
    every = sorted((tuple(r) for r in P.matches(edges, P.TRIANGLE).collect()), key=lambda m: (-m[-1], m[:-1]))
    assert [tuple(r) for r in P.top_matches(edges, P.TRIANGLE, 7).collect()] == every[:7]
    assert [tuple(r) for r in P.top_matches_in_batches(edges, P.TRIANGLE, 7).collect()] == every[:7]
    assert P.top_matches_in_batches(edges.filter("w > 99"), P.TRIANGLE, 7).count() == 0


def test_one_match_for_each_node_set(spark):
    weight, types = _graph(6, 7, 0.8)
    edges, _ = _frames(spark, weight, types)
    images = P.matches(edges, P.SQUARE, all_images=True)
    best = {r.node_set: r.score for r in P.one_per_node_set(images).collect()}
    want: dict[str, int] = {}
    for m in _enumerate(weight, types, P.SQUARE, True):
        key = "#".join(map(str, sorted(m[:-1])))
        want[key] = min(want.get(key, 10**9), m[-1])
    assert best == want
    high = {r.node_set: r.score for r in P.one_per_node_set(images, "max").collect()}
    assert all(high[k] >= v for k, v in best.items())


def test_pattern_of_exemplars(spark):
    graph = spark.createDataFrame([(1, 2), (2, 5), (7, 9)], "a long, b long")
    pattern, nodes = P.pattern_of(spark, graph, [5, 1, 2, 40])
    assert nodes == [1, 2, 5] and pattern.edges == ((0, 1), (1, 2))
    assert P.pattern_of(spark, graph, [1, 5]) is None and P.pattern_of(spark, graph, [1]) is None
    first = P.with_query_first(spark.createDataFrame([(3, 4, 5, 1)], "n_0 long, n_1 long, n_2 long, score long"), nodes).collect()
    assert first[0].score == float("inf") and len(first) == 2


def test_containment_never_loses_a_match(spark):
    """Sound for one type and injective matches: filtering by neighbourhood changes nothing."""
    weight, _ = _graph(21, 10, 0.4)
    types = dict.fromkeys(range(10), 1)
    edges, frame = _frames(spark, weight, types)
    for pattern in (P.TRIANGLE, P.SQUARE, P.PATH4):
        own = P.Pattern(pattern.edges, (1,) * pattern.roles)
        may = S.contained_candidates(spark, S.topology_signature(S.typed_paths(edges, frame, 2)), frame, own, 2)
        allowed = {(r.role, r.node) for r in may.collect()}
        assert all((i, n) in allowed for m in _enumerate(weight, types, own, True) for i, n in enumerate(m[:-1]))


def test_typed_paths_are_shortest(spark):
    weight, types = _graph(4, 9, 0.3)
    edges, frame = _frames(spark, weight, types)
    near = {n: {b if a == n else a for a, b in weight if n in (a, b)} for n in types}
    want = {}
    edge = lambda x, y: weight[min(x, y), max(x, y)]
    for n in types:
        for m in near[n]:
            want[n, 1, (types[m],), m] = edge(n, m)
            for e in near[m] - near[n] - {n}:
                key = (n, 2, (types[m], types[e]), e)
                want[key] = max(want.get(key, 0), edge(n, m) + edge(m, e))
    got = {(r.node, r.depth, tuple(r.path), r.end): r.weight for r in S.typed_paths(edges, frame, 2).collect()}
    assert got == want


def test_path_order():
    assert S.path_order(2, 2) == [(1,), (2,), (1, 1), (2, 1), (1, 2), (2, 2)]


@pytest.mark.parametrize("pattern", [P.EDGE, P.PATH3, P.TRIANGLE, P.STAR, P.SQUARE, P.PATH4, P.Pattern(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)))])
def test_bounded_search_finds_the_same(spark, pattern):
    for seed in range(2):
        weight, types = _graph(seed, nodes=9)
        edges, _ = _frames(spark, weight, types)
        for k, injective in ((4, True), (7, False), (1000, True)):
            want = P.top_matches(edges, pattern, k, None, injective).collect()
            assert P.top_matches_bounded(edges, pattern, k, None, injective).collect() == want


def test_bounded_search_with_types(spark):
    weight, types = _graph(5, nodes=10)
    edges, frame = _frames(spark, weight, types)
    for of in ((1, 1, 2), (1, 2, 2), (2, 2, 2), (1, 2, 3)):
        pattern = P.Pattern(P.TRIANGLE.edges, of)
        assert P.top_matches_bounded(edges, pattern, 5, frame).collect() == P.top_matches(edges, pattern, 5, frame).collect()


def test_bounds_drop_partial_matches(spark):
    """Far fewer partial matches than without a floor; a path closed inside a triangle, where no node is two hops off, is not lost."""
    weight = {(a, b): 1 + (a * 7 + b * 13) % 50 for a in range(40) for b in range(a + 1, 40) if (a + b) % 3}
    edges = spark.createDataFrame([(x, y, w) for (a, b), w in weight.items() for x, y in ((a, b), (b, a))], "src long, dst long, w long")
    whole = P.save(P.bounded_edges(edges), "whole")
    want = P.top_matches(edges, P.SQUARE, 5).collect()
    free, bounded = [], []
    P.bounded_matches(whole, P.SQUARE, None, trace=free)
    P.bounded_matches(whole, P.SQUARE, want[-1].score, trace=bounded)
    assert sum(x.count() for x in bounded) * 5 < sum(x.count() for x in free)
    assert P.top_matches_bounded(edges, P.SQUARE, 5).collect() == want
    small = [(0, 1, 9), (1, 2, 8), (0, 2, 7), (2, 3, 1)]
    edges = spark.createDataFrame([(x, y, w) for a, b, w in small for x, y in ((a, b), (b, a))], "src long, dst long, w long")
    got = P.top_matches_bounded(edges, P.PATH4, 3, injective=False, all_images=True).collect()
    assert got[0].score == 24 and got == P.top_matches(edges, P.PATH4, 3, None, False, True).collect()


def test_hubs_are_not_gone_through(spark):
    """Two hubs of 10^5 neighbours: the cycle-closing role comes from the short lists."""
    from pyspark.sql import functions as F

    n = 100_000
    spokes = spark.range(2, n + 2).select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("src"), F.col("id").alias("dst"))
    ring = spark.range(2, 52).select(F.col("id").alias("src"), (F.col("id") + 50).alias("dst"))
    one = spokes.union(ring).select("src", "dst", F.lit(1).alias("w"))
    whole = P.save(P.bounded_edges(one.union(one.select("dst", "src", "w"))), "whole")
    trace = []
    found = P.bounded_matches(whole, P.TRIANGLE, None, trace=trace)
    assert found.count() == 100  # each ring edge with each hub
    assert trace[1].count() < 5 * n  # through a hub's list it would be 10^10
