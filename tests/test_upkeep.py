"""Path indices after edges come and go, against a rebuild."""

from __future__ import annotations

import random

import pytest

from echotrail.operators import signatures as S


def _edges(spark, weight):
    return spark.createDataFrame([(x, y, w) for (a, b), w in weight.items() for x, y in ((a, b), (b, a))], "src long, dst long, w long")


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_updated_paths_are_those_of_a_rebuild(spark, depth):
    """On a ring with chords few nodes are touched; edges go, come, and change their weight."""
    rng, n = random.Random(depth), 80
    weight = {(i, (i + 1) % n): rng.randint(1, 5) for i in range(n)} | {(i, i + 7): 2 for i in range(0, 40, 10)}
    after = dict(weight)
    del after[10, 11]
    after[50, 55] = 3
    after[20, 27] = 9
    types = spark.createDataFrame([(i, i % 3 + 1) for i in range(n)], "node long, type int")
    old, new = _edges(spark, weight), _edges(spark, after)
    paths = S.save(S.typed_paths(old, types, depth), "paths")
    got, touched = S.updated_paths(paths, old, new, types, depth)
    plain = lambda df: sorted((r.node, r.depth, tuple(r.path), r.end, r.weight) for r in df.collect())
    assert plain(got) == plain(S.typed_paths(new, types, depth))
    assert {10, 11, 50, 55, 20, 27} <= {r.node for r in touched.collect()} and touched.count() <= 6 + 22 * (depth - 1)


def test_an_unchanged_graph_touches_nothing(spark):
    edges = _edges(spark, {(0, 1): 1, (1, 2): 2})
    types = spark.createDataFrame([(i, 1) for i in range(3)], "node long, type int")
    assert S.affected_nodes(edges, edges, 2).count() == 0
    none = edges.limit(0)
    got, touched = S.updated_paths(S.save(S.typed_paths(edges, types), "paths"), edges, none, types)
    assert got.count() == 0 and touched.count() == 3
