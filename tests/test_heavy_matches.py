"""Top matches where nearly all edges weigh the same: only those around heavy edges are made."""

from __future__ import annotations

import pytest

from echotrail.operators import pattern as P


def _edges(spark, nodes=300, degree=30):
    weight = {}
    for a in range(nodes):
        for s in range(1, degree // 2 + 1):
            b = (a + s * s) % nodes
            if a != b:
                weight[min(a, b), max(a, b)] = 1
    for a, b in list(weight)[::700]:  # far under a hundredth of them
        weight[a, b] = 3
    return spark.createDataFrame([(x, y, w) for (a, b), w in weight.items() for x, y in ((a, b), (b, a))], "src long, dst long, w long")


@pytest.mark.parametrize("pattern", [P.PATH4, P.SQUARE, P.TRIANGLE])
def test_light_edges_are_not_joined_with_each_other(spark, pattern):
    edges, trace = P.save(_edges(spark), "edges"), []
    got = P.top_matches_bounded(edges, pattern, 3, trace=trace).collect()
    assert got == P.top_matches(edges, pattern, 3).collect() == P.top_matches_in_batches(edges, pattern, 3).collect()
    assert max(t.count() for t in trace) * 5 < edges.count() * 30


def test_anchors_stand_for_all_edges():
    assert P.anchors(P.SQUARE) == [(0, 1)] and P.anchors(P.PATH4) == [(0, 1), (1, 2)] and P.anchors(P.STAR) == [(0, 1)]
    assert P.anchors(P.Pattern(P.TRIANGLE.edges, (1, 2, 2))) == [(0, 1), (1, 2)]
