"""The packed path index against the counted typed paths."""

from __future__ import annotations

from echotrail.operators import signatures as S
from tests.test_matcher import _frames, _graph


def test_index_is_that_of_the_paths(spark, monkeypatch):
    weight, types = _graph(4, 40, 0.1, 5)
    edges, frame = _frames(spark, weight, types)
    paths = S.typed_paths(edges, frame, 2)
    plain = lambda df: sorted((r.node, r.depth, tuple(r.path), r.n_end, r.max_weight) for r in df.collect())
    want = plain(S.topology_signature(paths).join(S.spd_index(paths), ["node", "depth", "path"]))
    assert plain(S.path_index(edges, frame)) == want
    monkeypatch.setattr(S, "LIST", 2)  # several lists a node
    assert plain(S.path_index(edges, frame, tasks=1)) == want
    assert plain(S.path_index(edges, frame, frame.filter("node < 5").select("node"))) == [w for w in want if w[0] < 5]
