"""The registered Cartesian shortlist on a sparse graph, against all tuples."""

from __future__ import annotations

import itertools

from echotrail.operators import shortlist as L
from echotrail.plans import index_queries as Q

LINKS = [(40, 41), (41, 42), (43, 42), (50, 51), (51, 5), (2, 90), (90, 3), (7, 8)]


def _brute(n: int, exemplars: list[int], limit: int) -> list[tuple]:
    lists = [{x: r for r, x in enumerate(sorted(range(1, n + 1), key=lambda x: (abs(x - e), x)))} for e in exemplars]
    linked = {p for a, b in LINKS for p in ((a, b), (b, a))}
    nodes = sorted({x for p in LINKS for x in p})
    found = []
    for t in itertools.permutations(nodes, len(exemplars)):
        if all(any((x, y) in linked for y in t) for x in t):
            ranks = [one[x] for one, x in zip(lists, t, strict=True)]
            mask = sum(1 << (len(t) - 1 - i) for i, r in enumerate(ranks) if r == max(ranks))
            score = sum(1 / (1 + abs(x - e)) for x, e in zip(t, exemplars, strict=True)) / len(t)
            found.append((max(ranks), mask, *ranks, t, round(score, 6)))
    return [x[-2:] for x in sorted(found)[:limit]]


def _frames(spark, n: int):
    return spark.createDataFrame([(i, [float(i)]) for i in range(1, n + 1)], "id long, vector array<double>"), spark.createDataFrame(LINKS, "src long, dst long")


def test_tuples_past_the_first_ranks_are_found(spark, monkeypatch):
    vectors, edges = _frames(spark, 100)
    monkeypatch.setattr(Q, "_user_vectors", lambda *_: vectors)
    monkeypatch.setattr(Q, "event_edges", lambda *_: edges)
    got = [((r.n_0, r.n_1, r.n_2), round(r.score, 6)) for r in Q.cartesian_shortlist(spark, "").collect()]
    assert got == _brute(100, [1, 2, 3], 10) and len(got) == 10


def test_four_roles_may_be_two_pairs(spark):
    vectors, edges = _frames(spark, 100)
    got = [((r.n_0, r.n_1, r.n_2, r.n_3), round(r.score, 6)) for r in L.cartesian_shortlist(vectors, edges, [1, 2, 3, 4], 100, 25).collect()]
    assert got == _brute(100, [1, 2, 3, 4], 25)


def test_product_is_made_in_order_and_only_as_far(spark):
    """Lists of different lengths, one empty, and the first 100 of 10^12 tuples."""
    from pyspark.sql import functions as F

    for sizes in ([5], [3, 4], [2, 5, 3], [1, 1, 4], [3, 0], [4, 4, 4]):
        want = sorted(
            itertools.product(*[range(s) for s in sizes]),
            key=lambda t: (max(t), sum(1 << (len(t) - 1 - i) for i, r in enumerate(t) if r == max(t)), t),
        )
        for n in (1, 7, 1000):
            got = L.product_ranks(spark, sizes, n).orderBy("place").collect()
            assert [tuple(r)[1:] for r in got] == want[:n] and [r.place for r in got] == list(range(len(want[:n])))
    lists = [spark.range(1000).select(F.concat(F.lit(f"{k}:"), F.col("id")).alias("item"), F.col("id").cast("int").alias("rank")) for k in range(4)]
    assert L.product_ranks(spark, [1000] * 4, 100).count() == 100
    rows = L.prioritized_product(lists, 100).collect()
    want = sorted(itertools.product(range(4), repeat=4), key=lambda t: (max(t), sum(8 >> i for i, r in enumerate(t) if r == max(t)), t))[:100]
    assert [(r.rank_0, r.rank_1, r.rank_2, r.rank_3) for r in rows] == want and [r.place for r in rows] == list(range(100))
    assert all(r.item_2 == f"2:{r.rank_2}" for r in rows)
