"""Few heavy partial matches go to the edges; the table of all edges is not shuffled to meet them."""

from __future__ import annotations

import pytest

from echotrail.operators import pattern as P

from .test_heavy_matches import _edges


@pytest.fixture
def small_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")  # bytes: under the size of the edges, over that of the heavy matches
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(found) -> str:
    return found._jdf.queryExecution().sparkPlan().toString()


def test_edges_stay_where_they_are(spark, small_broadcasts):
    whole = P.save(P.bounded_edges(P.save(_edges(spark, 3000), "edges")), "bounded")
    other = whole.select(*[P.F.col(c).alias(c if c == "src" else f"o_{c}") for c in whole.columns])
    assert "SortMergeJoin" in _plan(whole.join(other, "src"))
    first = whole.filter("w = 3")
    found = P.heavy_matches(whole, P.TRIANGLE, (0, 1), first, 5.0)
    assert "BroadcastHashJoin" in _plan(found) and "SortMergeJoin" not in _plan(found)
    want = P.matches(whole.select("src", "dst", "w"), P.TRIANGLE, all_images=True).filter("score >= 5")
    assert {tuple(sorted(r[:3])) for r in found.collect()} == {tuple(sorted(r[:3])) for r in want.collect()} and found.count()


def test_a_beam_meets_its_own_nodes_edges_alone(spark, small_broadcasts):
    whole = P.save(P.bounded_edges(P.save(_edges(spark, 3000), "edges")), "bounded")
    found = P.heavy_matches(whole, P.TRIANGLE, (0, 1), whole.orderBy(P.F.desc("w"), "src", "dst").limit(4), None, True, 4)
    assert "LeftSemi" in _plan(found)
    assert found.count()
