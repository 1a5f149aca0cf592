"""Searches by an example of which one entity is linked with no other, against their SQL."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import duckdb
import pytest

from echotrail.operators import pattern as P
from echotrail.plans import catalog


@pytest.mark.parametrize(("pair", "names"), [((1, 2), ("search_by_example", "search_by_example_hmm")), ((1, 3), ("search_by_example",)), ((2, 3), ("search_by_example",))])
def test_an_unlinked_exemplar_is_any_node(spark, tmp_path, pair, names):
    rng, at = random.Random(11), [pair[0], pair[1], 9]
    while len(at) < 160:
        x = rng.choice([u for u in range(1, 14) if u != at[-1] and not (u < 4 and at[-1] < 4)])
        at.append(x)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), u, "click", float(1 + i % 7)) for i, u in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select event_id, ts::timestamp as ts, user_id, event_type, value from '{tmp_path}/events.parquet/*.parquet'")
    for name in names:
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(catalog.ORACLES[name]).fetchall())


@pytest.mark.parametrize("users", [range(1, 3), range(1, 14), range(4, 30)])
def test_exemplars_without_any_link_are_any_nodes(spark, tmp_path, users):
    """Of two users (1 and 2, linked), too few for a tuple; of users whose first three are not linked; and without the exemplars."""
    rng, at = random.Random(7), [users[-1]]
    while len(at) < 200:
        at.append(rng.choice([u for u in users if u != at[-1] and not (len(users) > 2 and u < 4 and at[-1] < 4)]))
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), u, "click", float(1 + i % 7)) for i, u in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select event_id, ts::timestamp as ts, user_id, event_type, value from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("search_by_example", "search_by_example_hmm"):
        got, want = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.ORACLES[name])
        assert got.columns == [c[0] for c in want.description] and [tuple(r) for r in got.collect()] == want.fetchall()


def test_first_tuples_are_those_of_the_whole_product(spark):
    nodes = [2, 3, 5, 8, 13, 21, 34]
    edges = spark.createDataFrame([(a, b, 1) for a, b in zip(nodes, nodes[1:] + nodes[:1], strict=True)], "src long, dst long, w long")
    for roles in (2, 3, 4):
        every = [t for t in itertools.permutations(nodes, roles) if t[0] < t[1]]
        for k in (1, 4, 17, 1000):
            assert [tuple(r)[:-1] for r in P.first_tuples(edges, roles, k).orderBy(*[f"n_{i}" for i in range(roles)]).collect()] == every[:k]


def test_more_first_nodes_are_looked_at_until_there_are_enough(spark):
    edges = spark.createDataFrame([(a, b, w) for x, y, w in [(8, 9, 5), (7, 9, 4), (1, 2, 3), (3, 4, 3)] for a, b in ((x, y), (y, x))], "src long, dst long, w long")
    weights, nodes = {(r.src, r.dst): r.w for r in edges.collect()}, [1, 2, 3, 4, 7, 8, 9]
    every = sorted((-w, x, y, z) for (x, y), w in weights.items() for z in nodes if z not in (x, y) and x < z)
    for k in (3, 7, 100):
        found = P.top_matches_with_free(edges, [(0, 1)], 3, k, 1).collect()
        assert sorted((-r.score, r.n_0, r.n_1, r.n_2) for r in found) == every[:k]
