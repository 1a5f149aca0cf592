"""What the triangles' tables hold: each edge once, no column that nothing reads, and compact files."""

from __future__ import annotations

import datetime as dt
import random

from echotrail.operators import order, pattern
from echotrail.operators import marginal as M
from echotrail.operators import pattern as P
from echotrail.plans import behaviour_queries as B
from echotrail.plans import graph_queries as G
from echotrail.plans import views as V


def _written(monkeypatch):
    """The tables that ``save`` writes from here on, by name."""
    own, written = P.save, {}

    def save(df, name):
        written[name] = own(df, name)
        return written[name]

    for module in (order, pattern, B, G):
        monkeypatch.setattr(module, "save", save)
    return written


def _events(spark, path):
    rng = random.Random(4)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), rng.randrange(1, 25), "view", float(i % 7)) for i in range(900)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")


def test_edges_are_written_in_one_direction(spark, tmp_path, monkeypatch):
    _events(spark, tmp_path)
    written = _written(monkeypatch)
    transactions = V.txn_event(spark, str(tmp_path))
    got = [tuple(r)[:4] for r in B.top_triangles(transactions).orderBy("match").collect()]
    graph = M.marginal_graph(transactions)
    assert got == [tuple(r) for r in P.top_matches(M.symmetric_edges(graph), P.TRIANGLE, G.TOP).collect()] and len(got) == G.TOP
    assert written["bounded"].count() == written["edges"].count() == graph.count()
    assert "event_type" not in written["ranges"].columns
    assert all(f.endswith(".zstd.parquet") for f in written["edges"].inputFiles())


def test_loops_and_bounds_come_back(spark):
    """Both directions come back from one, a loop once."""
    pairs = [(1, 2, 5), (2, 3, 4), (1, 3, 2), (3, 4, 9), (2, 4, 1)]
    edges = spark.createDataFrame([(x, y, w) for a, b, w in pairs for x, y in ((a, b), (b, a))] + [(3, 3, 7)], "src long, dst long, w long")
    types = spark.createDataFrame([(n, 1 + n % 2) for n in range(1, 5)], "node long, type int")
    for of in (None, types):
        whole = P.bounded_edges(edges, of)
        columns = ["src", "dst", "w", "d_src", "t_src", "d_dst", "t_dst", "h_src", "h_dst"]
        back = P.both_directions(whole.filter("src <= dst"))
        assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
