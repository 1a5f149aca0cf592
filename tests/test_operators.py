"""Ingest, features, shortlists, search, output, files and streams on small inputs."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrail.operators import activity as A
from echotrail.operators import features as X
from echotrail.operators import graphs as G
from echotrail.operators import ingest as I
from echotrail.operators import knn as K
from echotrail.operators import marginal as M
from echotrail.operators import observe as O
from echotrail.operators import present as H
from echotrail.operators import rescore as R
from echotrail.operators import search as Q
from echotrail.operators import shortlist as L
from echotrail.operators import spectrum
from echotrail.sources import readers, writers
from echotrail.streaming import aggregates

# A scenario of transactions. Two fan-outs with fan-in, a cycle that happens twice, and noise.
SCENARIO = """
a b 2012-10-15 12:00 5000
b a 2012-11-12 13:00 3000
a b 2013-10-15 14:00 1000
a c 2013-10-16 15:00 800
b d 2013-10-17 16:00 950
c d 2013-10-18 17:00 750
e f 2013-09-15 18:00 1200
e g 2013-09-17 19:00 1300
f h 2013-09-18 20:00 1100
g h 2013-09-20 21:00 1250
e h 2013-09-01 12:00 600
h e 2013-09-02 13:00 500
f g 2013-09-03 12:00 400
g f 2013-09-04 14:00 350
f g 2013-09-22 12:00 600
f g 2013-09-23 13:00 1000
g f 2013-09-24 15:00 800
i j 2013-08-15 12:00 1000
j k 2013-08-16 13:00 1200
k l 2013-08-17 14:00 1000
l i 2013-08-18 15:00 1300
i j 2013-08-01 12:00 1100
j k 2013-08-02 12:00 1200
k l 2013-08-03 12:00 1300
l i 2013-08-04 12:00 1400
m a 2013-07-15 12:00 200
n b 2013-07-16 12:00 300
o e 2013-07-17 12:00 200
p h 2013-07-18 12:00 400
c q 2013-07-19 12:00 300
d r 2013-07-20 12:00 200
f s 2013-07-21 12:00 100
g t 2013-07-22 12:00 500
"""


def _scenario() -> list[tuple]:
    rows = [line.split() for line in SCENARIO.strip().split("\n")]
    return [(i, ord(s) - 97, ord(t) - 97, dt.datetime.fromisoformat(f"{d} {h}"), float(v), float(v)) for i, (s, t, d, h, v) in enumerate(rows)]


@pytest.fixture(scope="module")
def scenario(spark):
    return spark.createDataFrame(_scenario(), "transid long, source long, target long, time timestamp, amount double, usd double")


def _txn(spark, rows):
    return spark.createDataFrame([(i, s, t, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(v), float(v)) for i, (s, t, h, v) in enumerate(rows)], "transid long, source long, target long, time timestamp, amount double, usd double")


def test_marginal_graph_adds_up(spark, scenario):
    for r in M.marginal_graph(scenario).collect():
        assert r.a < r.b and r.tot_usd == (r.tot_out or 0) + (r.tot_in or 0)
    one = M.marginal_graph(_txn(spark, [(1, 2, 0, 5), (1, 1, 1, 9)])).collect()
    assert [tuple(r) for r in one] == [(1, 2, 5.0, 1, 5.0, None)]


def test_equal_counts_collapse_in_a_distinct_union(spark):
    txn = _txn(spark, [(1, 2, 0, 1), (2, 1, 1, 1), (1, 3, 2, 1), (3, 1, 3, 1)])
    assert {r.user: r.n for r in A.activity(txn).collect()} == {1: 4, 2: 2, 3: 2}
    assert {r.user: r.n for r in A.activity(txn, "union_distinct").collect()} == {1: 2, 2: 1, 3: 1}


def test_fixpoint_is_one(spark):
    rng = random.Random(3)
    txn = _txn(spark, [(rng.randrange(12), rng.randrange(12), i, 1) for i in range(60)])
    left = A.activity_fixpoint(txn, 8, "bag")
    assert A.inactive_users(left, 8, "bag").isEmpty()
    assert sorted(A.activity_fixpoint(left, 8, "bag").collect()) == sorted(left.collect())


def test_rates_clamp_at_the_ends_and_miss_inside(spark):
    rates = spark.createDataFrame([(dt.date(2020, 1, 2), 2.0), (dt.date(2020, 1, 5), 5.0)], "day date, rate double")
    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 2, 3, 5, 9)], "day date")
    assert {r.day.day: r.rate for r in I.with_rate(days, rates).collect()} == {1: 2.0, 2: 2.0, 3: 0.0, 5: 5.0, 9: 5.0}


def test_deviations_cross_over(spark):
    got = {r.transid: r for r in I.deviations(_txn(spark, [(1, 2, 0, 10), (2, 1, 1, 30)])).collect()}
    # the source of 0 is user 1, who gets 30; its target is user 2, who pays 30
    assert got[0].devpop == -0.5 and got[0].creditdev == got[0].debitdev == pytest.approx((10 - 30) / 30)
    none = I.deviations(_txn(spark, [(1, 2, 0, 10)])).first()
    assert none.creditdev == none.debitdev == -1.0


def test_normaliser_sends_quantiles_to_two(spark):
    rows = spark.createDataFrame([(k, float(k), 100.0 + k, 7.0) for k in range(1, 7)], "user long, x double, y double, z double")
    got = {r.user: r for r in X.normalized(rows, ("x", "y", "z")).collect()}
    for k, r in got.items():
        assert r.x == pytest.approx((k - 3.5) / 1.1875) and r.y == pytest.approx(r.x) and r.z == 0.0
    zeros = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0)], "user long, x double")
    assert {r.user: r.x for r in X.normalized(zeros, ("x",), ignore_zeros=True).collect()}[1] == 0.0


def test_features_of_a_small_history(spark):
    got = {r.user: r for r in X.user_features(_txn(spark, [(1, 2, 0, 10), (1, 3, 24, 30), (1, 2, 96, 20)])).collect()}
    assert (got[1].debit_mean, got[1].debit_std, got[1].credit_mean, got[1].perp_in) == (-20.0, 10.0, 0.0, 1.0)
    assert got[1].debit_interarr_mean == 2.0 and got[1].debit_interarr_std == pytest.approx(np.std([1, 3], ddof=1))
    assert got[1].perp_out == pytest.approx(2 ** -(2 / 3 * np.log2(2 / 3) + 1 / 3 * np.log2(1 / 3)))
    assert (got[3].credit_std, got[3].credit_interarr_mean) == (0.0, 0.0)


def test_spectrum_is_of_the_last_window():
    signal = np.sin(np.arange(130))
    window = np.zeros(100)
    window[:30] = signal[100:]
    assert spectrum.spectrum_of(signal)[:49] == pytest.approx(np.abs(np.fft.rfft(window).real[1:50]) / 3)
    assert spectrum.spectrum_of(np.empty(0)).tolist() == [0.0] * 50


def test_nearest_is_exact_in_any_number_of_passes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = rng.integers(0, 4, (60, 3)).astype(float)  # many ties
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>").repartition(3)
    want = {i: sorted(range(60), key=lambda j: (np.linalg.norm(points[i] - points[j]), j))[:5] for i in range(0, 60, 7)}
    for most in (4096, 4):
        monkeypatch.setattr(K, "QUERIES_AT_ONCE", most)
        got: dict[int, list] = {}
        for r in K.nearest(frame, frame.filter("id % 7 = 0"), 5).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.neighbour)
        assert got == want
    assert K.nearest(frame, frame.filter("id < 0"), 5).count() == 0


def test_unknown_ids_are_unlike(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, vector array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "id1 long, id2 long")
    assert {r.id2: r.similarity for r in K.pair_similarity(frame, pairs).collect()} == {2: pytest.approx(1 / 6), 9: 0.0}


def test_product_order(spark):
    """Of two lists of three: by the highest rank, then the last list first."""
    lists = [spark.createDataFrame([(f"{x}{i}", i) for i in range(3)], "item string, rank int") for x in "ab"]
    got = [(r.item_0, r.item_1) for r in L.prioritized_product(lists).collect()]
    ranks = [(int(a[1]), int(b[1])) for a, b in got]
    assert ranks == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_beam_keeps_ties_and_the_exemplars(spark):
    vectors = spark.createDataFrame([(i, [float(i % 2)]) for i in range(8)], "id long, vector array<double>")
    edges = spark.createDataFrame([(i, j) for i in range(8) for j in range(8) if i != j], "src long, dst long")
    found = L.beam_shortlist(spark, vectors, edges, [0, 1], beam=50).collect()
    assert (0, 1) in {(r.n_0, r.n_1) for r in found} and len(found) == 50
    assert found[0].score == 2.0 and L.beam_shortlist(spark, vectors, edges, [0, 77]).count() == 0


def test_whole_graph_algorithms(spark):
    one = [(1, 2, 4), (2, 3, 1), (1, 3, 9), (10, 11, 1)]
    edges = spark.createDataFrame(one + [(b, a, w) for a, b, w in one], "src long, dst long, w long")
    assert {r.node: r.component for r in G.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10}
    far = {r.node: r.distance for r in G.shortest_paths(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert far == {1: 0.0, 2: 4.0, 3: 5.0}
    assert G.diameter(edges, True).first().diameter == 5.0 and G.diameter(edges).first().diameter == 1.0
    assert {(r.node, r.distance): r.n for r in G.neighbourhood_sizes(edges).collect()}[1, 1] == 2
    less = G.without_edges(edges, spark.createDataFrame([(2, 1)], "src long, dst long"))
    assert less.count() == 6 and G.with_edges(less, spark.createDataFrame([(1, 2, 7)], "src long, dst long, w long")).count() == 8
    made = G.random_graph(spark, 20, 50, 3)
    assert sorted(made.collect()) == sorted(G.random_graph(spark, 20, 50, 3).collect()) and made.filter("src = dst").isEmpty()


def _matches(spark, *nodes):
    return spark.createDataFrame([(i, *n) for i, n in enumerate(nodes)], "match long, " + ", ".join(f"n_{k} long" for k in range(len(nodes[0]))))


def test_observations_of_a_fan(spark, scenario):
    """a -> b, c -> d in October 2013: two buckets of two, and the net flows of each pair."""
    fan = _matches(spark, (0, 1, 2, 3))
    links = O.match_links(scenario.filter("time >= '2013-10-01'"), fan)
    got = O.observations(links, 4).orderBy("bucket").collect()
    assert [(r.n, r.f0) for r in got] == [(2, 1.0), (2, 1.0)]
    late = O.observations(links, 4, since="transaction").orderBy("bucket").collect()
    assert late[1].f1 == pytest.approx(25 / 25)
    assert got[0].f1 == 0.0 and got[1].f1 == pytest.approx(50 / 25)  # 50 h from bucket to bucket, 25 h long
    assert (got[0].flow_0_1, got[0].flow_0_2, got[1].flow_1_3, got[1].flow_2_3) == (1000.0, 800.0, 950.0, 750.0)


def test_aggregate_and_phase_links(spark, scenario):
    links = O.match_links(scenario, _matches(spark, (4, 5, 6, 7)))
    flows = {(r.role_a, r.role_b): r for r in O.aggregate_links(links).collect()}
    assert flows[0, 3].out_flow == 600.0 and flows[0, 3].in_flow == 500.0 and flows[0, 3].net_flow == 100.0 and flows[1, 2].num_edges == 5
    states = spark.createDataFrame([(0, 1.0, 0, [1, 1, 2, 2, 3, 3])], "match long, score double, start int, states array<int>")
    phases = R.phase_links(links, states).collect()
    assert {r.phase for r in phases} == {0, 1, 2} and sum(r.num_edges for r in phases) == links.count()


def test_rescoring_ranks_the_similar_first(spark, scenario):
    """The query is the first fan; the second fan is more like it than the cycle."""
    groups = _matches(spark, (0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11))
    seen = O.observations(O.match_links(scenario.filter("time >= '2013-08-01'"), groups), 4)
    scores = {r.match: r.score for r in R.rescore(seen, 0).collect()}
    assert scores[0] == pytest.approx(1.0) and scores[1] > scores[2]
    assert R.rescore(seen, 99).count() == 0


def test_external_scores(spark):
    found = R.external_scores(spark.createDataFrame([(0, 5, 9.0), (1, 6, 8.0)], "match long, n_0 long, score double"), spark.createDataFrame([(1, 0.25)], "index long, score double"))
    assert {r.match: r.score for r in found.collect()} == {0: 0.0, 1: 0.25}


def test_sessions_split_at_gaps(spark):
    got = O.sessions(_txn(spark, [(1, 2, 0, 1), (1, 3, 1, 1), (1, 2, 9, 1)]), 2 * 3600 * 1000).orderBy("transid").collect()
    assert [r.session for r in got] == [0, 0, 1]


def test_links_in_a_range_and_a_limit(spark, scenario):
    ids = spark.createDataFrame([(x,) for x in range(4)], "id long")
    october = O.links_among(scenario, ids, dt.datetime(2013, 10, 1), dt.datetime(2013, 11, 1)).collect()
    assert len(october) == 4
    assert O.links_among(scenario, ids, limit=1).filter("source = 0 and target = 1").count() == 1


def test_flows(spark, scenario):
    own = spark.createDataFrame([(4,)], "entity long")
    out = O.flow_aggregation(scenario, own, direction="out").collect()
    assert {r.counterpart: r.usd for r in out} == {5: 1200.0, 6: 1300.0, 7: 600.0}
    focus = spark.createDataFrame([(7,)], "entity long")
    both = O.flow_aggregation(scenario, own, focus).collect()
    assert {(r.direction, r.usd) for r in both} == {("out", 600.0), ("in", 500.0)}
    assert {r.transid for r in O.one_hop(scenario, own.withColumnRenamed("entity", "id")).collect()} == {r[0] for r in _scenario() if 4 in r[1:3]}
    one = O.accounts(scenario, own).first()
    assert (one.n, one.counterparts, one.incoming, one.outgoing) == (5, 4, 700.0, 3100.0)
    assert {r.key: r.value for r in O.data_summary(scenario).collect()}["links"] == "33"
    bins = O.time_series(scenario, own, "2013-09-01", 3, 10).orderBy("bin").collect()
    assert [(r.incoming, r.outgoing) for r in bins] == [(500.0, 600.0), (0.0, 2500.0), (0.0, 0.0)]


def _dataset(spark):
    people = spark.createDataFrame([(1, "Ann", "Rome", None), (2, "Bob", "Oslo", 2.5)], "id long, name string, place string, rate double")
    teams = spark.createDataFrame([(7, "Romans"), (8, "Vikings")], "id long, name string")
    return Q.Dataset([Q.EntityTable("people", people, "id", "l", "Lender"), Q.EntityTable("teams", teams, "id", "t", "Team")], {"NAME": ["name"]}, [Q.ForeignLink("people", "teams", "m", "person", "team")])


def test_property_search(spark):
    data = _dataset(spark)
    found = lambda *p, **o: sorted(r.uid for r in Q.property_search(data, list(p), **o).collect())
    assert found(Q.Property("NAME", "Rom", Q.REQUIRED_PARTIAL)) == ["t7"]
    assert found(Q.Property("place", "Rome"), Q.Property("name", "Bob", Q.NOT)) == ["l1", "t7", "t8"]
    assert found(Q.Property("place", "Rome", Q.OPTIONAL_EQUALS), Q.Property("place", "Os", Q.PARTIAL_OPTIONAL)) == ["l1", "l2"]
    assert found(Q.Property("name", "", Q.PARTIAL_OPTIONAL), limit=1, start=1) == ["l2", "t8"]
    with pytest.raises(ValueError):
        found(Q.Property("SHAPE", "x"))
    with pytest.raises(ValueError):
        found(Q.Property("nothing", "x"))
    ranked = Q.ranked_search(data, [Q.Property("name", "Ann"), Q.Property("place", "Rome")], 5).collect()
    assert [(r.uid, r.score) for r in ranked] == [("l1", 1.0)]


def test_entities(spark):
    data = _dataset(spark)
    assert {(r._table, r.uid) for r in Q.entities_by_id(data, ["l2", "t7", "x1"]).collect()} == {("people", "l2"), ("teams", "t7"), (None, "x1")}
    rows = {(r.uid, r.key): (r.value, r.type) for r in Q.properties_of(data.tables[0]).collect()}
    assert rows["l1", "rate"] == ("null", "DOUBLE") and rows["l1", "TYPE"] == ("Lender", "STRING")
    links = spark.createDataFrame([(1, 8)], "person long, team long")
    assert [tuple(r) for r in Q.linked_entities(data, data.links[0], links).collect()] == [("l1", "t8")]


def test_search_by_example(spark, scenario):
    """A fan of four has the other fan among its matches; the query comes first."""
    found = Q.search_by_example(scenario, [0, 1, 2, 3], max_results=5).collect()
    assert found[0].score == float("inf") and (found[0].n_0, found[0].n_3) == (0, 3)
    assert {4, 5, 6, 7} in [{r.n_0, r.n_1, r.n_2, r.n_3} for r in found]
    assert Q.search_by_example(scenario, [12, 13]).count() == 0
    timed = Q.search_by_example(scenario, [0, 1, 2, 3], hmm=True, start_time=dt.datetime(2013, 8, 1)).collect()
    assert timed[0].score == pytest.approx(1.0)
    with pytest.raises(ValueError):
        Q.search_by_example(scenario, [1])
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id long, vector array<double>")
    assert [r.n_0 for r in Q.search_by_example(scenario, [2], vectors=vectors, max_results=3).collect()] == [2, 1, 3]


def test_output(spark, scenario):
    groups = _matches(spark, (4, 5, 6, 7)).withColumn("score", F.lit(1.0))
    links = O.match_links(scenario, groups)
    flows = O.aggregate_links(links)
    states = spark.createDataFrame([(0, 1.0, 0, [1, 1, 2, 2, 3, 3])], "match long, score double, start int, states array<int>")
    drawn = json.loads(H.sankey(groups, flows, R.phase_links(links, states)).first().json)
    assert [n["name"] for n in drawn["nodes"]] == ["4", "5", "6", "7"] and len(drawn["links"]) == 4
    assert all(len(step) == len(drawn["links"][0]) for step in drawn["links"]) and all(x["value"] >= 0 for step in drawn["links"] for x in step)
    document = json.loads(H.sankey_document([(1, '{"nodes":[],"links":[]}'), (0, json.dumps(drawn))]))
    assert document["query"] == drawn and len(document["results"]) == 1
    result = json.loads(H.results_json(groups, flows).first().json)
    assert result["entities"][1] == {"role": "E1", "uid": "5"} and len(result["links"]) == flows.count()
    assert H.short_name("x" * 20) == "x" * 15 + "..." and "null" in H.entity_table([(1.0, "5", {"a": None, "b": "<"})])
    assert H.exemplars_of(H.exemplar_query(["x", "y"])) == ["x", "y"] and H.text_table([{"score": 1.0, "n_0": 4}]) == "1.0\tE0:4"
    assert {r.direction for r in H.time_plot_rows(links).collect()} == {"up", "down"}


def test_files(spark, tmp_path, scenario):
    (tmp_path / "t.txt").write_text("1 25 26 2013-01-27 22:41:38 9.5\n2\t3 4 2013-01-28 00:00:00 1 extra\nbad line\n")
    rows = readers.read_transactions(spark, str(tmp_path / "t.txt")).orderBy("transid").collect()
    assert [(r.transid, r.source, r.amount, r.malformed) for r in rows] == [(1, 25, 9.5, False), (2, 3, 1.0, True)]
    (tmp_path / "r.txt").write_text("7/17/2010 0.05\r12/1/2010\t0.2\r")
    assert [(r.day.isoformat(), r.rate) for r in readers.read_rates(spark, str(tmp_path / "r.txt")).collect()] == [("2010-07-17", 0.05), ("2010-12-01", 0.2)]
    schema = readers.parse_schema("teams:category: [String]\nteams:image:id: [Integer]\nitems[]:at:: [Date]\n")
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [("teams_category", "string"), ("teams_image_id", "int"), ("items_at", "timestamp")]
    (tmp_path / "k.tsv").write_text("x\t\t2010-01-02 03:04:05 +0000\n")
    row = readers.read_tsv(spark, str(tmp_path / "k.tsv"), schema).first()
    assert row.teams_category == "x" and row.teams_image_id is None and row.items_at == dt.datetime(2010, 1, 2, 3, 4, 5)
    (tmp_path / "g.txt").write_text("#Nodes 3\n1#2#5\n2\t3\n")
    assert sorted(tuple(r) for r in readers.read_graph(spark, str(tmp_path / "g.txt")).collect()) == [(1, 2, 5.0), (2, 1, 5.0), (2, 3, 1.0), (3, 2, 1.0)]
    (tmp_path / "y.txt").write_text("1\t2\n#c\n2\t1\n")
    assert readers.read_types(spark, str(tmp_path / "y.txt")).count() == 2
    pattern, nodes = readers.read_pattern(spark, str(tmp_path / "g.txt"))
    assert pattern.edges == ((0, 1), (1, 2)) and nodes == [1, 2, 3] and not readers.table_exists(spark, "nothing_here")
    (tmp_path / "f.tsv").write_text("id\ta\tb\np1\t0.5\t1\n")
    assert list(readers.read_features(spark, str(tmp_path / "f.tsv")).first().vector) == [0.5, 1.0]
    writers.write_transactions(scenario, str(tmp_path / "txn"))
    assert spark.read.parquet(str(tmp_path / "txn")).count() == scenario.count()
    edges = M.symmetric_edges(M.marginal_graph(scenario))
    writers.write_graph(edges, str(tmp_path / "graph"))
    assert readers.read_graph(spark, str(tmp_path / "graph")).count() == edges.count()
    writers.write_index(edges.withColumn("t1", F.lit(1)), str(tmp_path / "index"), "t1")
    assert readers.read_index(spark, str(tmp_path / "index")).count() == edges.count()
    back = writers.from_json(writers.to_json(edges), edges.schema)
    assert sorted(back.collect()) == sorted(edges.collect())
    users = X.user_features(scenario)
    writers.write_features(users, str(tmp_path / "users"))
    assert readers.read_features(spark, str(tmp_path / "users")).count() == users.count()
    pairs = M.connected_pairs(scenario)
    assert sorted(M.unpack_pairs(M.pack_pairs(pairs)).collect()) == sorted(pairs.collect())
    assert readers.h2_url("/d", "x").startswith("jdbc:h2:file:/d/x") and readers.mysql_url("x") == "jdbc:mysql://localhost:3306/x"


def test_database_round_trip(spark):
    """Written in batches, read in ranges whose bounds the database gives; filter and columns are pushed to it."""
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:tests;create=true"
    rows = spark.range(3, 1003).select("id", (F.col("id") % 7).alias("k"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("x"))
    writers.write_jdbc(rows.repartition(3), url, "things", batch=64)
    assert readers.jdbc_bounds(spark, url, "things", "id") == (3, 1002)
    back = readers.read_jdbc_ranges(spark, url, "things", "id", parts=8)
    assert back.rdd.getNumPartitions() == 8 and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    few = back.filter("k = 3 and x > 100").select("name")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "GreaterThan(x,100.0)" in plan and "ReadSchema: struct<name:string>" in plan
    assert sorted(r.name for r in few.collect()) == sorted(r.name for r in rows.filter("k = 3 and x > 100").collect())
    writers.write_jdbc(rows.limit(0), url, "things")
    assert readers.jdbc_bounds(spark, url, "things", "id") is None and readers.read_jdbc_ranges(spark, url, "things", "id").count() == 0


def test_streams_add_up_to_the_batch(spark, tmp_path, scenario):
    path = str(tmp_path / "in")
    scenario.repartition(1).write.parquet(path)
    stream = aggregates.windowed_marginal_graph(spark.readStream.schema(scenario.schema).parquet(path), "30 days", "3650 days")
    running = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    got = {(r.a, r.b): r.tot_usd for r in aggregates.merged_graph(spark.table("windows")).collect()}
    assert got == {(r.a, r.b): r.tot_usd for r in M.marginal_graph(scenario).collect()}
    flows = aggregates.windowed_flows(spark.readStream.schema(scenario.schema).parquet(path), "3650 days", "3650 days")
    running = flows.writeStream.format("memory").queryName("flows").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert spark.table("flows").agg(F.sum("outgoing")).first()[0] == sum(r[5] for r in _scenario())
