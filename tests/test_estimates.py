"""Least ranks over a graph's hops, against the ranks of all nodes within them, with blocks and batches of any size."""

from __future__ import annotations

import math
import random
import time

import pytest

from echotrail.operators import graphs as G


@pytest.mark.parametrize(("at_once", "sources", "gathered", "batch"), [(1 << 23, 1024, 1 << 21, 10_000), (40, 8, 30, 7), (50, 3, 8, 2)])
def test_estimates_are_those_of_all_ranks_within_reach(spark, monkeypatch, at_once, sources, gathered, batch):
    monkeypatch.setattr(G, "_SOURCES", sources)
    monkeypatch.setattr(G, "ESTIMATED_EDGES", at_once)
    monkeypatch.setattr(G, "_GATHERED", gathered)
    rng = random.Random(4)
    links = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)} | {(0, x) for x in range(20, 50)} | {(x, 1) for x in range(5, 45)}  # hubs, loops, one way
    links = sorted((a * 7 - 100, b * 7 - 100) for a, b in links)
    everyone = sorted({x for p in links for x in p})
    frame = spark.createDataFrame(links + [(None, 5), (5, None)], "src long, dst long")
    own = {r.node: list(r.ranks) for r in G.node_ranks(spark.createDataFrame([(x,) for x in everyone], "node long"), 10, 1).collect()}
    near = {x: {x} for x in everyone}
    want = {}
    for d in range(1, 6):
        near = {x: near[x].union(*[near[b] for a, b in links if a == x]) for x in everyone}
        for x in everyone:
            least = [min(own[y][i] for y in near[x]) for i in range(10)]
            want[x, d] = 9 / sum(-math.log(1 - (r + 0.5) / 2**31) for r in least)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.node, r.distance): r.within for r in G.neighbourhood_estimates(frame, 5, 10).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == pytest.approx(want, rel=1e-9) and len(got) == 5 * len(everyone)


def _shuffled(spark) -> dict[int, int]:
    """Bytes that each stage so far has shuffled."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {(x := stages.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(stages.size())}


def test_ranks_sent_do_not_grow_with_the_tasks(spark):
    links = spark.createDataFrame([(a, b) for a in range(60) for b in range(60) if a != b], "src long, dst long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    sent = {}
    try:
        for n in (4, 32):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            seen = _shuffled(spark)
            assert G.neighbourhood_estimates(links, 1).count() == 60
            time.sleep(1)  # the listener's figures come late
            sent[n] = sum(b for s, b in _shuffled(spark).items() if s not in seen)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sent[32] < 2 * sent[4]
