"""Whole-graph algorithms: components, distances and routes, diameter, neighbourhood sizes, test graphs.

Distances are found fragment by fragment: a task holds the edges of some nodes
and follows paths inside them to their end, so that a round of the job covers
as many hops as stay inside, and the number of rounds is that of the fragments
a path goes through. Nodes with very many edges are in no fragment; theirs are
relaxed by a plain join. Rounds go on until nothing gets lower.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reach as R
from ..sources.work import Rounds, folder, save

#: Edges of a fragment on average, edges from which on a node is in none, and sources that a task follows at once.
FRAGMENT, HUB, SOURCES_OF_A_TASK = 100_000, 50_000, 64
#: Edges that a task relaxes at once.
EDGES_AT_ONCE = 1 << 20


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component): the least node reachable over ``edges(src, dst)`` in any direction.

    Each round a node takes its neighbours' least label, then that label's own
    label (pointer jumping), so long chains need few rounds. With
    ``max_rounds`` it is an error if labels still change after so many.
    """
    rounds = Rounds(edges.sparkSession, "components")
    both = rounds.save(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    now, n = rounds.save(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component"))), 0
    while True:
        heard = both.join(now.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("heard"))
        after = now.join(heard, "node").select("node", F.least("component", "heard").alias("component"))
        jump = after.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = rounds.save(after.join(jump, "component").select("node", F.least("component", "further").alias("component")))
        settled = now.join(after, ["node", "component"], "left_anti").isEmpty()
        rounds.drop(now)
        if settled:
            return after
        now, n = after, n + 1
        if n == max_rounds:
            raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _lightest(edges: DataFrame, weighted: bool) -> DataFrame:
    return edges.select("src", "dst", (F.col("w") if weighted else F.lit(1)).cast("double").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w"))


def paths_within(edges: DataFrame, sources: DataFrame, reach: int, weighted: bool = True) -> DataFrame:
    """(source, node, distance) over paths of at most ``reach`` edges: a round for each edge, which relaxes what the last one lowered."""
    rounds = Rounds(edges.sparkSession, "paths")
    step = rounds.save(_lightest(edges, weighted))
    best = rounds.save(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance")))
    lower = best
    for _ in range(reach):
        reached = lower.join(step, F.col("node") == F.col("src")).groupBy("source", "dst").agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        known = best.select("source", F.col("node").alias("dst"), "distance")
        fresh = rounds.save(
            reached.join(known, ["source", "dst"], "left").filter("distance is null or new < distance").select("source", F.col("dst").alias("node"), F.col("new").alias("distance"))
        )
        if fresh.isEmpty():
            break
        both = best.union(fresh)
        after = rounds.save(both.groupBy("source", "node").agg(F.min("distance").alias("distance")) if weighted else both)
        rounds.drop(best, *([lower] if lower is not best else []))
        best, lower = after, fresh
    return best


def follow(known: pa.Table, edges: pa.Table) -> pa.Table:
    """Of one fragment: what its open nodes lower, along paths inside it.

    ``known``: source, node, distance, open; only open ones are followed. A
    node reached is open again if the fragment hasn't got its edges.
    """
    src, dst, w = (edges.column(c).to_numpy() for c in ("src", "dst", "w"))
    source, node, distance = (known.column(c).to_numpy() for c in ("source", "node", "distance"))
    names, at = np.unique(np.concatenate([src, dst, node]), return_inverse=True)
    src, dst, node = at[: len(src)], at[len(src) : 2 * len(src)], at[2 * len(src) :]
    starts, source = np.unique(source, return_inverse=True)
    order, n = np.argsort(src, kind="stable"), len(names)
    dst, w, degree = dst[order], w[order], np.bincount(src, minlength=n)
    first = np.cumsum(degree) - degree
    far = np.full(len(starts) * n, np.inf)
    far[source * n + node] = distance
    front = (source * n + node)[known.column("open").to_numpy(zero_copy_only=False)]
    lowered = np.zeros(len(far), dtype=bool)
    while len(front):  # all edges of what the last step lowered, for all sources side by side, so many edges at a time
        upto, reached = np.cumsum(degree[front % n]), []
        for own in np.split(front, np.searchsorted(upto, np.arange(EDGES_AT_ONCE, upto[-1], EDGES_AT_ONCE))):
            edges_of = degree[own % n]
            of = np.repeat(np.arange(len(own)), edges_of)
            edge = np.arange(len(of)) + (first[own % n] - (np.cumsum(edges_of) - edges_of))[of]
            to, new = (own - own % n)[of] + dst[edge], far[own][of] + w[edge]
            better = new < far[to]
            to, new = to[better], new[better]
            np.minimum.at(far, to, new)
            reached.append(to)
        front = np.unique(np.concatenate(reached))
        lowered[front] = True
    found = np.flatnonzero(lowered)
    return pa.table([pa.array(starts[found // n]), pa.array(names[found % n]), pa.array(far[found]), pa.array(degree[found % n] == 0)], names=["source", "node", "distance", "open"])


def shortest_paths(
    edges: DataFrame, sources: DataFrame, weighted: bool = True, max_rounds: int | None = None, reach: int | None = None, fragments: int | None = None
) -> DataFrame:
    """(source, node, distance) from every ``sources(node)`` along ``edges(src, dst, w)``; weights are not negative.

    ``reach`` bounds the edges of a path. ``fragments`` sets their number. With
    ``max_rounds`` it is an error if distances still fall after so many rounds.
    """
    if reach is not None:
        return paths_within(edges, sources, reach, weighted)
    return Fragments(edges, weighted, fragments).distances(sources, max_rounds)


class Fragments:
    """A graph's edges dealt out to fragments, written once for any number of searches."""

    def __init__(self, edges: DataFrame, weighted: bool = True, fragments: int | None = None):
        spark = edges.sparkSession
        rounds = Rounds(spark, "fragments")
        step = rounds.save(_lightest(edges, weighted))
        parts = fragments or step.count() // FRAGMENT + 1
        hubs = rounds.save(step.groupBy("src").count().filter(F.col("count") > HUB).select("src"))
        self.wide = None if hubs.isEmpty() else rounds.save(step.join(hubs, "src", "left_semi"))
        inside = step if self.wide is None else step.join(hubs, "src", "left_anti")
        # all edges of a node have one range; written, since its bounds are sampled
        self.inside = rounds.save(inside.repartitionByRange(parts, "src").withColumn("part", F.spark_partition_id()))
        self.owner = rounds.save(self.inside.select(F.col("src").alias("node"), "part").distinct())

    def distances(self, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
        rounds = Rounds(sources.sparkSession, "paths")
        best = rounds.save(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"), F.lit(True).alias("open")).distinct())
        block = F.pmod(F.xxhash64("source"), F.lit(best.count() // SOURCES_OF_A_TASK + 1)).alias("block")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in best.schema)
        edge_columns = [F.col("part").alias("of_part"), F.col("block").alias("of_block"), "src", "dst", "w"]

        def run(_: tuple, known: pa.Table, own: pa.Table) -> pa.Table:
            return follow(known, own)

        n = 0
        while True:
            placed = best.join(self.owner, "node").select("part", block, "source", "node", "distance", "open")
            active = placed.filter("open").select("part", "block").distinct()
            known = placed.join(active, ["part", "block"], "left_semi")
            sent = self.inside.join(active, "part").select(*edge_columns)
            found = known.groupBy("part", "block").cogroup(sent.groupBy("of_part", "of_block")).applyInArrow(run, schema)
            if self.wide is not None:
                far = best.filter("open").join(self.wide, F.col("node") == F.col("src"))
                found = found.union(far.select("source", F.col("dst").alias("node"), F.col("distance") + F.col("w"), F.lit(True)))
            # of equal distances one that its fragment has already followed counts
            all_of = best.withColumn("open", F.lit(False)).union(found).groupBy("source", "node").agg(F.min(F.struct("distance", "open")).alias("x"))
            after = rounds.save(all_of.select("source", "node", "x.distance", "x.open"))
            rounds.drop(best)
            if after.filter("open").isEmpty():
                return after.drop("open")
            best, n = after, n + 1
            if n == max_rounds:
                raise RuntimeError(f"distances still fall after {max_rounds} rounds")


def predecessors(edges: DataFrame, distances: DataFrame, weighted: bool = True) -> DataFrame:
    """``distances`` and ``previous``: the least node from which a shortest path enters the node; null at its source. Weights are positive."""
    before = distances.select("source", F.col("node").alias("src"), F.col("distance").alias("d"))
    entered = before.join(_lightest(edges, weighted), "src").select("source", "src", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("distance"))
    found = distances.join(entered, ["source", "node", "distance"]).groupBy("source", "node").agg(F.min("src").alias("previous"))
    return distances.join(found, ["source", "node"], "left")


def routes(previous: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, place, node): the nodes of the shortest path to each ``targets(source, target)``, the source at place 0.

    Steps back are doubled each round, so paths of any length take as many
    rounds as their length has binary digits.
    """
    rounds = Rounds(previous.sparkSession, "routes")
    back = rounds.save(previous.filter("previous is not null").select("source", "node", F.col("previous").alias("to")))
    known = targets.join(previous.select("source", F.col("node").alias("target")), ["source", "target"], "left_semi").distinct()
    rows = rounds.save(known.select("source", "target", F.lit(0).cast("long").alias("back"), F.col("target").alias("node")))
    step = 1
    while not back.isEmpty():
        further = rows.join(back, ["source", "node"]).select("source", "target", F.col("back") + step, F.col("to"))
        twice = back.join(back.select("source", F.col("node").alias("to"), F.col("to").alias("end")), ["source", "to"]).select("source", "node", F.col("end").alias("to"))
        after, jump = rounds.save(rows.union(further)), rounds.save(twice)
        rounds.drop(rows, back)
        rows, back, step = after, jump, step * 2
    length = rows.groupBy("source", "target").agg(F.max("back").alias("length"))
    return rows.join(length, ["source", "target"]).select("source", "target", (F.col("length") - F.col("back")).alias("place"), "node")


#: Sources of a pass of an all-pairs search, on average, and nodes whose bits travel as one row's longs.
SOURCES_AT_ONCE, BITS_AT_ONCE = 100_000, 4096


def _blocks(nodes: DataFrame, at_once: int) -> Iterator[DataFrame]:
    """The nodes in blocks by their hash, so that an all-pairs search never holds all pairs."""
    nodes = save(nodes.distinct(), "nodes")
    blocks = max(1, -(-nodes.count() // at_once))
    for i in range(blocks):
        yield nodes if blocks == 1 else nodes.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i)


def hop_counts(edges: DataFrame, targets: DataFrame, reach: int | None = None) -> Iterator[DataFrame]:
    """For each hop 1, 2, ... a table (node, n): how many of ``targets(node)`` are that far along ``edges(src, dst)`` from nodes that have any.

    A node carries the targets it reaches as bits, 64 a long, and takes its
    neighbours' by a bitwise or, partly before the shuffle, so a hop reads each
    edge once for all targets and no pair is a row. Ends where nothing is new.
    Targets should be some thousands: they are numbered in one task. A table
    is there until the next one is asked for.
    """
    rounds = Rounds(edges.sparkSession, "bits")
    numbered = rounds.save(targets.select("node").distinct().withColumn("place", F.row_number().over(W.orderBy("node")) - 1))
    words = [f"w{i}" for i in range(-(-numbered.count() // 64))]
    if not words:
        return
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    now = rounds.save(numbered.select("node", *[F.when(F.floor(F.col("place") / 64) == i, bit).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)], F.lit(1).alias("n")))
    hop, known = 0, reduce(lambda x, y: x + y, [F.bit_count(w) for w in words])
    while reach is None or hop < reach:
        heard = edges.join(now.select(F.col("node").alias("dst"), *words), "dst").select(F.col("src").alias("node"), *words, F.lit(0).alias("n"))
        merged = heard.union(now.select("node", *words, "n")).groupBy("node").agg(*[F.bit_or(w).alias(w) for w in words], F.max("n").alias("before"))
        after = rounds.save(merged.select("node", *words, known.alias("n"), "before"))
        rounds.drop(now)
        now, hop, new = after.drop("before"), hop + 1, after.filter("n > before").select("node", (F.col("n") - F.col("before")).cast("long").alias("n"))
        if new.isEmpty():
            break
        yield new
    rounds.drop(now, numbered)


#: Edges and nodes up to which a task may hold a graph (half a GB and a tenth), edges of a packed row, and bits of a block of targets.
HELD_EDGES, HELD_NODES, PACKED, BLOCK_BITS = 1 << 27, 1 << 24, 1 << 16, 1 << 31
#: Bytes of an Arrow batch of packed rows.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _alike(edges: DataFrame) -> bool:
    """Every edge has its reverse, of the same weight if there are any."""
    turned = {"src": "dst", "dst": "src"}
    return edges.join(edges.select(*[F.col(turned.get(c, c)).alias(c) for c in edges.columns]), edges.columns, "left_anti").isEmpty()


class Whole:
    """A graph that tasks hold whole, each for its share of the targets; for graphs of HELD_EDGES at most, as a small table is sent to all tasks.

    Nodes are numbered by ranges, edges travel as packed 32-bit numbers. A
    task keeps the edges, and the bits of one block of targets at a time:
    4,096 targets, fewer where the nodes are so many that these took more than
    BLOCK_BITS.
    """

    def __init__(self, edges: DataFrame, alike: bool):
        self.spark, self.alike, rounds = edges.sparkSession, alike, Rounds(edges.sparkSession, "whole")
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        ranged = rounds.save(nodes.repartitionByRange("node").sortWithinPartitions("node").select("node", F.monotonically_increasing_id().alias("at")))
        part, starts, self.n = F.shiftright("at", 33), [], 0
        for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each task of the shuffle
            starts.append((r.part, self.n))
            self.n += r["count"]
        of = self.spark.createDataFrame(starts, "part long, start long")
        number = (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("number")
        self.numbered = rounds.save(ranged.withColumn("part", part).join(F.broadcast(of), "part").select("node", number))
        ends = [self.numbered.select(F.col("node").alias(c), F.col("number").alias(x)) for c, x in (("src", "s"), ("dst", "t"))]
        plain = edges.select("src", "dst").join(ends[0], "src").join(ends[1], "dst").select("s", "t")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def out() -> pa.RecordBatch:
                s, t = (np.concatenate([b.column(i).to_numpy() for b in held]).astype("<i4") for i in (0, 1))
                return pa.record_batch([pa.array(s[:1]), pa.array(t[:1]), pa.array([s.tobytes()], pa.binary()), pa.array([t.tobytes()], pa.binary())], names=["s", "t", "sources", "targets"])

            for batch in batches:
                if batch.num_rows:
                    held, n = [*held, batch], n + batch.num_rows
                if n >= PACKED:
                    yield out()
                    held, n = [], 0
            if held:
                yield out()

        ordered = plain.repartitionByRange("s").sortWithinPartitions("s", "t")
        self.packed = rounds.save(ordered.mapInArrow(pack, "s int, t int, sources binary, targets binary"))

    @staticmethod
    def fits(edges: DataFrame) -> bool:
        """Of written edges."""
        return edges.count() <= HELD_EDGES and edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().count() <= HELD_NODES

    def blocks(self, n: int, at_once: int | None) -> tuple[int, int]:
        """Targets of a block and tasks, for ``n`` targets: two tasks a core at most, each with as many blocks as the others."""
        n, most = max(1, n), at_once or max(64, min(BITS_AT_ONCE, BLOCK_BITS // max(1, self.n)))
        tasks = max(1, min(-(-n // most), 2 * self.spark.sparkContext.defaultParallelism))
        return -(-n // (tasks * -(-n // (tasks * most)))), tasks

    def run(self, targets: DataFrame, each, schema: str, at_once: int | None = None) -> DataFrame:
        """``each(held, blocks)``, record batches, in every task, from the held graph and its blocks of the numbers of ``targets(node)``; the result is written."""
        asked = save(targets.select("node").distinct().join(self.numbered, "node").select("number"), "asked")
        n, alike, size = asked.count(), self.alike, self.n
        block, tasks = self.blocks(n, at_once)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array([batch.column(0).to_numpy().astype("<i4").tobytes()], pa.binary())], names=["asked"])

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunks, wanted, task = [], [], 0
            for batch in batches:
                for s, t, sources, to, own, task in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if own is None:
                        chunks.append((s, t, np.frombuffer(sources, "<i4"), np.frombuffer(to, "<i4")))
                    else:
                        wanted.append(np.frombuffer(own, "<i4"))
            if wanted:
                chunks.sort(key=lambda c: c[:2])
                source, to = (np.concatenate([c[i] for c in chunks] or [np.zeros(0, "<i4")]) for i in (2, 3))
                del chunks
                every = np.sort(np.concatenate(wanted))
                yield from each(R.Held(size, source, to, alike), [every[x : x + block] for x in range(task * block, len(every), tasks * block)])

        rows = self.packed.withColumn("asked", F.lit(None).cast("binary")).unionByName(asked.mapInArrow(pack, "asked binary"), allowMissingColumns=True)
        dealt = rows.crossJoin(F.broadcast(self.spark.range(tasks).select(F.col("id").cast("int").alias("task")))).repartitionById(tasks, "task")
        kept = self.spark.conf.get(_BATCH_BYTES)
        self.spark.conf.set(_BATCH_BYTES, str(1 << 22))
        try:
            return save(dealt.mapInArrow(go, schema), "found")
        finally:
            self.spark.conf.set(_BATCH_BYTES, kept)

    def sizes(self, reach: int, at_once: int | None = None) -> DataFrame:
        """(node, distance, n) of every node and hop up to ``reach``: how many nodes are there."""

        def each(held: R.Held, blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            counts: list[np.ndarray] = []
            for block in blocks:
                for d, new in enumerate(held.hops(block, reach)):
                    counts += [np.zeros(held.n, dtype=np.int64)] * (d == len(counts))
                    counts[d] += new
            for d, n in enumerate(counts):
                for x in range(0, held.n, PACKED):
                    own = x + np.flatnonzero(n[x : x + PACKED])
                    yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), d + 1, dtype=np.int32)), pa.array(n[own])], names=["number", "distance", "n"])

        found = self.run(self.numbered, each, "number int, distance int, n long", at_once)
        return found.groupBy("number", "distance").agg(F.sum("n").alias("n")).join(self.numbered, "number").select("node", "distance", "n")

    def most_hops(self, targets: DataFrame, at_once: int | None = None) -> int:
        """The most hops that any node has to any of ``targets(node)`` it reaches."""

        def each(held: R.Held, blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch([pa.array([max((sum(1 for _ in held.hops(b)) for b in blocks), default=0)])], names=["hops"])

        return self.run(targets, each, "hops long", at_once).agg(F.max("hops")).first()[0] or 0

    def bounds(self, sources: DataFrame) -> DataFrame:
        """(node, lo, hi, near, own): what searches from ``sources(node)``, one after another in a task, say of the nodes they reach; as for ``diameter``."""

        def each(held: R.Held, blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            lo, hi, near, own = np.zeros(held.n), np.full(held.n, np.inf), np.full(held.n, np.inf), np.zeros(held.n, dtype=bool)
            for source in (x for b in blocks for x in b):
                far = held.depths(source)
                at, e = np.flatnonzero(far >= 0), far.max()
                d = far[at].astype(float)
                lo[at], hi[at], near[at] = np.maximum(lo[at], np.maximum(e - d, d)), np.minimum(hi[at], e + d), np.minimum(near[at], d)
                own[source] = True
            for x in range(0, held.n, PACKED):
                at = x + np.flatnonzero(np.isfinite(hi[x : x + PACKED]))
                yield pa.record_batch([pa.array(at.astype(np.int32)), *[pa.array(c[at]) for c in (lo, hi, near, own)]], names=["number", "lo", "hi", "near", "own"])

        found = self.run(sources, each, "number int, lo double, hi double, near double, own boolean", 16)
        of = found.groupBy("number").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.min("near").alias("near"), F.max("own").alias("own"))
        return of.join(self.numbered, "number").drop("number")


#: Sources that a round of the diameter searches at most, and hops up to which it searches what is left by bits.
AT_ONCE, SHALLOW = 1024, 32


def diameter(edges: DataFrame, weighted: bool = False, at_once: int | None = None) -> DataFrame:
    """One row: ``diameter``, the greatest shortest distance between two connected nodes, and ``searched``, the sources it took.

    Where every edge has its reverse, a search from s bounds each node v of
    its component: the eccentricity is at least max(e(s) - d(s, v), d(s, v))
    and at most e(s) + d(s, v). The first search of a component starts at the
    node with the most edges, its centre c. A pair further apart than the best
    distance known has a node x with 2 d(c, x) above it, whose upper bound is
    above it too; the later rounds search from such nodes, those with the
    highest upper or the lowest lower bounds in turn, four times as many each time
    (AT_ONCE at most), until none is left. Bounds say little where all nodes
    are a few hops apart: if a component's hops are SHALLOW at most by its
    centre, all nodes left are searched by their bits. One-way edges have no
    such bounds: all sources are searched, in blocks of which only the maximum is kept.
    Without weights, tasks hold the graph whole where it is no larger than
    ``Whole`` allows, for all of this but the first search of each component.
    """
    spark, edges = edges.sparkSession, save(_lightest(edges, weighted), "edges")
    alike, fits = _alike(edges), not weighted and Whole.fits(edges)
    whole = Whole(edges, alike) if fits else None
    if not alike and whole is not None:
        sources = edges.select(F.col("src").alias("node")).distinct()
        return spark.createDataFrame([(float(whole.most_hops(edges.select(F.col("dst").alias("node")), at_once)) if whole.n else None, sources.count())], "diameter double, searched long")
    if not alike:
        found = [(shortest_paths(edges, block).agg(F.max("distance")).first()[0], block.count()) for block in _blocks(edges.select(F.col("src").alias("node")), at_once or SOURCES_AT_ONCE)]
        return spark.createDataFrame([(max((d for d, _ in found if d is not None), default=None), sum(n for _, n in found))], "diameter double, searched long")
    rounds = Rounds(spark, "diameter")
    parts = connected_components(edges)
    degrees = edges.groupBy(F.col("src").alias("node")).count()
    unbound, graph = F.lit(float("inf")), Fragments(edges)
    nodes = rounds.save(
        parts.join(degrees, "node").select("node", "component", "count", F.lit(0.0).alias("lower"), unbound.alias("upper"), unbound.alias("centre"), F.lit(False).alias("done"))
    )
    best, searched, n_round = None, 0, 0
    while True:
        if not n_round:
            picks = nodes.groupBy("component").agg(F.max_by("node", F.struct("count", -F.col("node"))).alias("node")).select("node")
        else:
            left = nodes.filter(~F.col("done") & (F.col("upper") > best) & (2 * F.col("centre") > best))
            order = [F.desc("upper"), "lower"] if n_round % 2 else ["lower", F.desc("upper")]
            picks = left.orderBy(*order, F.desc("count"), "node").limit(min(4**n_round, AT_ONCE)).select("node")
        picks = rounds.save(picks)
        n = picks.count()
        if not n:
            break
        if n_round and whole is not None:
            seen = bounds = rounds.save(whole.bounds(picks))
        else:
            seen = graph.distances(picks)
            reach = seen.groupBy("source").agg(F.max("distance").alias("e"))
            bounds = seen.join(reach, "source").groupBy("node").agg(
                F.max(F.greatest(F.col("e") - F.col("distance"), F.col("distance"))).alias("lo"), F.min(F.col("e") + F.col("distance")).alias("hi"),
                F.min("distance").alias("near"), F.max(F.col("source") == F.col("node")).alias("own"),
            )
        after = rounds.save(
            nodes.join(bounds, "node", "left").select(
                "node", "component", "count", F.greatest("lower", F.coalesce("lo", F.lit(0.0))).alias("lower"), F.least("upper", F.coalesce("hi", unbound)).alias("upper"),
                (F.col("centre") if n_round else F.coalesce("near", unbound)).alias("centre"), (F.col("done") | F.coalesce("own", F.lit(False))).alias("done"),
            )
        )
        rounds.drop(nodes, seen, picks)
        nodes, best, searched, n_round = after, after.agg(F.max("lower")).first()[0], searched + n, n_round + 1
        if n_round == 1 and not weighted and 2 * nodes.agg(F.max("centre")).first()[0] <= SHALLOW:
            order = [F.desc("upper"), F.desc("count"), "node"]
            while whole is not None:
                left = rounds.save(nodes.filter(~F.col("done") & (F.col("upper") > best) & (2 * F.col("centre") > best)).select("node"))
                n = left.count()
                if n:
                    best, searched = max(best, float(whole.most_hops(left, at_once))), searched + n
                break
            while whole is None:
                left = nodes.filter(~F.col("done") & (F.col("upper") > best) & (2 * F.col("centre") > best))
                picks = rounds.save(left.orderBy(*order).limit(at_once or BITS_AT_ONCE).select("node"))
                n, hops = picks.count(), sum(1 for _ in hop_counts(edges, picks))
                if not n:
                    break
                after = rounds.save(nodes.join(picks.withColumn("own", F.lit(True)), "node", "left").withColumn("done", F.col("done") | F.coalesce("own", F.lit(False))).drop("own"))
                rounds.drop(nodes, picks)
                nodes, best, searched = after, max(best, float(hops)), searched + n
            break
    return spark.createDataFrame([(best, searched)], "diameter double, searched long")


def neighbourhood_sizes(edges: DataFrame, reach: int = 10, at_once: int | None = None) -> DataFrame:
    """(node, distance, n): exactly how many nodes are at each hop distance up to ``reach``.

    The search ends after ``reach`` hops; the nodes are reached block by block, as bits, of which only counts are kept.
    Tasks do so by themselves in a graph that each can hold (see ``Whole``), and hop by hop together in a larger one.
    """
    spark, path, schema = edges.sparkSession, folder(edges.sparkSession, "sizes"), "node long, distance int, n long"
    spark.createDataFrame([], schema).write.parquet(path)
    edges = save(edges.select("src", "dst").distinct(), "edges")
    if Whole.fits(edges):
        return Whole(edges, _alike(edges)).sizes(reach, at_once)
    for block in _blocks(edges.select(F.col("src").alias("node")).union(edges.select("dst")), at_once or BITS_AT_ONCE):
        for d, new in enumerate(hop_counts(edges, block, reach)):
            new.select("node", F.lit(d + 1).alias("distance"), "n").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).groupBy("node", "distance").agg(F.sum("n").alias("n"))


#: Ranks a node carries: estimates have a relative deviation of 1 / sqrt(RANKS - 2), 5 %, so 95 % are within 10 %.
RANKS = 400
_TOP = 1 << 31


def node_ranks(nodes: DataFrame, ranks: int = RANKS, seed: int = 1) -> DataFrame:
    """``nodes(node)`` and ``ranks``: independent whole numbers below 2^31, four of each MD5 of seed, number and node."""
    digest = lambda j: F.md5(F.concat_ws(":", F.lit(seed), j, F.col("node")).cast("binary"))
    rank = lambda text, k: F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("long").bitwiseAND(_TOP - 1).cast("int")
    texts = F.transform(F.sequence(F.lit(0), F.lit(-(-ranks // 4) - 1)), digest)
    return nodes.select("node", F.slice(F.flatten(F.transform(texts, lambda t: F.array(*[rank(t, k) for k in range(4)]))), 1, ranks).alias("ranks"))


#: Edges of a part on average, slices that the ranks are cut into, sources in a packed row on average, and ranks that a task gathers at once, in numbers.
ESTIMATED_EDGES, SLICES, _SOURCES, _GATHERED = 1 << 23, 8, 1024, 1 << 21


def _least(node: np.ndarray, ranks: np.ndarray, at: np.ndarray, gathered: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of the sorted ``node`` with the least of the rows ``at`` of ``ranks`` that stand beside it, some nodes at a time."""
    step, starts = max(1, gathered // max(1, ranks.shape[1])), np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
    lo = 0
    while lo < len(starts):
        # as many nodes as fit, and one at least, whose rows are gathered piece by piece
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step, side="right")) - 1)
        end = starts[hi] if hi < len(starts) else len(node)
        if hi == lo + 1:
            pieces = [ranks[at[x : min(x + step, end)]].min(axis=0) for x in range(starts[lo], end, step)]
            yield node[starts[lo : lo + 1]], np.min(pieces, axis=0)[None, :]
        else:
            yield node[starts[lo:hi]], np.minimum.reduceat(ranks[at[starts[lo] : end]], starts[lo:hi] - starts[lo], axis=0)
        lo = hi


def _rows_of(packed: pa.Array) -> np.ndarray:
    """The rows of a column of packed ranks, none of them null."""
    return np.frombuffer(b"".join(packed.to_pylist()), dtype="<i4").reshape(len(packed), -1)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _heard(most: int):
    """From (node, slice, sources, packed), a node's ranks before the sources of edges into it: (node, slice, packed) of each source, its least ranks among a part's nodes.

    At most about ``most`` edges, or as many nodes, are held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, sources, at, m, slice_ = [], 0, [], [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            source, place = np.concatenate(sources), np.concatenate(at)
            order, rows = np.argsort(source, kind="stable"), np.concatenate(held)
            for node, least in _least(source[order], rows, place[order], _GATHERED):
                yield pa.record_batch([pa.array(node), pa.array(np.full(len(node), slice_, dtype=np.int32)), _packed(least)], names=["node", "slice", "packed"])

        for batch in batches:
            if not batch.num_rows:
                continue
            slice_ = batch.column(1)[0].as_py()
            own = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            lists = batch.column(2).filter(pa.array(~own))
            if own.any():
                held.append(_rows_of(batch.column(3).drop_null()))
            # edges belong to the last ranks before them, which may stand in an earlier batch
            place = np.repeat((n - 1 + np.cumsum(own))[~own], lists.value_lengths().to_numpy()).astype(np.int32)
            n += int(own.sum())
            sources.append(lists.flatten().to_numpy().astype(np.int64))
            at.append(place)
            m += len(place)
            if max(n, m) >= most:
                if m:
                    yield from out()
                held, n, sources, at, m = [held[-1][-1:]], 1, [], [], 0
        if m:
            yield from out()

    return run


def _merged(slices: int):
    """From (node, slice, packed, own) by node and slice: each node with its least ranks, the estimate, and whether they are less than its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def least_of(node: np.ndarray, part: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = np.r_[True, (node[1:] != node[:-1]) | (part[1:] != part[:-1])]
            return np.cumsum(new) - 1, np.minimum.reduceat(rows, np.flatnonzero(new), axis=0)

        def out(node: np.ndarray, part: np.ndarray, rows: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            group, least = least_of(node, part, rows)
            less = np.zeros(len(least), dtype=bool)
            less[group[own]] = (least[group[own]] != rows[own]).any(axis=1)
            whole = least.reshape(len(least) // slices, -1)  # a node's own rows stand for all slices
            within = (whole.shape[1] - 1) / -np.log(1 - (whole + 0.5) / _TOP).sum(axis=1)
            return pa.record_batch([pa.array(np.unique(node)), _packed(whole), pa.array(within), pa.array(less.reshape(-1, slices).any(axis=1))], names=["node", "packed", "within", "less"])

        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _rows_of(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on in the next batch: its least and own rows wait
            if cut:
                yield out(*[x[:cut] for x in now])
            node, part, rows, own = [x[cut:] for x in now]
            group, least = least_of(node, part, rows)
            parts = np.r_[part[np.r_[True, group[1:] != group[:-1]]], part[own]]
            order = np.argsort(parts, kind="stable")
            left = [np.full(len(parts), node[-1]), parts[order], np.concatenate([least, rows[own]])[order], np.r_[np.zeros(len(least), dtype=bool), np.ones(int(own.sum()), dtype=bool)][order]]
        if left is not None:
            yield out(*left)

    return run


def neighbourhood_estimates(edges: DataFrame, reach: int = 10, ranks: int = RANKS, seed: int = 1) -> DataFrame:
    """(node, distance, within): about how many nodes, itself included, are within each hop distance from 1 to ``reach`` along ``edges(src, dst)``.

    Each node has ``ranks`` random ranks; the least ranks within a distance
    are those of the neighbours within one hop less, so a round takes the
    minima over the edges, on both sides of one shuffle. The nodes are dealt
    to parts and the ranks cut into slices: a task holds one slice of a part's
    ranks and the edges into it, and sends each source its least ones among
    these, so what is sent grows with the parts, not with the tasks. As
    exponential variables, n nodes' least ranks have the mean 1 / n, so
    (ranks - 1) / their sum is the estimate. The memory is ranks a node; no
    pairs are made. Edges with a null end are left out.
    """
    rounds = Rounds(edges.sparkSession, "estimates")
    step = rounds.save(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).dropna().distinct())
    nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
    parts, slices = max(1, -(-step.count() // ESTIMATED_EDGES)), max(s for s in range(1, SLICES + 1) if ranks % s == 0)
    width = ranks // slices

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), _packed(batch.column(1).flatten().to_numpy().astype("<i4").reshape(-1, ranks))], names=["node", "packed"])

    now = rounds.save(node_ranks(nodes, ranks, seed).mapInArrow(pack, "node long, packed binary"))
    degrees = step.groupBy("dst").agg(F.ceil(F.count("*") / _SOURCES).alias("lists"))
    lists = step.join(degrees, "dst").groupBy(F.col("dst").alias("node"), F.pmod(F.xxhash64("src"), F.col("lists")).alias("list")).agg(F.sort_array(F.collect_list("src")).alias("sources"))
    lists = rounds.save(lists.select("node", "sources"))
    into = lists.select("node", F.explode(F.array(*[F.lit(s) for s in range(slices)])).alias("slice"), "sources", F.lit(None).cast("binary").alias("packed"))
    place = (F.pmod(F.xxhash64("node"), F.lit(parts)) * slices + F.col("slice")).cast("int")
    out, same = None, False
    for d in range(1, reach + 1):
        if not same:
            cut = F.array(*[F.struct(F.lit(s).alias("slice"), F.substring("packed", 4 * width * s + 1, 4 * width).alias("packed")) for s in range(slices)])
            own = now.select("node", F.explode(cut).alias("x")).select("node", "x.slice", "x.packed")
            both = own.select("node", "slice", F.lit(None).cast("array<long>").alias("sources"), "packed").union(into)
            sent = both.repartitionById(parts * slices, place).sortWithinPartitions("node", F.col("packed").isNull())
            heard = sent.mapInArrow(_heard(ESTIMATED_EDGES), "node long, slice int, packed binary")
            least = heard.withColumn("own", F.lit(False)).union(own.withColumn("own", F.lit(True)))
            merged = least.repartition("node").sortWithinPartitions("node", "slice").mapInArrow(_merged(slices), "node long, packed binary, within double, less boolean")
            after = rounds.save(merged)
            same = after.filter("less").isEmpty()
            counted = save(after.select("node", "within"), "within")
            rounds.drop(now)
            now = after.select("node", "packed")
        estimate = counted.select("node", F.lit(d).alias("distance"), "within")
        out = estimate if out is None else out.union(estimate)
    return out


def without_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges minus ``removed(src, dst)``, in both directions."""
    both = removed.select("src", "dst").union(removed.select("dst", "src")).distinct()
    return edges.join(both, ["src", "dst"], "left_anti").select(edges.columns)


def with_edges(edges: DataFrame, added: DataFrame) -> DataFrame:
    """Edges plus ``added(src, dst, w)`` in both directions; an edge already there keeps its weight."""
    both = added.select("src", "dst", "w").union(added.select("dst", "src", "w"))
    return edges.select("src", "dst", "w").union(both.join(edges, ["src", "dst"], "left_anti")).dropDuplicates(["src", "dst"])


def random_graph(spark: SparkSession, nodes: int, edges: int, seed: int = 1, max_weight: int = 1) -> DataFrame:
    """About ``edges`` distinct random edges (src, dst, w), both directions, made in parallel from a seed."""
    pick = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(nodes))
    raw = spark.range(edges).select(pick(1).alias("x"), pick(2).alias("y"), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(3)), F.lit(max_weight)) + 1).alias("w"))
    one = raw.filter("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "w").groupBy("src", "dst").agg(F.min("w").alias("w"))
    return one.union(one.select("dst", "src", "w"))
