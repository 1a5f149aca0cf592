"""Neighbourhood indices: typed shortest-hop paths of every node."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import save
from .pattern import Pattern


def typed_paths(edges: DataFrame, types: DataFrame, depth: int = 2, starts: DataFrame | None = None) -> DataFrame:
    """(node, depth, path, end, weight): for each end at exactly that hop distance and each
    type path that reaches it in as many hops, the greatest total weight.

    path: the types from the first hop to the end, as an array (any number of
    types). Each level is an equi-join on the frontier, grouped at once on
    plain columns, so a level holds a row per (node, end, path) rather than
    per path of nodes. The groups are reduced before they are shuffled, and by
    node and end together, so a hub's neighbourhood is no task of its own. The
    edges are written once: with their size known, the planner sends a small
    edge table to the paths' partitions, and only a large one is joined by
    shuffling the paths. ``starts(node)``: only the paths of these nodes.
    """
    steps = edges.filter("src <> dst").join(types.select(F.col("node").alias("dst"), "type"), "dst").select("src", "dst", "type", "w")
    steps = save(steps, "steps")
    begun = steps if starts is None else steps.join(starts.select(F.col("node").alias("src")), "src", "left_semi")
    level = begun.groupBy(F.col("src").alias("node"), F.col("dst").alias("end"), F.col("type").alias("t_1")).agg(F.max("w").alias("weight"))
    as_row = lambda x, d: x.select("node", F.lit(d).alias("depth"), F.array(*[F.col(f"t_{i}") for i in range(1, d + 1)]).alias("path"), "end", "weight")
    out = as_row(level, 1)
    near = save(level.select("node", "end").distinct(), "near") if depth > 1 else level
    for d in range(2, depth + 1):
        path = [F.col(f"t_{i}") for i in range(1, d)]
        longer = level.join(steps, F.col("end") == F.col("src")).filter("dst <> node")
        longer = longer.groupBy("node", F.col("dst").alias("end"), *path, F.col("type").alias(f"t_{d}")).agg(F.max(F.col("weight") + F.col("w")).alias("weight"))
        level = longer.join(near, ["node", "end"], "left_anti")
        out = out.union(as_row(level, d))
        if d < depth:
            near = save(near.union(level.select("node", "end")).distinct(), "near")
    return out


#: Neighbours of a node that travel as one row, on average.
LIST = 1024


def _small(values: np.ndarray) -> bytes:
    """Numbers in the least type that holds them, its name first."""
    kind = "f8"
    if values.dtype.kind != "f":
        lo, hi = values.min(), values.max()
        kind = next((k for k, top in (("u1", 1 << 8), ("u2", 1 << 16), ("u4", 1 << 32)) if lo >= 0 and hi < top), "i8")
    return kind.encode() + values.astype(f"<{kind}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<{data[:2].decode()}", offset=2)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (dst, type, w), in order of dst, as the first dst, the gaps between them, types and weights."""
    for batch in batches:
        ends, flat, out = batch.column(1).offsets.to_numpy(), batch.column(1).flatten().flatten(), []
        at = ends - ends[0]
        dst, kind, w = (c.to_numpy() for c in flat)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            out.append((int(dst[lo]), _small(np.diff(dst[lo:hi], prepend=dst[lo])), _small(kind[lo:hi]), _small(w[lo:hi])))
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
        yield pa.record_batch([batch.column(0), *cols], names=["mid", "base", "gaps", "kinds", "weights"])


#: Stands before all types: the end is a neighbour.
_NEAR = -(1 << 62)


def _two_hops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of the node, counts and greatest weights of its ends two hops off, by type path.

    A node's rows may go over several batches: what is known of it is carried
    on with each (end, path) once.
    """

    def starts(*keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys[0]), dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return np.flatnonzero(new)

    def once(node, end, t1, t2, w):
        order = np.lexsort((t2, t1, end, node))
        node, end, t1, t2, w = (x[order] for x in (node, end, t1, t2, w))
        at = starts(node, end, t1, t2)
        return node[at], end[at], t1[at], t2[at], np.maximum.reduceat(w, at)

    def counted(node, end, t1, t2, w) -> pa.RecordBatch:
        at = starts(node, end)  # a neighbour's mark comes first
        far = np.repeat(t1[at] != _NEAR, np.diff(at, append=len(node))) & (end != node)
        node, t1, t2, w = node[far], t1[far], t2[far], w[far]
        order = np.lexsort((t2, t1, node))
        node, t1, t2, w = (x[order] for x in (node, t1, t2, w))
        at = starts(node, t1, t2) if len(node) else np.zeros(0, dtype=np.int64)
        n, most = np.diff(at, append=len(node)), np.maximum.reduceat(w, at) if len(at) else w
        return pa.record_batch([pa.array(node[at]), pa.array(t1[at]), pa.array(t2[at]), pa.array(n.astype(np.int64)), pa.array(most)], names=["node", "t_1", "t_2", "n_end", "max_weight"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        node, mid, t1, w1 = (batch.column(i).to_numpy().astype(t) for i, t in enumerate((np.int64, np.int64, np.int64, np.float64)))
        base, lists = batch.column(4).to_pylist(), [batch.column(i).to_pylist() for i in (5, 6, 7)]
        has = [i for i, b in enumerate(base) if b is not None]
        ends = [base[i] + np.cumsum(_large(lists[0][i]).astype(np.int64)) for i in has]
        sizes, near = [len(e) for e in ends], np.full(len(node), _NEAR)
        spread = lambda x: np.repeat(x[has], sizes)
        kinds, weights = ([_large(lists[c][i]) for i in has] for c in (1, 2))
        parts = [
            (node, mid, near, near, np.zeros(len(node))),
            (spread(node), np.concatenate([*ends, np.zeros(0, dtype=np.int64)]), spread(t1), np.concatenate([*kinds, np.zeros(0, dtype=np.int64)]).astype(np.int64), spread(w1) + np.concatenate([*weights, np.zeros(0)])),
        ]
        known = once(*(np.concatenate(x) for x in zip(*([held] if held is not None else []), *parts, strict=True)))
        going = known[0] == node[-1]
        held = tuple(x[going] for x in known)
        if not going.all():
            yield counted(*(x[~going] for x in known))
    if held is not None:
        yield counted(*held)


def path_index(edges: DataFrame, types: DataFrame, starts: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(node, depth, path, n_end, max_weight) of the typed paths of depth 1 and 2, as counted from ``typed_paths``, without a row for each of them.

    A node's neighbours travel as packed lists of about LIST, sent to each of
    its neighbours, where all ends of a node two hops off meet in one pass:
    a few bytes an end instead of a row. ``starts(node)``: only these nodes.
    """
    kind = types.schema["type"].dataType.simpleString()
    steps = edges.filter("src <> dst").join(types.select(F.col("node").alias("dst"), "type"), "dst")
    steps = save(steps.groupBy("src", "dst", F.col("type").cast("long").alias("type")).agg(F.max("w").alias("w")), "steps")
    begun = steps if starts is None else steps.join(starts.select(F.col("node").alias("src")), "src", "left_semi")
    one = begun.groupBy(F.col("src").alias("node"), "type").agg(F.count("*").alias("n_end"), F.max("w").cast("double").alias("max_weight"))
    lists = steps.groupBy("src").agg(F.floor(F.count("*") / LIST + 1).alias("lists"))
    dealt = steps.join(lists, "src").groupBy(F.col("src").alias("mid"), F.pmod(F.xxhash64("dst"), F.col("lists")).alias("list"))
    packed = dealt.agg(F.sort_array(F.collect_list(F.struct("dst", "type", "w"))).alias("own")).select("mid", "own")
    packed = save(packed.mapInArrow(_packed, "mid long, base long, gaps binary, kinds binary, weights binary"), "lists")
    rows = begun.select(F.col("src").alias("node"), F.col("dst").alias("mid"), F.col("type").alias("t_1"), F.col("w").cast("double").alias("w_1")).join(packed, "mid", "left")
    rows = rows.select("node", "mid", "t_1", "w_1", "base", "gaps", "kinds", "weights")
    met = (rows.repartition(tasks, "node") if tasks else rows.repartition("node")).sortWithinPartitions("node")
    two = met.mapInArrow(_two_hops, "node long, t_1 long, t_2 long, n_end long, max_weight double")
    as_row = lambda x, d, *path: x.select("node", F.lit(d).alias("depth"), F.array(*[F.col(c).cast(kind) for c in path]).alias("path"), "n_end", "max_weight")
    return as_row(one, 1, "type").union(as_row(two, 2, "t_1", "t_2"))


def updated_index(index: DataFrame, before: DataFrame, after: DataFrame, types: DataFrame) -> DataFrame:
    """The path index of the graph ``after`` from that of ``before``: only the affected nodes are searched again."""
    touched = affected_nodes(before, after, 2)
    fresh = path_index(after, types, touched)
    return index.join(touched, "node", "left_anti").select(fresh.columns).union(fresh)


def affected_nodes(before: DataFrame, after: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes whose typed paths may differ between two graphs of edges in both directions.

    A path of at most ``depth`` edges changes only if it holds a changed edge,
    which starts within depth - 1 hops of its first node, in either graph.
    """
    columns = ["src", "dst", "w"]
    before, after = before.select(columns), after.select(columns)
    changed = before.exceptAll(after).union(after.exceptAll(before)).select(F.col("src").alias("node"))
    found = save(changed.distinct(), "affected")
    either = before.union(after).select("src", "dst").distinct()
    for _ in range(depth - 1):
        nearer = either.join(found.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
        found = save(found.union(nearer).distinct(), "affected")
    return found


def updated_paths(paths: DataFrame, before: DataFrame, after: DataFrame, types: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """The typed paths of the graph ``after``, from ``paths``, those of ``before``; and the nodes whose paths were made anew.

    Only the affected nodes' paths are searched again; all others stay.
    """
    touched = affected_nodes(before, after, depth)
    fresh = typed_paths(after, types, depth, touched)
    return paths.join(touched, "node", "left_anti").select(fresh.columns).union(fresh), touched


def topology_signature(paths: DataFrame) -> DataFrame:
    """Number of end nodes per node, depth and type path."""
    return paths.groupBy("node", "depth", "path").agg(F.count("*").alias("n_end"))


def spd_index(paths: DataFrame) -> DataFrame:
    """The greatest path weight per node, depth and type path, to four digits."""
    return paths.groupBy("node", "depth", "path").agg(F.round(F.max("weight").cast("double"), 4).alias("max_weight"))


def spath_index(paths: DataFrame) -> DataFrame:
    """Ends per node, depth and end type: how many, and which (sorted)."""
    own = paths.groupBy("node", "depth", F.element_at("path", -1).alias("type")).agg(F.array_sort(F.collect_set("end")).alias("members"))
    return own.select("node", "depth", "type", F.size("members").cast("long").alias("n_end"), "members")


def path_order(types: int, depth: int) -> list[tuple[int, ...]]:
    """All type paths up to a depth, the last type the slowest digit."""
    return [p[::-1] for d in range(1, depth + 1) for p in product(range(1, types + 1), repeat=d)]


def pattern_signature(pattern: Pattern, depth: int = 2) -> dict[tuple[int, tuple[int, ...]], int]:
    """(role, type path) to the number of distinct ends of the pattern's edge-distinct paths."""
    ends: dict[tuple[int, tuple[int, ...]], set[int]] = {}
    for role in range(pattern.roles):
        walks = [(role, (), frozenset())]
        for _ in range(depth):
            nxt = []
            for at, path, used in walks:
                for e in pattern.edges:
                    if at in e and e not in used:
                        to = e[1] if e[0] == at else e[0]
                        types = (*path, pattern.types[to] if pattern.types else 1)
                        ends.setdefault((role, types), set()).add(to)
                        nxt.append((to, types, used | {e}))
            walks = nxt
    return {k: len(v) for k, v in ends.items()}


def contained_candidates(spark: SparkSession, signature: DataFrame, types: DataFrame, pattern: Pattern, depth: int = 2) -> DataFrame:
    """(role, node): the nodes whose neighbourhood can hold a role's.

    Types must agree. Going through the type paths in order, what a node has
    of an end type minus what the role needs must never fall below zero; a
    surplus carries over, since a nearer node may stand for a farther one.
    """
    needs = pattern_signature(pattern, depth)
    total = max(pattern.types) if pattern.types else 1
    order = {p: i for i, p in enumerate(path_order(total, depth))}
    roles = spark.createDataFrame([(r, (pattern.types[r] if pattern.types else 1)) for r in range(pattern.roles)], "role int, type int")
    need = spark.createDataFrame([(r, list(p), order[p], n) for (r, p), n in needs.items()], "role int, path array<int>, place int, need long")
    may = types.join(F.broadcast(roles), "type").select("role", "node")
    # a path the role doesn't need only adds to the surplus, but must be counted
    places = spark.createDataFrame([(list(p), i) for p, i in order.items()], "path array<int>, place int")
    has = signature.join(F.broadcast(places), "path").select("node", "place", F.element_at("path", -1).alias("last"), F.col("n_end").alias("d"))
    have = may.join(has, "node").select("role", "node", "place", "last", "d")
    owe = may.join(F.broadcast(need), "role").select("role", "node", "place", F.element_at("path", -1).alias("last"), (-F.col("need")).alias("d"))
    change = have.union(owe).groupBy("role", "node", "last", "place").agg(F.sum("d").alias("d"))
    run = F.sum("d").over(W.partitionBy("role", "node", "last").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    short = change.select("role", "node", run.alias("surplus")).filter("surplus < 0")
    return may.join(short.select("role", "node").distinct(), ["role", "node"], "left_anti")
