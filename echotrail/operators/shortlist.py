"""Shortlists by similarity and connectivity."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import save
from .knn import distance, nearest, similarity


def pair_connected(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(id1, id2)`` with ``connected``: an edge in either direction exists."""
    linked = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("connected", F.lit(True))
    on = [F.least("id1", "id2") == F.col("a"), F.greatest("id1", "id2") == F.col("b")]
    return pairs.join(linked, on, "left").select("id1", "id2", F.coalesce("connected", F.lit(False)).alias("connected"))


def product_order(ranks: list[Column]) -> list[Column]:
    """Sort keys of the prioritised product: the highest rank, which lists stand at it
    (a binary number, the last list its lowest digit), then the ranks in order."""
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    mask = reduce(lambda x, y: x + y, [F.when(r == top, 1 << (len(ranks) - 1 - i)).otherwise(0) for i, r in enumerate(ranks)])
    return [top, mask, *ranks]


def product_ranks(spark: SparkSession, sizes: list[int], n: int) -> DataFrame:
    """place and rank_0, rank_1, ...: the first ``n`` tuples of lists of these sizes in prioritised order, by index arithmetic.

    The tuples with highest rank h are a shell. In it, for each set of lists
    that stand at h (a mask), the others count through their ranks below h,
    the last one fastest. So the tuples before a shell, before a mask and
    before a tuple are products, and every tuple is made from its place alone.
    """
    m, total = len(sizes), int(np.prod(sizes, dtype=object))
    n = min(n, total)
    schema = "place long, " + ", ".join(f"rank_{i} int" for i in range(m))
    if n == 0:
        return spark.createDataFrame([], schema)
    within = lambda h: int(np.prod([min(s, h + 1) for s in sizes], dtype=object))
    lo, hi = 0, max(sizes) - 1  # the first shell that ends at n or later
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if within(mid) >= n else (mid + 1, hi)
    h, product = F.col("h"), lambda cs: reduce(lambda x, y: x * y, cs, F.lit(1).cast("decimal(38,0)")).cast("long")
    at = lambda i, mask: (mask // (1 << (m - 1 - i))) % 2 == 1
    below = [F.least(F.lit(s).cast("long"), h) for s in sizes]
    masks = []
    for mask in range(1, 1 << m):
        reaches = reduce(lambda x, y: x & y, [F.lit(sizes[i]) > h for i in range(m) if at(i, mask)])
        masks.append(F.struct(F.lit(mask).alias("mask"), F.when(reaches, product([below[i] for i in range(m) if not at(i, mask)])).otherwise(0).alias("size")))
    shells = spark.range(lo + 1).select(F.col("id").alias("h"))
    blocks = shells.select("h", product(below).alias("before"), F.array(*masks).alias("masks")).select("h", "before", F.posexplode("masks").alias("k", "x"), "masks")
    earlier = F.aggregate(F.slice("masks", 1, F.col("k")), F.lit(0).cast("long"), lambda s, x: s + x["size"])
    starts = blocks.select("h", "x.mask", "x.size", (F.col("before") + earlier).alias("start")).filter((F.col("size") > 0) & (F.col("start") < n))
    each = starts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least("size", F.lit(n) - F.col("start")) - 1)).alias("offset"))
    ranks, step = [], F.lit(1).cast("long")
    for i in reversed(range(m)):
        own = F.floor(F.col("mask") / (1 << (m - 1 - i))) % 2 == 1
        ranks.append(F.when(own, h).otherwise(F.pmod(F.floor(F.col("offset") / step), F.greatest(below[i], F.lit(1)))).cast("int").alias(f"rank_{i}"))
        step = F.when(own, step).otherwise(step * F.greatest(below[i], F.lit(1)))
    return each.select((F.col("start") + F.col("offset")).alias("place"), *reversed(ranks))


def prioritized_product(lists: list[DataFrame], n: int | None = None) -> DataFrame:
    """The first ``n`` tuples (all by default) of some ranked lists (item, rank from 0 without gaps) in prioritised order: ``place`` from 0.

    Only these tuples are made, each list's items are joined to them by rank.
    """
    sizes = [one.count() for one in lists]
    out = product_ranks(lists[0].sparkSession, sizes, int(np.prod(sizes, dtype=object)) if n is None else n)
    for i, one in enumerate(lists):
        out = out.join(one.select(F.col("item").alias(f"item_{i}"), F.col("rank").cast("int").alias(f"rank_{i}")), f"rank_{i}")
    return out.select(*[f"{c}_{i}" for i in range(len(lists)) for c in ("item", "rank")], "place").orderBy("place")


def _covers(roles: int) -> list[tuple[tuple[int, int], ...]]:
    """The least sets of role pairs in which every role stands."""
    every = list(combinations(range(roles), 2))
    found = [c for n in range(1, roles) for c in combinations(every, n) if {r for e in c for r in e} == set(range(roles))]
    return [c for c in found if not any(set(o) < set(c) for o in found)]


def _covered(each: list[DataFrame], linked: DataFrame, cover: tuple[tuple[int, int], ...]) -> DataFrame:
    """Tuples in which the roles of every pair of ``cover`` are linked; pairs that share a role are joined on it."""
    left, out = list(cover), None
    while left:
        bound = set() if out is None else {int(c[2:]) for c in out.columns if c.startswith("n_")}
        i, j = next((e for e in left if set(e) & bound), left[0])
        left.remove((i, j))
        pair = linked.withColumnsRenamed({"src": f"n_{i}", "dst": f"n_{j}"})
        for r in (i, j):
            pair = pair.join(each[r], f"n_{r}")
        shared = sorted({i, j} & bound)
        if shared:
            r = shared[0]
            out = out.join(pair.drop(f"rank_{r}", f"s_{r}"), f"n_{r}")
        else:
            out = pair if out is None else out.crossJoin(pair)
    for i, j in combinations(range(len(each)), 2):
        out = out.filter(F.col(f"n_{i}") != F.col(f"n_{j}"))
    return out


def cartesian_shortlist(vectors: DataFrame, edges: DataFrame, exemplars: list[int], k: int, limit: int) -> DataFrame:
    """Tuples of the exemplars' neighbours in which every node is linked to another of the tuple.

    Each role has the k nearest of its exemplar. Tuples are not enumerated:
    they are joined through the neighbours' links among each other, once for
    each least set of role pairs that covers all roles, and put into the
    product's order. As that goes by the highest rank, the first ranks of the
    lists are looked at alone, and more of them until there are ``limit``
    tuples. The score is the mean similarity.
    """
    roles, spark = len(exemplars), vectors.sparkSession
    asked = vectors.filter(F.col("id").isin(*exemplars))
    found = nearest(vectors, asked, k)
    near = spark.createDataFrame(found.collect(), found.schema)  # k rows a role, used once for each role
    members = near.select(F.col("neighbour").alias("src")).distinct()
    linked = edges.select("src", "dst").join(F.broadcast(members), "src", "left_semi").join(F.broadcast(members.withColumnRenamed("src", "dst")), "dst", "left_semi")
    linked = save(linked.select("src", "dst").union(linked.select("dst", "src")).filter("src <> dst").distinct(), "shortlist")
    score = reduce(lambda x, y: x + y, [F.col(f"s_{i}") for i in range(roles)]) / roles
    names, ranks = [f"n_{i}" for i in range(roles)], [F.col(f"rank_{i}") for i in range(roles)]
    schema, best, upto = ", ".join(f"{n} long" for n in names) + ", score double", [], 2 * limit
    while roles > 1:
        each = [
            F.broadcast(near.filter((F.col("query") == x) & (F.col("rank") < upto)).select(F.col("neighbour").alias(f"n_{i}"), F.col("rank").alias(f"rank_{i}"), similarity(F.col("distance")).alias(f"s_{i}")))
            for i, x in enumerate(exemplars)
        ]
        tuples = reduce(lambda x, y: x.unionByName(y), [_covered(each, linked, c) for c in _covers(roles)]).dropDuplicates(names)
        best = tuples.orderBy(*product_order(ranks)).limit(limit).select(*names, score.alias("score")).collect()
        if len(best) >= limit or upto >= k:
            break
        upto *= 4
    return spark.createDataFrame(best, schema)


def beam_shortlist(spark: SparkSession, vectors: DataFrame, edges: DataFrame, exemplars: list[int], beam: int = 100, reach: int = 1000, limit: int = 100) -> DataFrame:
    """Chains of nodes grown along edges, the best ``beam`` at every step.

    Seeds are the nearest neighbours of the first exemplar that have an edge
    out. A chain grows from its last node to the ``reach`` targets most like
    that node; a node's similarity to its role's exemplar adds to the score.
    Equal scores are told apart by the nodes, none is lost. The exemplars
    themselves are always in the beam.
    """
    known = {r.id: list(r.vector) for r in vectors.filter(F.col("id").isin(*exemplars)).collect()}
    if any(x not in known for x in exemplars):
        return spark.createDataFrame([], ", ".join(f"n_{i} long" for i in range(len(exemplars))) + ", score double")

    def to_exemplar(i: int) -> Column:
        return similarity(distance(F.col("vector"), F.array(*[F.lit(float(v)) for v in known[exemplars[i]]])))

    sources = edges.select(F.col("src").alias("id")).distinct()
    own = vectors.join(sources, "id", "left_semi").select(F.col("id").alias("n_0"), to_exemplar(0).alias("score"))
    frontier = own.orderBy(F.desc("score"), "n_0").limit(beam).union(own.filter(F.col("n_0") == exemplars[0])).distinct()
    for i in range(1, len(exemplars)):
        last = f"n_{i - 1}"
        here = vectors.select(F.col("id").alias(last), F.col("vector").alias("here"))
        there = vectors.select(F.col("id").alias(f"n_{i}"), F.col("vector"))
        grown = frontier.join(edges.select(F.col("src").alias(last), F.col("dst").alias(f"n_{i}")), last).join(here, last).join(there, f"n_{i}")
        for j in range(i):
            grown = grown.filter(F.col(f"n_{j}") != F.col(f"n_{i}"))
        near = F.row_number().over(W.partitionBy(*[f"n_{j}" for j in range(i)]).orderBy(distance(F.col("here"), F.col("vector")), f"n_{i}"))
        grown = grown.withColumn("near", near).filter(F.col("near") <= reach)
        roles = [f"n_{j}" for j in range(i + 1)]
        grown = grown.select(*roles, (F.col("score") + to_exemplar(i)).alias("score"))
        own = reduce(lambda x, y: x & y, [F.col(f"n_{j}") == exemplars[j] for j in range(i + 1)])
        best = grown.orderBy(F.desc("score"), *roles).limit(beam)
        frontier = best.union(grown.filter(own)).distinct()
    roles = [f"n_{j}" for j in range(len(exemplars))]
    return frontier.orderBy(F.desc("score"), *roles).limit(limit)

