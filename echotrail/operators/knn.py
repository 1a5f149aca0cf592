"""Exact nearest neighbours by feature vectors, and similarities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import save

#: Query vectors that go over all rows at once; more go in further passes.
QUERIES_AT_ONCE = 4096
#: Distances held at once, in numbers.
_BLOCK = 1 << 21


def distance(x: Column, y: Column) -> Column:
    """Euclidean distance of two numeric arrays."""
    squares = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def similarity(d: Column) -> Column:
    """1 / (1 + d), and 0 where the distance is unknown."""
    return F.coalesce(1 / (1 + d), F.lit(0.0))


def pair_similarity(vectors: DataFrame, pairs: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """The similarity of each of ``pairs(id1, id2)``; an unknown id gives 0."""
    own = lambda n: vectors.select(F.col(key).alias(f"id{n}"), F.col(vector).alias(f"v{n}"))
    both = pairs.join(own(1), "id1", "left").join(own(2), "id2", "left")
    return both.select("id1", "id2", similarity(distance(F.col("v1"), F.col("v2"))).alias("similarity"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest rows of each query, itself included.

    Exact. A pass takes QUERIES_AT_ONCE query vectors to every partition,
    which keeps its own best k of each; only those are ranked globally. Ties
    go by the neighbour's id. Vectors with a null element, null vectors and
    null ids are no one's neighbours and have none; so are vectors of another
    length than a query's.
    """
    whole = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    vectors, queries = vectors.filter(whole), queries.filter(whole)
    passes = -(-queries.count() // QUERIES_AT_ONCE)
    if not passes:
        return vectors.sparkSession.createDataFrame([], "query long, neighbour long, distance double, rank int")
    parts = []
    for i in range(passes):
        # a block's vectors are all the driver ever holds; with several, each pass is written
        block = queries if passes == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(passes)) == i)
        asked = sorted((r[0], r[1]) for r in block.select(key, vector).collect())
        for size in sorted({len(v) for _, v in asked}):
            one = _pass(vectors.filter(F.size(vector) == size), [a for a in asked if len(a[1]) == size], k, key, vector)
            parts.append(one if passes == 1 else save(one, "nearest"))
    found = reduce(lambda x, y: x.union(y), parts)
    place = F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour")) - 1
    return found.withColumn("rank", place).filter(F.col("rank") < k)


def keep_best(wanted: np.ndarray, ids: np.ndarray, own: np.ndarray, best_d: np.ndarray, best_n: np.ndarray) -> None:
    """Puts the rows ``own`` among each wanted vector's best so far; ties go by the id."""
    k, step = best_d.shape[1], max(1, _BLOCK // max(1, own.size))
    for lo in range(0, len(wanted), step):
        d = np.sqrt(((wanted[lo : lo + step, None, :] - own[None, :, :]) ** 2).sum(axis=2))
        d = np.hstack([best_d[lo : lo + step], d])
        n = np.hstack([best_n[lo : lo + step], np.broadcast_to(ids, (d.shape[0], len(ids)))])
        at = np.lexsort((n, d), axis=1)[:, :k]
        best_d[lo : lo + step], best_n[lo : lo + step] = np.take_along_axis(d, at, 1), np.take_along_axis(n, at, 1)


def _pass(vectors: DataFrame, asked: list[tuple[int, list[float]]], k: int, key: str, vector: str) -> DataFrame:
    names = np.array([a for a, _ in asked])
    wanted = np.array([v for _, v in asked], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.full((len(names), k), np.inf)
        best_n = np.full((len(names), k), np.iinfo(np.int64).max)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
            keep_best(wanted, ids, own, best_d, best_n)
        ok = np.isfinite(best_d)
        yield pa.record_batch([pa.array(np.repeat(names, ok.sum(axis=1))), pa.array(best_n[ok]), pa.array(best_d[ok])], names=["query", "neighbour", "distance"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(run, "query long, neighbour long, distance double")
