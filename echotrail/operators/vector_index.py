"""A persisted index for exact nearest neighbours: cells around pivots, cut into rings.

Each row belongs to the nearest of a bounded number of pivots and lies in a
ring around it; a ring with many rows is dealt out further by the id's hash.
These units carry their number of rows and their least and greatest distance
to the pivot. By the triangle inequality no row of a unit is nearer to a query
than the query's distance to the pivot is outside that range. So a search
visits units in order of this bound, in growing waves, and stops for a query
where the bound exceeds its k-th best distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import save
from .knn import QUERIES_AT_ONCE, keep_best

#: Pivots at most (they travel with the tasks); rings of a cell at most, one for so many rows; and rows of a unit, on average at most.
PIVOTS, RINGS, RING_ROWS, UNIT_ROWS = 1024, 16, 500, 20_000
#: How much farther than the last one a wave goes in a query's list of units.
WAVE = 8
#: Rounding that a bound allows for, as a share of the distances it is made of.
_SLACK = 1e-9


def _whole(key: str, vector: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, bad)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = len(column)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _to_pivots(own: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of some rows to all pivots, a pivot at a time."""
    out = np.empty((len(own), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((own - p) ** 2).sum(axis=1))
    return out


def write_vector_index(vectors: DataFrame, path: str, key: str = "id", vector: str = "vector", pivots: int | None = None) -> None:
    """Index ``vectors(key, vector)`` in a folder: ``rows`` by cell, ``units``, and ``pivots``.

    Vectors of another length than the most frequent one (the shortest of
    equally frequent ones), those with null or non-finite entries and rows
    without an id are left out. Pivots are the rows with the least hashes of
    their ids, about as many as the square root of all rows, PIVOTS at most.
    """
    spark = vectors.sparkSession
    good = vectors.filter(_whole(key, vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    top = good.groupBy(F.size("vector").alias("length")).count().filter("length > 0").orderBy(F.desc("count"), "length").first()
    length, n = (top[0], top[1]) if top else (0, 0)
    good = good.filter((F.size("vector") == length) & (length > 0))
    chosen = good.orderBy(F.xxhash64("id"), "id", "vector").limit(pivots or min(PIVOTS, int(np.ceil(np.sqrt(n))) or 1)).select("vector").collect()
    chosen = sorted({tuple(r[0]) for r in chosen})
    spark.createDataFrame([(i, list(p)) for i, p in enumerate(chosen)], "cell int, pivot array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
    at = np.array(chosen, dtype=np.float64).reshape(len(chosen), length)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _to_pivots(_matrix(batch.column(1)), at)
                cell = d.argmin(axis=1)
                columns = [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
                yield pa.record_batch(columns, names=["id", "vector", "cell", "from_pivot"])

    rows = save(good.mapInArrow(placed, "id long, vector array<double>, cell int, from_pivot double"), "placed")
    rings = F.least(F.lit(RINGS), F.ceil(F.count("*") / RING_ROWS)).cast("int")
    sizes = rows.groupBy("cell").agg(rings.alias("rings"), F.max("from_pivot").alias("width"))  # a row a pivot
    ring = F.when(F.col("width") > 0, F.least(F.floor(F.col("from_pivot") / F.col("width") * F.col("rings")), F.col("rings") - 1)).otherwise(0).cast("int")
    ringed = rows.join(F.broadcast(sizes), "cell").withColumn("ring", ring).drop("width", "rings")
    deals = ringed.groupBy("cell", "ring").agg((F.floor(F.count("*") / UNIT_ROWS) + 1).alias("deals"))  # RINGS rows a pivot
    dealt = ringed.join(F.broadcast(deals), ["cell", "ring"]).withColumn("deal", F.pmod(F.xxhash64("id"), F.col("deals"))).drop("deals")
    parts = max(spark.sparkContext.defaultParallelism, n // UNIT_ROWS + 1)
    dealt = dealt.repartitionByRange(parts, "cell", "ring", "deal").sortWithinPartitions("cell", "ring", "deal")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    kept = _rows(spark, path)
    units = kept.groupBy("cell", "ring", "deal").agg(F.count("*").alias("n"), F.min("from_pivot").alias("lo"), F.max("from_pivot").alias("hi"))
    units.write.mode("overwrite").parquet(f"{path}/units")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, vector array<double>, from_pivot double, ring int, deal long, cell int").parquet(f"{path}/rows")


def search_vector_index(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str = "id", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """The rows that ``knn.nearest`` gives: (query, neighbour, distance, rank); and (query, units, rows) that were visited for them.

    Queries go QUERIES_AT_ONCE at a time. Those of another length than the
    index, with null or non-finite entries or without an id, have no neighbours.
    """
    kept = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()  # PIVOTS at most
    pivots = np.array([r.pivot for r in kept], dtype=np.float64).reshape(len(kept), len(kept[0].pivot) if kept else 0)
    asked = queries.filter(_whole(key, vector) & (F.size(vector) == pivots.shape[1] if len(kept) else F.lit(False)))
    asked = save(asked.select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("wanted")).dropDuplicates(["query"]), "asked")
    passes = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    each = [_search(spark, path, asked.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == i), pivots, k) for i in range(passes)]
    found, visited = (reduce(lambda x, y: x.union(y), own) for own in zip(*each, strict=True))
    return found, visited


def _search(spark: SparkSession, path: str, asked: DataFrame, pivots: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _to_pivots(_matrix(batch.column(1)), pivots)
                cells = np.tile(np.arange(len(pivots), dtype=np.int32), len(d))
                yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), len(pivots))), pa.array(cells), pa.array(d.ravel())], names=["query", "cell", "d"])

    def near(wanted: pa.Table, own: pa.Table) -> pa.Table:
        names, ids = wanted.column("query").to_numpy(), own.column("id").to_numpy()
        best_d, best_n = np.full((len(names), k), np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
        if len(names) and len(ids):
            keep_best(_matrix(wanted.column("wanted")), ids, _matrix(own.column("vector")), best_d, best_n)
        ok = np.isfinite(best_d)
        return pa.table([pa.array(np.repeat(names, ok.sum(axis=1))), pa.array(best_n[ok]), pa.array(best_d[ok])], names=["query", "neighbour", "distance"])

    unit, schema = ["cell", "ring", "deal"], "query long, neighbour long, distance double"
    bound = F.greatest(F.lit(0.0), F.col("d") - F.col("hi"), F.col("lo") - F.col("d")) - _SLACK * (F.col("d") + F.col("hi"))
    order = W.partitionBy("query").orderBy("bound", *unit)
    visits = asked.mapInArrow(distances, "query long, cell int, d double").join(spark.read.parquet(f"{path}/units"), "cell").withColumn("bound", bound)
    visits = visits.withColumn("place", F.row_number().over(order)).withColumn("before", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)))
    visits = save(visits.select("query", *unit, "n", "bound", "place", F.coalesce("before", F.lit(0)).alias("before")), "visits")
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour")) - 1
    best, visited = spark.createDataFrame([], schema + ", rank int"), []
    # first the units that hold k rows, then ever more of those that may hold a nearer one
    own, upto = visits.filter(F.col("before") < k), 1
    rest = visits.filter(F.col("before") >= k)
    while True:
        own = save(own.select("query", *unit, "n"), "wave")
        visited.append(own)
        cells = [r[0] for r in own.select("cell").distinct().collect()]  # PIVOTS at most
        rows = _rows(spark, path).filter(F.col("cell").isin(cells)).join(own.select(*unit).distinct(), unit, "left_semi")
        wanted = own.join(asked, "query").select(*unit, "query", "wanted")
        found = wanted.groupBy(*unit).cogroup(rows.groupBy(*unit)).applyInArrow(near, schema)
        best = save(best.drop("rank").union(found).withColumn("rank", rank).filter(F.col("rank") < k), "best")
        radius = best.filter(F.col("rank") == k - 1).select("query", F.col("distance").alias("radius"))
        may = rest.join(radius, "query", "left").filter("radius is null or bound <= radius")
        left = may.filter(F.col("place") > upto)
        if left.isEmpty():
            break
        own, upto = left.filter(F.col("place") <= upto * WAVE), upto * WAVE
    seen = reduce(lambda x, y: x.union(y), visited).groupBy("query").agg(F.count("*").alias("units"), F.sum("n").alias("rows"))
    return best, seen
