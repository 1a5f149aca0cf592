"""Whitening of embeddings by a tall-skinny QR, without a covariance matrix.

An entry c becomes the whole number x = floor(1024 c) + 100000. Sums of x over
the fit list (every usable row) are exact, so n x - S is exact too; divided by
n it is the centred row. Each partition folds its centred rows, batch by batch,
into the R factor of their QR decomposition; R factors are merged by tree, FAN
at a time, until one is left (dimension squared numbers, whatever the number of
rows). Its singular values s and right vectors give the components: eigenvalue
s^2 / n, falling, and a row's whitened value is the centred row's projection
over the eigenvalue's root. The whitened values' own covariance is gathered
the same way (count, mean and centred products of each partition, merged by
tree) and compared with the identity.

Rows whose vector is null, or holds a null, NaN or infinite entry, are dropped,
and so are those with an entry beyond 2^43 (their x would not be exact), and
those of another length than the most frequent one (of equally frequent ones
the longest). Repeated rows count as often as they stand; a row without vec_id
is a row like others. Equal eigenvalues have some orthogonal choice of vectors.
A direction without variance (below DUST of the largest singular value) can't
be whitened: its whitened value is null and its share what it is; a table
without any variance has null shares. ``deviation`` is null where it exceeds a
long, which ``deviation_text`` never does. An empty table gives an empty one,
and other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Partial results merged by one task.
FAN = 32
#: Singular values under this share of the largest count as none.
DUST = 1e-11
_EXACT = 1 << 43
#: Rows whose factor is taken at once.
ROWS = 2048


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the vector as doubles, without the rows that can't be used."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    fine = given.filter("vector is not null and size(vector) > 0").filter(
        F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(float(_EXACT))))
    )
    sizes = fine.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows"))
    found = sizes.agg(F.max_by("size", F.struct("rows", "size")).alias("size")).first()["size"]
    return fine.filter(F.size("vector") == F.lit(-1 if found is None else found))


def whole_numbers(batch: pa.RecordBatch) -> np.ndarray:
    """A row's x in each row of a matrix."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(batch.num_rows, -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as 64-bit numbers where these hold them, else as Python's."""
    most = max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums)))
    if most < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(z: np.ndarray) -> list[int]:
    """Each row's exact sum of squares."""
    if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 1 << 63:
        return (z * z).sum(axis=1).tolist()
    z = z.astype(object)
    return (z * z).sum(axis=1).tolist()


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows, and the sum of x in each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch)
                own = [int(v) for v in (x if _small(x) else x.astype(object)).sum(axis=0)]
                total, n = own if total is None else [a + b for a, b in zip(total, own, strict=True)], n + batch.num_rows
        if n:
            yield pa.record_batch(
                [pa.array([n] * len(total)), pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total])], names=["n", "dim", "total"]
            )

    parts = rows.select("vector").mapInArrow(partial, "n long, dim int, total string")
    # decimals hold the exact sum of what any number of partitions have summed exactly
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def _small(x: np.ndarray) -> bool:
    """Whether sums of x fit 64 bits."""
    return len(x) * int(np.abs(x).max(initial=0)) < 1 << 63


def merged(parts: DataFrame, n_parts: int, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One array from those of the partitions (columns part, body), merged by tree in the order of the parts."""

    def step(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(b.column("part").to_pylist(), b.column("body").to_pylist(), strict=True)), key=lambda r: r[0])
        body = merge([np.frombuffer(r[1]) for r in rows])
        yield pa.record_batch([pa.array([rows[0][0] // FAN]), pa.array([body.tobytes()], pa.binary())], names=["part", "body"])

    while n_parts > 1:
        parts = parts.groupBy((F.col("part") / FAN).cast("long").alias("group")).applyInArrow(step, "part long, body binary")
        n_parts = -(-n_parts // FAN)
    row = parts.first()
    return None if row is None else np.frombuffer(row["body"])


def by_partition(rows: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> DataFrame:
    """A partition's number and what ``fold`` makes of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = fold(b for b in batches if b.num_rows)
        if body is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([body.tobytes()], pa.binary())], names=["part", "body"])

    return rows.mapInArrow(run, "part long, body binary")


def triangle(rows: np.ndarray) -> np.ndarray:
    """The R factor, of as many rows as columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def tsqr(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The R factor of the centred rows."""
    d = len(sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        r = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                centred = (deviations(whole_numbers(batch.slice(lo, ROWS)), n, sums) / n).astype(float)
                r = triangle(centred if r is None else np.vstack([r, centred]))
        return r

    found = merged(by_partition(rows, fold), rows.rdd.getNumPartitions(), lambda bodies: triangle(np.vstack([b.reshape(d, d) for b in bodies])))
    return found.reshape(d, d)


class Moments:
    """Count, mean and centred products of whitened rows, as one array, so that any two can be merged."""

    @staticmethod
    def of(w: np.ndarray) -> np.ndarray:
        mean = w.mean(axis=0)
        return np.concatenate(([len(w)], mean, ((w - mean).T @ (w - mean)).ravel()))

    @staticmethod
    def merge(bodies: list[np.ndarray]) -> np.ndarray:
        k = int(round((4 * len(bodies[0]) - 3) ** 0.5 - 1)) // 2
        counts, means = np.array([b[0] for b in bodies]), np.array([b[1 : k + 1] for b in bodies])
        mean = counts @ means / counts.sum()
        apart = means - mean
        inside = np.sum([b[k + 1 :].reshape(k, k) for b in bodies], axis=0)
        return np.concatenate(([counts.sum()], mean, (inside + (apart.T * counts) @ apart).ravel()))


def whitened(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: see the module's text."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, column)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    n, sums = exact_sums(rows)
    if not n:
        return spark.createDataFrame([], schema)
    _, s, right = np.linalg.svd(tsqr(rows, n, sums))
    k = min(components, len(sums))
    varied = s[:k] > DUST * max(s[0], 1e-300)
    axes = right[:k].T[:, varied] / (s[:k][varied] / np.sqrt(n))
    total = float((s**2).sum())
    explained = [float(v * v / total) if total else None for v in s[:k]]

    def project(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        z = deviations(whole_numbers(batch), n, sums)
        return z, (z / n).astype(float) @ axes

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        held = None
        for batch in batches:
            own = Moments.of(project(batch)[1])
            held = own if held is None else Moments.merge([held, own])
        return held

    m = int(varied.sum())
    error = None
    if m:
        moments = merged(by_partition(rows, fold), rows.rdd.getNumPartitions(), Moments.merge)
        error = float(np.abs(moments[m + 1 :].reshape(m, m) / n - np.eye(m)).max())
    at = np.flatnonzero(varied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, own = project(batch)
            values = np.full((batch.num_rows, k), np.nan)
            values[:, at] = own
            exact = squares(z)
            repeat = np.repeat(np.arange(batch.num_rows), k)
            rows_of = batch.num_rows * k
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(rows_of, n)), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(pa.array(repeat)),
                    pa.array(values.ravel(), mask=np.tile(~varied, batch.num_rows)), pa.array(explained * batch.num_rows, pa.float64()),
                    pa.array([error] * rows_of, pa.float64()), pa.array([str(v) for v in exact]).take(pa.array(repeat)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"],
            )

    return rows.mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
