"""A quality score: ridge regression on random Fourier features, calibrated.

Each document gives a vector of statistics (word lengths, symbols, repeats;
never its label, language, source or id). Random Fourier features of the
standardised statistics approximate a Gaussian kernel. Each partition of the
labelled rows sums its normal equations per fold; the sums (a matrix of
DIMENSIONS + 1 squared, whatever the corpus' size) are solved on the driver.
The calibration is isotonic over out-of-fold scores, gathered in a histogram
of BINS bins. All labelled training rows are used, no sample is drawn.

A null or empty text has statistics of 0 and is scored like any other.
Without any training row the score is 0.5. Labels that repeat a doc_id are
averaged; labels without a quality are left out. Every row of the documents
gets a row: rows that repeat a doc_id each count as a training row, rows
without one are scored but never learned from (their crc32 is the empty
text's, 0, so they are held out). Equal texts have equal scores. An empty table
gives an empty one; its columns may have any further names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, crc32_text, map_batches, slices, table, texts_of
from .stats import FEATURES, features

DIMENSIONS, BANDWIDTH, RIDGE, FOLDS, BINS, BLOCK = 256, 3.0, 1e-3, 4, 2000, 16
THRESHOLD = 0.3


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the document's statistics, for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        rows = np.concatenate([features(texts[lo:hi]) for lo, hi in slices(texts)]).astype(np.float32)
        ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
        return pa.record_batch([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["doc_id", "x"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, x array<float>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


class FourierMap:
    """z(x) with z(x).z(y) close to exp(-|x - y|^2 / (2 BANDWIDTH^2)), and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.omega = rng.normal(0, 1 / BANDWIDTH, (len(mean), DIMENSIONS))
        self.phase = rng.uniform(0, 2 * np.pi, DIMENSIONS)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / DIMENSIONS) * np.cos(x @ self.omega + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The non-decreasing fit (pool adjacent violators) of means ``value``."""
    blocks: list[list[float]] = []
    for w, v in zip(weight.tolist(), value.tolist(), strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks]) if blocks else np.empty(0)


class Model:
    """Raw ridge scores, calibrated by linear interpolation between (at, level)."""

    def __init__(self, fourier: FourierMap | None, weights: np.ndarray | None, at: np.ndarray, level: np.ndarray):
        self.fourier, self.weights, self.at, self.level = fourier, weights, at, level

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.fourier(x) @ self.weights, self.at, self.level), 0, 1)


def train(labelled: DataFrame) -> Model:
    """A model of ``labelled(doc_id, x, y)``."""
    width = len(FEATURES)
    spread = labelled.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not spread:
        return Model(None, None, np.array([0.0]), np.array([0.5]))
    mean, scale = np.zeros(width), np.ones(width)
    for r in spread:
        mean[r.i], scale[r.i] = r.m, max(r.s, 1e-3)
    fourier = FourierMap(mean, scale)
    rows = labelled.select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's [Z'Z | Z'y] per fold, in blocks of rows."""
        total = np.zeros((FOLDS, DIMENSIONS + 1, DIMENSIONS + 2))
        for batch in batches:
            z, y = fourier(_matrix(batch.column(0), width)), batch.column(1).to_numpy()
            fold = batch.column(2).to_numpy()
            for k in range(FOLDS):
                zk = z[fold == k]
                total[k] += zk.T @ np.hstack([zk, y[fold == k, None]])
        out = [(k, lo, total[k, lo : lo + BLOCK].ravel()) for k in range(FOLDS) if total[k].any() for lo in range(0, DIMENSIONS + 1, BLOCK)]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["fold", "lo", "part"])

    def add(group: pa.Table) -> pa.Table:
        part = group.column("part").combine_chunks()
        summed = part.flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"fold": group.column("fold")[:1], "lo": group.column("lo")[:1], "part": pa.array([summed], pa.list_(pa.float64()))})

    schema = "fold int, lo int, part array<double>"
    parts = rows.mapInArrow(equations, schema).groupBy("fold", "lo").applyInArrow(add, schema).collect()
    total = np.zeros((FOLDS, DIMENSIONS + 1, DIMENSIONS + 2))
    for r in parts:
        block = np.asarray(r.part).reshape(-1, DIMENSIONS + 2)
        total[r.fold, r.lo : r.lo + len(block)] = block

    def solve(a: np.ndarray) -> np.ndarray:
        penalty = RIDGE * max(a[-1, -2], 1.0) * np.eye(DIMENSIONS + 1)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(a[:, :-1] + penalty, a[:, -1])

    weights, every = [solve(total.sum(axis=0) - total[k]) for k in range(FOLDS)], solve(total.sum(axis=0))

    def held_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        z, fold = fourier(_matrix(batch.column(0), width)), batch.column(2).to_numpy()
        raw = np.einsum("ij,ij->i", z, np.stack(weights)[fold])
        bins = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int32), 0, BINS - 1)
        return pa.record_batch([pa.array(bins), batch.column(1)], names=["bin", "y"])

    counts = map_batches(rows, ["x", "y", "fold"], held_out, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    level = isotonic(np.array([r.n for r in counts], dtype=float), np.array([r.y for r in counts]))
    at = (np.array([r.bin for r in counts]) + 0.5) / BINS * 2 - 0.5
    return Model(fourier, every, at, level)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, work: Work | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)``; rows whose crc32(doc_id) is divisible by 5
    are never learned from.
    """
    work = work or Work(spark, "quality")
    drawn = work.save(statistics(docs), "statistics")
    y = labels.filter("quality is not null").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    labelled = drawn.filter(crc32_text("doc_id") % 5 != 0).join(y, "doc_id").select("doc_id", "x", "y")
    model = train(work.save(labelled, "labelled"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array(model.score(_matrix(batch.column(1), len(FEATURES))))], names=["doc_id", "score"])

    scored = map_batches(drawn, ["doc_id", "x"], run, "doc_id long, score double")
    return scored.select(
        "doc_id", (crc32_text("doc_id") % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
