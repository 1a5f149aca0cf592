"""Packing token sequences into as few rows of CAPACITY tokens as can be.

Only the histogram of piece lengths (at most CAPACITY counts) reaches the
driver, whatever the corpus' size. There, the configuration linear program of
bin packing is solved by multiplicative weights: a length's price is its own
size times a weight that grows while it lags behind in coverage. Each round a
knapsack dynamic program finds, for every room, what is worth most at these
prices; each lagging length gets the configuration that completes it best, as
often as it lags. All lengths and all configurations count. The solution is
rounded along the sorted configurations, whose running sum is rounded, so that
the number of rows stays; a row is used if all its pieces are there. The
remainder is placed best-fit, longest first, on counts rather than single
pieces. The pieces then find their places by their rank within their length,
so no group of pieces meets in one task.

A null or empty text is a piece of one token (the end id). Repeated doc_ids
are packed like other rows. An empty table packs into nothing.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Work, map_batches, table, texts_of
from .tokens import decoded, encoder, vocabulary

CAPACITY, END_ID = 1024, 2
#: Rounds of the linear program, and how fast weights grow.
ROUNDS, RATE = 400, 8.0
#: Pieces ranked in one bucket, on average.
RANKED = 250_000

#: A configuration: (length, multiplicity) pairs, and how many rows have it.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def knapsack_table(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack by dynamic programming, for sorted sizes: each room's best value, and an item that is in it.

    The item is -1 where the room is not used up; the best is then that of one less.
    """
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(int(sizes[0]), capacity + 1):
        n = int(np.searchsorted(sizes, c, side="right"))
        gain = values[:n] + best[c - sizes[:n]]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], pick[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    return best, pick


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """The configuration program by multiplicative weights: how many rows each configuration (lengths, falling) gets."""
    rounds = max(1, min(ROUNDS, int(counts.sum())))
    covered, used = np.zeros(len(sizes)), {}
    for t in range(1, rounds + 1):
        price = sizes * np.exp(RATE * np.clip(t / rounds - covered / counts, -3, 3))
        _, pick = knapsack_table(price, sizes, capacity)
        fill: list[tuple[int, ...]] = [()] * (capacity + 1)
        for c in range(1, capacity + 1):
            k = int(pick[c])
            fill[c] = fill[c - 1] if k < 0 else (*fill[c - int(sizes[k])], k)
        for i in range(len(sizes) - 1, -1, -1):
            lag = t / rounds * counts[i] - covered[i]
            if lag > 1e-9:
                config = (i, *fill[capacity - int(sizes[i])])
                n = lag / config.count(i)
                for k in config:
                    covered[k] += n
                key = tuple(sorted((int(sizes[k]) for k in config), reverse=True))
                used[key] = used.get(key, 0.0) + n
    return used


def rounded(solution: dict[tuple[int, ...], float], left: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """Whole rows of a solution: the running sum of its configurations, largest first, is rounded. Takes the pieces out of ``left``."""
    bins, upto = [], 0.0
    for config in sorted(solution, reverse=True):
        before = math.floor(upto + 0.5)
        upto += solution[config]
        need = {x: config.count(x) for x in config}
        n = min([math.floor(upto + 0.5) - before, *(left[x] // k for x, k in need.items())])
        if n:
            for x, k in need.items():
                left[x] -= n * k
            bins.append((config, n))
    return bins


def best_fit(histogram: dict[int, int], capacity: int, bins: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts, into these bins and new ones."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for config, n in bins:
        room.setdefault(capacity - sum(config), []).append((config, n))
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = [r for r in room if r >= length]
            if fits:
                r = min(fits)
                config, n = room[r].pop()
                k = min(left, n)
                if n > k:
                    room[r].append((config, n - k))
                if not room[r]:
                    del room[r]
                room.setdefault(r - length, []).append(((*config, length), k))
                left -= k
            else:
                each = capacity // length
                for m, n in ((each, left // each), (left % each, 1)):
                    if m and n:
                        room.setdefault(capacity - m * length, []).append(((length,) * m, n))
                left = 0
    return [x for group in room.values() for x in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Configurations and their counts that hold exactly the pieces of the histogram."""
    left = {k: v for k, v in histogram.items() if v > 0 and k < capacity}
    sizes = np.array(sorted(left), dtype=np.int64)
    solution = fractional(sizes, np.array([left[k] for k in sizes.tolist()], dtype=float), capacity) if left else {}
    bins = rounded(solution, left)
    found = best_fit({k: v for k, v in left.items() if v}, capacity, bins)
    if histogram.get(capacity):
        found.append(((capacity,), histogram[capacity]))
    merged: dict[tuple[tuple[int, int], ...], int] = {}
    for config, n in found:
        key = tuple((k, config.count(k)) for k in sorted(set(config), reverse=True))
        merged[key] = merged.get(key, 0) + n
    return sorted(merged.items())


class Places:
    """Where the piece of a given rank within its length goes."""

    def __init__(self, plan: Plan):
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        row = 0
        for config, n in plan:
            offset = 0
            for length, m in config:
                slots.setdefault(length, []).append((n * m, m, row, offset))
                offset += length * m
            row += n
        self.rows = row
        self.slots = {k: np.array(v, dtype=np.int64) for k, v in slots.items()}
        self.ends = {k: np.cumsum(v[:, 0]) for k, v in self.slots.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for x in np.unique(length).tolist():
            at = np.flatnonzero(length == x)
            i = np.searchsorted(self.ends[x], rank[at], side="right")
            size, m, first, begin = self.slots[x][i].T
            within = rank[at] - (self.ends[x][i] - size)
            row[at], offset[at] = first + within // m, begin + within % m * x
        return row, offset


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path).ids
        ids, piece, start, length, crc = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            tokens = np.append(encode(decoded(text)), np.uint32(END_ID)).astype("<u4")
            data = memoryview(tokens.tobytes())
            n = len(tokens)
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                ids.append(doc)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(data[4 * a : 4 * b]))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip((ids, piece, start, length, crc), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, work: Work | None = None) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``, each with its sequence_id and offset."""
    work = work or Work(spark, "packing")
    cut = work.save(pieces(docs, path or vocabulary(), capacity), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    # rank within a length: a bucket's earlier buckets, then the order in the bucket
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + sum(histogram.values()) // RANKED)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    cut = cut.withColumn("nth", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = cut.join(sizes.select("length", "bucket", upto.alias("before")), ["length", "bucket"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, offset = places.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
        return pa.record_batch([*batch.columns[:5], pa.array(row), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    ranked = ranked.select(*columns, (F.col("before") + F.col("nth")).alias("rank"))
    return map_batches(ranked, [*columns, "rank"], run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"))
