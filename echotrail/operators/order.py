"""Whole-table order without a task that holds it: successors and exact order statistics.

A successor is found after one range shuffle: each task sorts its range and
shifts it by a row, and each range's last row gets the first row of the next
range from a table of a row a range. Order statistics are found by selection:
counts of digit buckets, the bucket of each wanted rank, and again inside it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import save

#: Bits of a value that a round of a selection settles, and the rounds for all 64.
BITS, ROUNDS = 11, 6


def with_next(rows: DataFrame, value: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``rows`` and ``next``: ``value`` of the following row in the whole table's order (null for the last row).

    ``order`` should name a key; rows equal in it follow each other in some
    order. Nulls come first. The number of tasks is ``partitions``, or that of
    Spark's shuffles, whatever the values are: many rows of one day or of one
    time are dealt by the rest of the key. The ranges are written once, as
    range bounds are sampled and would differ if they were worked out twice.
    """
    spark, at = rows.sparkSession, rows.columns.index(value)
    schema = T.StructType([*rows.schema.fields, T.StructField("next", rows.schema[value].dataType)])
    marked = T.StructType([*schema.fields, *[T.StructField(c, T.LongType()) for c in ("_range", "_first", "_last")]])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, first = TaskContext.get().partitionId(), None, 1

        def out(batch: pa.RecordBatch, following: pa.Array, last: int) -> pa.RecordBatch:
            nonlocal first
            n = batch.num_rows
            marks = [np.full(n, number), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)]
            marks[1][0], marks[2][-1], first = first, last, 0
            return pa.record_batch([*batch.columns, following, *map(pa.array, marks)], names=marked.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:  # a batch waits for the first row of the one after it
                own = held.column(at)
                yield out(held, pa.concat_arrays([own.slice(1), batch.column(at).slice(0, 1)]), 0)
            held = batch
        if held is not None:
            own = held.column(at)
            yield out(held, pa.concat_arrays([own.slice(1), pa.nulls(1, own.type)]), 1)

    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    found = save(ranged.sortWithinPartitions(*order).mapInArrow(shift, marked), "ranges")
    # a row for each range, that is for each task of the shuffle: bounded, so it may be sorted at once and broadcast
    firsts = found.filter("_first = 1").select("_range", F.lead(value).over(W.orderBy("_range")).alias("_after"))
    joined = found.join(F.broadcast(firsts.withColumnRenamed("_range", "_of")), (F.col("_range") == F.col("_of")) & (F.col("_last") == 1), "left")
    return joined.withColumn("next", F.when(F.col("_last") == 1, F.col("_after")).otherwise(F.col("next"))).select(*schema.names)


def _sortable(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; NaN comes last, both zeros are one."""
    values = np.where(values == 0, 0.0, np.where(np.isnan(values), np.nan, values))
    bits = values.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _shift(depth: int) -> int:
    """The bits below the digits of ``depth`` rounds."""
    return max(0, 64 - BITS * depth)


def _counts(rows: DataFrame, columns: Sequence[str], depth: int, inside: list[list[int]]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(column, prefix of ``depth`` digits) -> rows, least and greatest value, for prefixes that continue one of ``inside``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for c in range(len(columns)):
                own = batch.column(c)
                keys = _sortable(own.drop_null().to_numpy(zero_copy_only=False))
                if depth > 1:
                    keys = keys[np.isin(keys >> np.uint64(_shift(depth - 1)), np.array(inside[c], dtype=np.uint64))]
                if not len(keys):
                    continue
                keys.sort()
                prefix, start = np.unique(keys >> np.uint64(_shift(depth)), return_index=True)
                ends = np.append(start[1:], len(keys))
                for p, n, lo, hi in zip(prefix.tolist(), (ends - start).tolist(), keys[start].tolist(), keys[ends - 1].tolist(), strict=True):
                    known = held.get((c, p))
                    held[c, p] = [n, lo, hi] if known is None else [known[0] + n, min(known[1], lo), max(known[2], hi)]
        if held:
            # unsigned numbers travel as the longs in the same order
            signed = lambda v: np.array(v, dtype=np.uint64).view(np.int64) ^ np.int64(-(1 << 63))
            yield pa.record_batch(
                [
                    pa.array([k[0] for k in held], pa.int32()), pa.array(signed([k[1] for k in held])), pa.array([v[0] for v in held.values()], pa.int64()),
                    pa.array(signed([v[1] for v in held.values()])), pa.array(signed([v[2] for v in held.values()])),
                ],
                names=["c", "prefix", "n", "lo", "hi"],
            )

    parts = rows.mapInArrow(run, "c int, prefix long, n long, lo long, hi long")
    found = parts.groupBy("c", "prefix").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    back = lambda v: v + (1 << 63)
    return {(r["c"], back(r["prefix"])): (r["n"], back(r["lo"]), back(r["hi"])) for r in found.collect()}


def order_statistics(rows: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """Of each column the exact quantiles at ``shares``, linearly interpolated at rank (n - 1) share; None without values.

    Nulls don't count. Each round reads the columns once, settles BITS bits of
    every wanted rank at a time, and gathers at most 2^BITS counts for each
    wanted rank, whatever the number of rows; where all values of a bucket are
    equal, its ranks are settled at once. ROUNDS rounds suffice for any values.
    """
    rows = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    # (column, wanted rank) -> what is still to be skipped inside the prefix found so far
    open_ranks: dict[tuple[int, int], tuple[int, int]] = {}
    sizes, settled = [0] * len(columns), {}
    for depth in range(1, ROUNDS + 1):
        inside = [sorted({p for (c, _), (p, _) in open_ranks.items() if c == i}) for i in range(len(columns))]
        if depth > 1 and not open_ranks:
            break
        counts = _counts(rows, columns, depth, inside)
        if depth == 1:
            for (c, _), (n, _, _) in counts.items():
                sizes[c] += n
            for i, n in enumerate(sizes):
                ends = {int(np.floor((n - 1) * s)) for s in shares} | {int(np.ceil((n - 1) * s)) for s in shares} if n else set()
                open_ranks |= {(i, r): (0, r) for r in ends}
        after = {}
        width = _shift(depth - 1) - _shift(depth)
        by_parent: dict[tuple[int, int], list[tuple[int, tuple[int, int, int]]]] = {}
        for (c, p), v in sorted(counts.items()):
            by_parent.setdefault((c, p >> width if depth > 1 else 0), []).append((p, v))
        for (c, rank), (prefix, skip) in open_ranks.items():
            for p, (n, lo, hi) in by_parent[c, prefix]:
                if skip < n:
                    if lo == hi:
                        settled[c, rank] = _value(lo)
                    else:
                        after[c, rank] = (p, skip)
                    break
                skip -= n
        open_ranks = after

    def quantile(i: int, share: float) -> float:
        at = (sizes[i] - 1) * share
        lo, hi = int(np.floor(at)), int(np.ceil(at))
        return settled[i, lo] if lo == hi else (hi - at) * settled[i, lo] + (at - lo) * settled[i, hi]

    return {c: [quantile(i, s) for s in shares] if sizes[i] else None for i, c in enumerate(columns)}
