"""Shared plumbing: tables, the shared work folder, Arrow batches.

Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir`` (every executor sees it), so a lost executor costs
only the tasks it ran: what was written is read again, nothing is recomputed
from a half-gone cache.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import delete, shared_dir

#: Rows and bytes of one Arrow batch; they bound a Python worker's memory
#: whatever the texts' lengths are.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; any path Spark itself can read works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow and Parquet batches by rows and bytes.

    These are settings of the session and stay, as a lazy result is only run
    after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # rows of text that the Parquet reader decodes at once: its vectors double their size as they fill
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


class Work:
    """Intermediate tables of one query in the shared folder.

    ``save`` writes a DataFrame and reads it back, which cuts the lineage.
    ``drop`` deletes a table that is no longer needed; what is left (tables a
    lazy result still reads) goes when the interpreter ends.
    """

    _live: set[str] = set()
    _spark: SparkSession | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Work._spark = spark
        Work._live.add(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def free_shuffles(self) -> None:
        """Let Spark's cleaner delete shuffle files no live plan needs."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean_up() -> None:
    spark = Work._spark
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            for root in Work._live:
                delete(spark, root)
    except Exception:  # the JVM may be gone; the folder's owner then removes it
        pass


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a column, for sizing partitions; counted, so any source or derived frame will do."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def partitions_for(spark: SparkSession, total_bytes: int, target: int) -> int:
    """Partitions of about ``target`` bytes, at least one per core."""
    return max(int(spark.sparkContext.defaultParallelism), 1 + total_bytes // target)


def crc32_text(column: str) -> Column:
    """crc32 of a column's value as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (or one long text)."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(x)
    if lo < len(texts):
        yield lo, len(texts)


def map_batches(
    df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str
) -> DataFrame:
    """Arrow batches of the named columns through ``fn``; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def as_column(values: np.ndarray) -> pa.Array:
    """uint64 values travel as the long with the same bits."""
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)
