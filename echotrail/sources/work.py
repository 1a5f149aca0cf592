"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_live: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where unset, the warehouse or (local masters) a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="echotrail-"))
    return _local[0]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path; it is deleted when the interpreter ends, since lazy results may read it until then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _live[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean_up() -> None:
    try:
        for path, spark in _live.items():
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
    except Exception:  # the JVM may be gone; the folder's owner then removes it
        pass


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later uses read it instead of computing it again.

    Many different ids get no dictionary from Parquet; zstd writes them in about two thirds of the bytes of snappy.
    """
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The rounds of an iteration, each written to the shared folder; those that no later one needs are dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, folder(spark, name), 0

    def save(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.root}/{self.n}", self.n + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``save`` gave."""
        for t in tables:
            for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
                delete(self.spark, f)
