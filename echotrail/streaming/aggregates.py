"""The marginal graph and time series over a stream of transactions.

These are additions for continuous ingest; the batch forms define the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.marginal import canonical_pair


def windowed_marginal_graph(stream: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Per window and unordered pair: the marginal graph's sums. Later rows than ``lateness`` are dropped by the watermark."""
    usd = F.col("usd")
    return (
        canonical_pair(stream.withWatermark("time", lateness).filter("source <> target"))
        .groupBy(F.window("time", window), "a", "b")
        .agg(
            F.sum(usd).alias("tot_usd"), F.count("*").alias("num_trans"),
            F.sum(F.when(F.col("source") < F.col("target"), usd)).alias("tot_out"),
            F.sum(F.when(F.col("source") > F.col("target"), usd)).alias("tot_in"),
        )
        .select(F.col("window.start").alias("start"), "a", "b", "tot_usd", "num_trans", "tot_out", "tot_in")
    )


def merged_graph(windows: DataFrame) -> DataFrame:
    """The marginal graph of all windows together: sums add up."""
    return windows.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("tot_usd", "num_trans", "tot_out", "tot_in")])


def windowed_flows(stream: DataFrame, window: str = "7 days", lateness: str = "1 day") -> DataFrame:
    """Per window and entity: USD in and out."""
    rows = stream.withWatermark("time", lateness)
    sides = rows.select("time", F.inline(F.array(F.struct(F.col("source").alias("entity"), (-F.col("usd")).alias("v")), F.struct(F.col("target").alias("entity"), F.col("usd").alias("v")))))
    return (
        sides.groupBy(F.window("time", window), "entity")
        .agg(F.sum(F.when(F.col("v") > 0, F.col("v")).otherwise(0.0)).alias("incoming"), F.sum(F.when(F.col("v") < 0, -F.col("v")).otherwise(0.0)).alias("outgoing"))
        .select(F.col("window.start").alias("start"), "entity", "incoming", "outgoing")
    )
