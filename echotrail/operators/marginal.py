"""The marginal graph of a transaction table, and typed views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_pair(transactions: DataFrame) -> DataFrame:
    """The two ends of each transaction in order, as ``a`` and ``b``."""
    return transactions.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})


def without_loops_and_outliers(transactions: DataFrame, outliers: tuple[int, ...] = (25, 39)) -> DataFrame:
    """Transactions between different, not excluded nodes."""
    kept = transactions.filter("source <> target")
    return kept.filter(~F.col("source").isin(*outliers) & ~F.col("target").isin(*outliers)) if outliers else kept


def marginal_graph(transactions: DataFrame) -> DataFrame:
    """Per unordered pair: total USD, number of transactions, and USD in either direction.

    One partial-aggregated group-by; a direction without transactions is null.
    """
    usd = F.col("usd")
    return (
        canonical_pair(transactions.filter("source <> target"))
        .groupBy("a", "b")
        .agg(
            F.sum(usd).alias("tot_usd"), F.count("*").alias("num_trans"),
            F.sum(F.when(F.col("source") < F.col("target"), usd)).alias("tot_out"),
            F.sum(F.when(F.col("source") > F.col("target"), usd)).alias("tot_in"),
        )
    )


def connected_pairs(transactions: DataFrame) -> DataFrame:
    """Distinct (source, target)."""
    return transactions.select("source", "target").distinct()


def symmetric_edges(graph: DataFrame, weight: str = "num_trans") -> DataFrame:
    """(src, dst, w) in both directions."""
    one = graph.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col(weight).alias("w"))
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def typed_edges(graph: DataFrame, types: DataFrame, weight: str = "num_trans") -> DataFrame:
    """Each edge once as (t1, t2, src, dst, w) with t1 <= t2; equal types keep the lower id first."""
    edges = (
        graph.select("a", "b", F.col(weight).alias("w"))
        .join(types.select(F.col("node").alias("a"), F.col("type").alias("ta")), "a")
        .join(types.select(F.col("node").alias("b"), F.col("type").alias("tb")), "b")
    )
    turned = F.col("ta") > F.col("tb")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return edges.select(pick("ta", "tb").alias("t1"), pick("tb", "ta").alias("t2"), pick("a", "b").alias("src"), pick("b", "a").alias("dst"), "w")


def link_attributes(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """All attributes of the graph's edges for ``pairs(id1, id2)`` in any order; nulls become 0."""
    wanted = pairs.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()
    return graph.join(wanted, ["a", "b"]).fillna(0, subset=["tot_usd", "tot_out", "tot_in"])


def edge_metadata_key(transactions: DataFrame) -> DataFrame:
    """Per ordered pair the least transid, in its own direction if there is one, else in the other."""
    own = transactions.groupBy("source", "target").agg(F.min("transid").alias("transid"))
    both = own.select("source", "target", "transid", F.lit(0).alias("turned")).union(
        own.select(F.col("target"), F.col("source"), "transid", F.lit(1))
    )
    return both.groupBy("source", "target").agg(F.min_by("transid", F.struct("turned", "transid")).alias("transid"))


def pack_pairs(pairs: DataFrame) -> DataFrame:
    """Two 32-bit ids in one long, the first in the low half."""
    return pairs.select(F.col("source").bitwiseAND(0xFFFFFFFF).bitwiseOR(F.shiftleft(F.col("target").cast("long"), 32)).alias("packed"))


def unpack_pairs(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("packed").bitwiseAND(0xFFFFFFFF).alias("source"), F.shiftright("packed", 32).alias("target"))
