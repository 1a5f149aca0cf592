"""Which users are active, and the transactions among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import Rounds


def _side(transactions: DataFrame, column: str) -> DataFrame:
    return transactions.groupBy(F.col(column).alias("user")).agg(F.count("*").alias("n"))


def activity(transactions: DataFrame, mode: str = "bag") -> DataFrame:
    """(user, n): the number of transactions as source plus as target.

    mode "union_distinct" adds equal counts only once, as a distinct union of
    (user, count) rows does.
    """
    both = _side(transactions, "source").union(_side(transactions, "target"))
    if mode == "union_distinct":
        both = both.distinct()
    elif mode != "bag":
        raise ValueError("mode must be bag or union_distinct")
    return both.groupBy("user").agg(F.sum("n").alias("n"))


def active_users(transactions: DataFrame, least: int = 10, excluded: tuple[int, ...] = (25,), mode: str = "bag") -> DataFrame:
    """Users with at least ``least`` transactions; an excluded id counts on neither side."""
    own = lambda c: _side(transactions.filter(~F.col(c).isin(*excluded)) if excluded else transactions, c)
    both = own("source").union(own("target"))
    if mode == "union_distinct":
        both = both.distinct()
    return both.groupBy("user").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def inactive_users(transactions: DataFrame, least: int = 10, mode: str = "union_distinct") -> DataFrame:
    return activity(transactions, mode).filter(F.col("n") < least)


def without_users(transactions: DataFrame, users: DataFrame) -> DataFrame:
    gone = users.select("user").distinct()
    return transactions.join(gone.withColumnRenamed("user", "source"), "source", "left_anti").join(gone.withColumnRenamed("user", "target"), "target", "left_anti")


def activity_fixpoint(transactions: DataFrame, least: int = 10, mode: str = "union_distinct", max_rounds: int = 100) -> DataFrame:
    """The transactions left when users under ``least`` are dropped again and again.

    A round counts the written pairs of source and target without the users
    dropped so far and writes those it drops; the transactions themselves are
    read once, at the end.
    """
    rounds, gone = Rounds(transactions.sparkSession, "activity"), None
    ends = rounds.save(transactions.select("source", "target"))
    for _ in range(max_rounds):
        fresh = rounds.save(inactive_users(ends if gone is None else without_users(ends, gone), least, mode).select("user"))
        if fresh.isEmpty():
            rounds.drop(ends)
            return transactions if gone is None else without_users(transactions, gone).select(transactions.columns)
        gone = fresh if gone is None else rounds.save(gone.union(fresh))
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def users_in(transactions: DataFrame, users: DataFrame) -> DataFrame:
    """The rows of ``users(user, ...)`` that still have a transaction."""
    ends = transactions.select(F.col("source").alias("user")).union(transactions.select("target"))
    return users.join(ends, "user", "left_semi")


def between_users(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """The pairs whose both ends are among ``users(user)``."""
    own = users.select("user")
    return pairs.join(own.withColumnRenamed("user", "source"), "source", "left_semi").join(own.withColumnRenamed("user", "target"), "target", "left_semi")


def busy_users(transactions: DataFrame, more_than: int = 5) -> DataFrame:
    """Users with over ``more_than`` debits or over ``more_than`` credits, and both counts."""
    debits = _side(transactions, "source").withColumnRenamed("n", "debits")
    credits = _side(transactions, "target").withColumnRenamed("n", "credits")
    both = debits.join(credits, "user", "full").fillna(0, ["debits", "credits"])
    return both.filter((F.col("debits") > more_than) | (F.col("credits") > more_than))


def counts_over(transactions: DataFrame, more_than: int = 5) -> DataFrame:
    """The distinct union of each side's (user, count) above ``more_than``."""
    side = lambda c: _side(transactions, c).filter(F.col("n") > more_than)
    return side("source").union(side("target")).distinct()
