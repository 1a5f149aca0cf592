"""Currency conversion, per-user averages and deviations of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_rate(transactions: DataFrame, rates: DataFrame, day: str = "day") -> DataFrame:
    """``rate`` of each transaction's day from ``rates(day, rate)``.

    Days before the first rate have the first, days after the last the last;
    a day missing in between has 0. The rates are one row a day, joined by
    day; their ends come from a one-row aggregate.
    """
    ends = rates.agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min_by("rate", "day").alias("first_rate"), F.max_by("rate", "day").alias("last_rate")
    )
    joined = transactions.join(rates.select(F.col("day").alias(day), "rate"), day, "left").join(F.broadcast(ends), how="left")
    clamped = F.when(F.col(day) < F.col("first_day"), F.col("first_rate")).when(F.col(day) > F.col("last_day"), F.col("last_rate"))
    return joined.withColumn("rate", F.coalesce("rate", clamped, F.lit(0.0))).drop("first_day", "last_day", "first_rate", "last_rate")


def user_averages(transactions: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Per user, or per one of ``users(user)``: the mean USD of what they paid (debit) and got (credit), 0 where there is none."""
    paid = transactions.select(F.col("source").alias("user"), F.col("usd").alias("debit"), F.lit(None).cast("double").alias("credit"))
    got = transactions.select(F.col("target").alias("user"), F.lit(None).cast("double").alias("debit"), F.col("usd").alias("credit"))
    both = paid.union(got) if users is None else paid.union(got).join(users, "user", "left_semi")
    return both.groupBy("user").agg(F.coalesce(F.avg("debit"), F.lit(0.0)).alias("avg_debit"), F.coalesce(F.avg("credit"), F.lit(0.0)).alias("avg_credit"))


def deviations(transactions: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """devpop, creditdev and debitdev of each transaction, or of ``rows``, some of them, alone.

    They compare its USD with the mean of all, with what the *source* gets on
    average, and with what the *target* pays on average; an average of 0
    gives -1.
    """
    wanted = None if rows is None else rows.select(F.col("source").alias("user")).union(rows.select("target")).distinct()
    users = user_averages(transactions, wanted)
    mean = transactions.agg(F.avg("usd").alias("avg_usd"))
    off = lambda c: F.when(F.col(c) == 0, F.lit(-1.0)).otherwise(F.try_divide(F.col("usd") - F.col(c), F.col(c)))
    return (
        (transactions if rows is None else rows).join(users.select(F.col("user").alias("source"), "avg_credit"), "source")
        .join(users.select(F.col("user").alias("target"), "avg_debit"), "target")
        .join(F.broadcast(mean), how="left")
        .withColumns({"devpop": off("avg_usd"), "creditdev": off("avg_credit"), "debitdev": off("avg_debit")})
        .drop("avg_usd", "avg_credit", "avg_debit")
    )
