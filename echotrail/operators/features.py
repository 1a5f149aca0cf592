"""Behavioural features of users, and their normalisation.

All are group-bys with partial aggregation, and windows over at most a row per
user and day, so a very busy user is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import save
from .order import order_statistics

#: The order of the feature vector.
FEATURES = (
    "credit_mean", "credit_std", "credit_interarr_mean", "credit_interarr_std", "debit_mean", "debit_std", "debit_interarr_mean", "debit_interarr_std",
    "perp_in", "perp_out",
)


def sides(transactions: DataFrame) -> DataFrame:
    """Two rows a transaction: (user, other, side, value, day, time, amount); debits have a negative value."""
    row = lambda user, other, side, sign: transactions.select(
        F.col(user).alias("user"), F.col(other).alias("other"), F.lit(side).alias("side"), (F.col("amount") * sign).alias("value"),
        F.to_date("time").alias("day"), "time", "amount", "target",
    )
    return row("target", "source", "credit", 1).union(row("source", "target", "debit", -1))


def _pick(side: str, value: str) -> Column:
    return F.when(F.col("side") == side, F.col(value))


def _moments(side: str, value: str, name: str) -> list[Column]:
    """Mean and sample deviation, 0 where there is nothing (or one value) to take them of."""
    own = _pick(side, value)
    return [F.coalesce(F.avg(own), F.lit(0.0)).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(own), F.lit(0.0)).alias(f"{name}_std")]


def amount_stats(transactions: DataFrame) -> DataFrame:
    """Mean and deviation of a user's credits, and of the negated debits."""
    return sides(transactions).groupBy("user").agg(*_moments("credit", "value", "credit"), *_moments("debit", "value", "debit"))


def interarrival_stats(transactions: DataFrame) -> DataFrame:
    """Mean and deviation of whole days between a user's successive credits, and debits.

    Transactions of one day are 0 days apart, so the days with their counts
    are enough: of n transactions n - 1 gaps, all but those between days 0.
    """
    days = sides(transactions).groupBy("user", "side", "day").agg(F.count("*").alias("n"))
    gap = F.datediff(F.col("day"), F.lag("day").over(W.partitionBy("user", "side").orderBy("day")))
    days = days.withColumn("gap", gap.cast("double"))
    total = lambda side, c: F.coalesce(F.sum(_pick(side, c)), F.lit(0)).cast("double")
    found = days.withColumn("square", F.col("gap") * F.col("gap")).groupBy("user").agg(
        *[total(side, c).alias(f"{side}_{c}") for side in ("credit", "debit") for c in ("n", "gap", "square")]
    )

    def moments(side: str) -> list[Column]:
        k, g, q = F.col(f"{side}_n") - 1, F.col(f"{side}_gap"), F.col(f"{side}_square")
        spread = F.sqrt(F.greatest(F.try_divide(q - F.try_divide(g * g, k), k - 1), F.lit(0.0)))
        return [F.when(k > 0, F.try_divide(g, k)).otherwise(0.0).alias(f"{side}_interarr_mean"), F.when(k > 1, spread).otherwise(0.0).alias(f"{side}_interarr_std")]

    return found.select("user", *moments("credit"), *moments("debit"))


def perplexities(transactions: DataFrame) -> DataFrame:
    """2 to the entropy of a user's counterparts, as target (in) and as source (out); 1 without any.

    The entropy of counts n with the sum N is log2 N - sum(n log2 n) / N.
    """
    counts = sides(transactions).groupBy("user", "side", "other").agg(F.count("*").alias("n"))
    terms = counts.withColumn("h", F.col("n") * F.log2("n"))

    def perplexity(side: str) -> Column:
        n = F.sum(_pick(side, "n")).cast("double")
        return F.coalesce(F.pow(F.lit(2.0), F.log2(n) - F.try_divide(F.sum(_pick(side, "h")), n)), F.lit(1.0))

    return terms.groupBy("user").agg(perplexity("credit").alias("perp_in"), perplexity("debit").alias("perp_out"))


def user_features(transactions: DataFrame) -> DataFrame:
    """user and the ten FEATURES.

    The three aggregates share the user partitioning, so their joins add no
    shuffle of their own.
    """
    joined = amount_stats(transactions).join(interarrival_stats(transactions), "user").join(perplexities(transactions), "user")
    return joined.select("user", *FEATURES)


def user_table(features: DataFrame) -> DataFrame:
    """The features with a node type, 1 by default."""
    return features.withColumn("type", F.lit(1))


def log_transform(features: DataFrame) -> DataFrame:
    """ln(1 + |x|), and ln(x) for the perplexities."""
    return features.select("user", *[(F.log(c) if c.startswith("perp") else F.log1p(F.abs(c))).alias(c) for c in FEATURES])


def normalized(features: DataFrame, columns: tuple[str, ...] = FEATURES, low: float = 0.025, high: float = 0.975, ignore_zeros: bool = False) -> DataFrame:
    """(x - b0) / b1, which sends the two quantiles to -2 and 2.

    Quantiles are exact with linear interpolation, by selection over the whole
    table (``order.order_statistics``). With ignore_zeros a zero is left out of
    them and stays 0. A column without spread becomes 0.
    """
    features = save(features, "features")  # each round of the selection reads it
    counted = features.select(*[(F.when(F.col(c) != 0, F.col(c)) if ignore_zeros else F.col(c)).alias(c) for c in columns])
    ends = order_statistics(counted, columns, (low, high))

    def scaled(c: str) -> Column:
        lo, hi = (F.lit(v) for v in ends[c] or (None, None))
        out = F.try_divide(F.col(c) - (lo + hi) / 2, (hi - lo) / 4)
        out = F.coalesce(F.nanvl(out, F.lit(0.0)), F.lit(0.0))
        return (F.when(F.col(c) == 0, 0.0).otherwise(out) if ignore_zeros else out).alias(c)

    return features.select(*[c for c in features.columns if c not in columns], *[scaled(c) for c in columns])


def clean_outliers(rows: DataFrame, columns: tuple[str, ...], limit: float = 4.0) -> DataFrame:
    """NaN to 0, 0 to 0.001, then clamped to +-limit."""
    fix = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return rows.withColumns({c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.when(fix(c) == 0, 0.001).otherwise(fix(c)))) for c in columns})


def feature_summary(features: DataFrame) -> DataFrame:
    """(feature, mean, std), one row a feature."""
    flat = features.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in FEATURES]), F.array(*FEATURES))).alias("feature", "value"))
    return flat.groupBy("feature").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def daily_series(transactions: DataFrame) -> DataFrame:
    """(user, day, credit, debit, total) for every day from a user's first to the last, 0 where nothing happened."""
    days = sides(transactions).groupBy("user", "day").agg(
        F.sum(_pick("credit", "value")).alias("credit"), F.sum(_pick("debit", "value")).alias("debit"), F.sum("value").alias("total")
    )
    span = days.groupBy("user").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    every = span.select("user", F.explode(F.sequence("lo", "hi")).alias("day"))
    return every.join(days, ["user", "day"], "left").fillna(0.0, ["credit", "debit", "total"])


def clustered_types(features: DataFrame, k: int, seed: int = 1, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """The features with a node type 1..k from seeded k-means; users alike share a type."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=list(columns), outputCol="_point").transform(features.drop("type"))
    found = KMeans(k=k, seed=seed, featuresCol="_point", predictionCol="_cluster").fit(points).transform(points)
    return found.withColumn("type", F.col("_cluster") + 1).drop("_point", "_cluster")
