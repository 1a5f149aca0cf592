"""Power spectra of users' daily series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 100


def spectrum_of(signal: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """|Re| of bins 1 to length/2 - 1 of the last half-overlapping window, over the number of windows.

    Earlier windows don't count (each replaces the one before); the last slot
    stays 0.
    """
    half = length // 2
    out = np.zeros(half)
    starts = range(0, len(signal), half)
    if not len(signal):
        return out
    window = np.zeros(length)
    last = signal[starts[-1] : starts[-1] + length]
    window[: len(last)] = last
    out[: half - 1] = np.abs(np.fft.rfft(window).real[1:half])
    return out / len(starts)


def spectra(series: DataFrame, value: str = "total") -> DataFrame:
    """(user, spectrum) of ``series(user, day, value)``: ``spectrum_of`` each user's days in order.

    Only the number of windows and the days of the last one count; its bins
    are sums of cosines, taken in one group-by.
    """
    half = LENGTH // 2
    span = series.groupBy("user").agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    last = F.floor(F.datediff("_last", "_first") / half).cast("int")
    rows = series.join(span.select("user", "_first", last.alias("_window")), "user").withColumn("_at", F.datediff("day", "_first") - F.col("_window") * half)
    rows = rows.filter("_at >= 0").select("user", "_window", "_at", F.col(value).alias("_x"))
    bins = [F.abs(F.sum(F.col("_x") * F.cos(F.lit(2 * np.pi * k / LENGTH) * F.col("_at")))) / (F.first("_window") + 1) for k in range(1, half)]
    return rows.groupBy("user").agg(F.array(*bins, F.lit(0.0)).alias("spectrum"))
