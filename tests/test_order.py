"""Successors in the whole order, and exact order statistics, against sorting in one process."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrail.operators import features
from echotrail.operators.order import _sortable, _value, order_statistics, with_next


def _want(rows: list[tuple]) -> dict[int, int | None]:
    found = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    return {r[0]: (found[i + 1][2] if i + 1 < len(found) else None) for i, r in enumerate(found)}


@pytest.mark.parametrize("times", ["spread", "one", "few", "nulls"])
@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_successors_are_those_of_one_sorted_list(spark, times, partitions):
    """One time for all rows (so one day) is dealt by the rest of the key."""
    rng = random.Random(times)
    time = {"spread": lambda: rng.randrange(10**6), "one": lambda: 5, "few": lambda: rng.choice([1, 2]), "nulls": lambda: rng.choice([None, 1, 2, 3])}[times]
    rows = [(i, time(), rng.choice([None, *range(50)])) for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, time long, user long")
    got = with_next(frame, "user", ["time", "id"], partitions)
    assert got.columns == ["id", "time", "user", "next"]
    assert sorted((r.id, r.next) for r in got.collect()) == sorted(_want(rows).items())


def test_successor_tasks_do_not_depend_on_the_values(spark):
    frame = spark.range(20_000).select("id", F.lit(1).alias("time"), (F.col("id") * 2).alias("user"))
    got = with_next(frame, "user", ["time", "id"], 16)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.filter("next = user + 2").count() == 19_999 and max(sizes) < 10_000
    assert len(got.inputFiles()) == 16  # as many ranges as asked for, of one time


@pytest.mark.parametrize("n", [0, 1, 2])
def test_successors_of_few_rows(spark, n):
    frame = spark.createDataFrame([(i, i, i + 10) for i in range(n)], "id long, time long, user long")
    assert sorted((r.id, r.next) for r in with_next(frame, "user", ["time", "id"]).collect()) == [(i, i + 11 if i + 1 < n else None) for i in range(n)]


def test_sortable_bits_keep_the_order():
    values = np.array([-np.inf, -1e300, -2.5, -1e-310, 0.0, 1e-310, 1.0, 1.0000000000000002, 7e12, np.inf, np.nan])
    keys = _sortable(values)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert [repr(_value(int(k))) for k in keys] == [repr(float(v)) for v in values]
    assert _sortable(np.array([-0.0]))[0] == _sortable(np.array([0.0]))[0]


def _columns(rng: random.Random, n: int) -> dict[str, list]:
    return {
        "spread": [rng.gauss(0, 1) * 10 ** rng.randrange(-30, 30) for _ in range(n)], "ties": [float(rng.choice([1, 1, 1, 2, 3])) for _ in range(n)],
        "one": [4.25] * n, "none": [None] * n, "gaps": [rng.choice([None, 0.0, -0.0, 1.0, -7.5]) for _ in range(n)],
        "near": [1 + rng.randrange(1000) * 2.0**-52 for _ in range(n)], "whole": [float(rng.randrange(-5, 100)) for _ in range(n)],
    }


@pytest.mark.parametrize("n", [1, 2, 3, 57, 2500])
def test_order_statistics_are_those_of_sorting(spark, n):
    columns, shares = _columns(random.Random(n), n), [0.0, 0.025, 0.5, 0.975, 1.0]
    frame = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = order_statistics(frame, list(columns), shares)
    for c, values in columns.items():
        own = sorted(v for v in values if v is not None)
        if not own:
            assert got[c] is None
            continue
        for share, value in zip(shares, got[c], strict=True):
            at = (len(own) - 1) * share
            lo, hi = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert lo <= value <= hi
            assert value == pytest.approx(lo if lo == hi else (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi, rel=1e-15, abs=1e-300)


def test_order_statistics_of_no_rows(spark):
    assert order_statistics(spark.createDataFrame([], "a double, b double"), ["a", "b"], [0.5]) == {"a": None, "b": None}


def test_normalising_has_no_buffer_of_all_values(spark):
    rows = spark.createDataFrame([(i, float(i), 1.0, 0.0 if i % 2 else float(i)) for i in range(1, 201)], "user long, a double, same double, z double")
    got = features.normalized(rows, ("a", "same", "z"))
    assert "percentile" not in got._jdf.queryExecution().toString()
    found = {r.user: r for r in got.collect()}
    lo, hi = np.percentile(np.arange(1, 201), [2.5, 97.5])
    assert found[17].a == pytest.approx((17 - (lo + hi) / 2) / ((hi - lo) / 4))
    assert all(r.same == 0 for r in found.values())
    assert features.normalized(rows, ("z",), ignore_zeros=True).filter("user % 2 = 1 and z <> 0").isEmpty()
