"""The kernel density in blocks of centers against its definition."""

from __future__ import annotations

import numpy as np
import pytest

from echotrail.operators import observe as O


@pytest.mark.parametrize("at_once", [None, 5, 1])
def test_density_in_blocks_is_that_of_its_definition(spark, at_once, monkeypatch):
    monkeypatch.setattr(O, "BLOCKS_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    centers = [tuple(map(float, v)) for v in rng.normal(size=(8, 2))] * 2 + [(1.0, 1.0)] * 20
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(30, 2)))] + [(30, 1.0, 1.0), (31, 1e6, 0.0)]
    frame, around = spark.createDataFrame(rows, "id long, x double, y double"), spark.createDataFrame(centers, "x double, y double")
    found = {r.id: r.likelihood for r in O.kernel_density(frame, around, ["x", "y"], 0.5, at_once=at_once).collect()}
    at = np.array(centers)
    for i, *v in rows:
        total = np.exp(-0.5 * ((at - v) ** 2).sum(axis=1) / 0.25).sum() / (len(centers) * 2 * 0.25 * np.pi)
        assert found[i] == pytest.approx(max(total, 1e-18), rel=1e-9)
    assert len(found) == len(rows)


def test_density_without_centers_or_with_a_null_is_the_floor(spark):
    frame = spark.createDataFrame([(1, 0.0), (2, None)], "id long, x double")
    for around in ([], [(0.0,), (None,)]):
        found = O.kernel_density(frame, spark.createDataFrame(around, "x double"), ["x"], 1.0).collect()
        assert sorted((r.id, r.likelihood) for r in found) == [(1, 1e-18), (2, 1e-18)]
    found = {r.id: r.likelihood for r in O.kernel_density(frame, spark.createDataFrame([(0.0,)], "x double"), ["x"], 1.0).collect()}
    assert found[2] == 1e-18 and found[1] > 0.1
