"""The vector index against the search over all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from echotrail.operators import knn as K
from echotrail.operators import vector_index as I


def _rows(found):
    return sorted((r.query, r["rank"], r.neighbour, r.distance) for r in found.collect())


def test_index_gives_the_nearest_and_skips_units(spark, tmp_path, monkeypatch):
    """Clusters, a third of all rows equal, ties, and rows that belong to no index."""
    monkeypatch.setattr(I, "UNIT_ROWS", 50)
    monkeypatch.setattr(I, "RING_ROWS", 10)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 20
    points = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=6)]) for i in range(600)]
    points += [(600 + i, [1.0] * 6) for i in range(300)] + [(900 + i, [float(i % 3)] + [0.0] * 5) for i in range(30)]
    odd = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [1.0, 2.0]), (None, [0.0] * 6), (2004, [float("inf")] * 6), (2005, [])]
    vectors = spark.createDataFrame(points + odd, "id long, vector array<double>")
    asked = vectors.filter((F.col("id") % 40 == 0) | (F.col("id") >= 2000))
    I.write_vector_index(vectors, str(tmp_path / "index"))
    for k in (1, 7):
        found, visited = I.search_vector_index(spark, str(tmp_path / "index"), asked, k)
        assert _rows(found) == _rows(K.nearest(spark.createDataFrame(points, vectors.schema), asked.filter("id < 2000"), k))
        rows = [r.rows for r in visited.collect()]
        assert len(rows) == asked.filter("id < 2000").count() and sorted(rows)[len(rows) // 2] < len(points) / 4
    assert spark.read.parquet(str(tmp_path / "index" / "units")).agg(F.sum("n"), F.max("n")).first()[0] == len(points)


def test_more_neighbours_than_rows_and_an_empty_table(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [0.0]), (2, [3.0]), (3, [3.0])], "id long, vector array<double>")
    I.write_vector_index(vectors, str(tmp_path / "few"))
    found, visited = I.search_vector_index(spark, str(tmp_path / "few"), vectors, 10)
    assert _rows(found) == _rows(K.nearest(vectors, vectors, 10)) and {r.rows for r in visited.collect()} == {3}
    I.write_vector_index(vectors.limit(0), str(tmp_path / "none"))
    found, visited = I.search_vector_index(spark, str(tmp_path / "none"), vectors, 3)
    assert found.count() == 0 and visited.count() == 0
