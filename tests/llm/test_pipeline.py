"""The pipeline's stages, each against brute force on its own input, and the catalogue."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from echotrail.llm import catalog

from .test_operators import SCHEMA, _components, _corpus, _repeats


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, t, lang, source, n) for i, t, lang, source, n in _corpus() if i != 7] + [(None, "no id", "en", "s1", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    rng = random.Random(1)
    spark.createDataFrame([(r[0], rng.randint(0, 1), 0) for r in rows[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages_take_effect(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        found = stage(spark, docs, tables)
        if i < 4:
            assert found.columns == docs.columns
            found.write.parquet(f"{tmp_path}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{i}")
            after = {r.doc_id: r for r in docs.collect()}
            assert set(after) <= set(before) and docs.count() == len(after)
        if name == "near_dedup":
            want = _components({k: r.text for k, r in before.items()})
            assert set(after) == {k for k, v in want.items() if k == v}
        if name == "repeat_removal":
            assert set(after) == set(before)
            want = _repeats({k: r.text for k, r in before.items()})
            for k, r in after.items():
                assert len(r.text.encode()) == want[k][0] - want[k][1] and r.n_chars == len(r.text)
    assert "sequence_id" in found.columns and {r.doc_id for r in found.collect()} == set(after)


EXTRA = ("kept_text", "bucket", "kind", "row", "score", "kept", "predicted", "component_id", "data", "a.b")


def test_repeated_rows_and_clashing_names(spark, tables, tmp_path):
    """No stage multiplies a doubled row, loses a column or trips over its name."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    doubled = docs.union(docs.filter("doc_id < 30")).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in EXTRA})
    doubled.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = Counter(r.doc_id for r in docs.select("doc_id").collect())
        found = stage(spark, docs, tables)
        if i == 4:
            pieces = Counter((r.doc_id, r.piece) for r in found.collect())
            assert {d for d, _ in pieces} == set(before) and all(n == before[d] for (d, _), n in pieces.items())
            continue
        assert found.columns == docs.columns
        found.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows = docs.collect()
        after = Counter(r.doc_id for r in rows)
        assert after and all(before[d] == n for d, n in after.items()), name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in EXTRA)
    assert max(after.values()) == 2


def test_empty_tables(spark, tables, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, tables)
        assert found.count() == 0 and (i == 4 or found.columns == docs.columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_and_catalogue(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "repeat_removal", "best_fit_packing"]
    assert {int(q[2:].split("_")[0]) for q in catalog.QUERIES} == set(range(1, 11))
