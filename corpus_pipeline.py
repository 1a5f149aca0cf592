"""The corpus pipeline: rules, classifier, near-dedup, repeat removal, packing.

Each stage takes what its predecessor kept; all but the last return the
columns of ``documents``, whatever further columns there are and whatever
their names. Rows without a doc_id can't be followed through the stages and
go in the first. Rows that repeat a doc_id are one document: a filtering
stage keeps all of them if it keeps any, the others treat each row by itself,
so no stage multiplies them. A null text fails the base rules; empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrail.llm import minhash, packing, quality, repeats, rules
from echotrail.llm.common import Work, table


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi").select([f"`{c}`" for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the rules' cutoffs."""
    return _only(docs, rules.quality_rules(spark, docs).filter("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among them."""
    return _only(docs, quality.quality_scores(spark, docs, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates."""
    return _only(docs, minhash.near_duplicates(spark, docs).filter("kept"))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 100-byte strings that occur earlier; n_chars follows the text."""
    rest = repeats.without_repeats(spark, docs)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.packed(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Work(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.save(docs, name)
            work.free_shuffles()
    return docs
