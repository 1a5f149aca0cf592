"""Quality rules whose cutoffs come from the corpus itself.

Each document's ratios are bucketed on a logarithmic scale; the counts per
language, source and bucket are a quantile sketch with a relative error of
GAMMA - 1 that merges by addition (so Spark's partial aggregation merges it,
and a language's sketch is the sum of its sources'). A group's sketch is mixed
with MIX documents' worth of its language's and as many of its source's, so
that a small group leans on them and a large one does not, without a size at
which it turns. Weights are whole numbers, UNIT for a document.

A rule rejects outliers of the mixed sketch, and nothing where there are none.
Word lengths spread, so theirs are beyond the outer fence (third quartile plus
REACH interquartile ranges). The other ratios are 0 for most documents and have
no such spread: an outlier is a value that stands apart, in the upper quarter
and behind a stretch of STRETCH times any value that hardly a document fills (a
THIN-th of what lies behind it). The stretch begins at the least that a typical
document of the group can have, one occurrence in its length (the median of
that from a sketch of its own), or further up. No share of a group is fixed.
Cutoffs are joined back and filter the documents.

Nulls: a null text has no words and fails the base rules; null languages and
sources are groups of their own. Every row of the input gets a row: rows that
repeat a doc_id, or have none, are rows like others. Rows with equal ratios
share a bucket and so a verdict in their group. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Work, map_batches, slices, table, texts_of
from .stats import document_counts

GAMMA, REACH = 1.02, 3.0
MIX, UNIT = 25, 1_000_000
STRETCH, THIN = 8.0, 50
#: Added before the query rounds, so that no value ends in ...5.
OFF_TIES = 1e-8
#: Ratio, and what one occurrence makes of it; without, the ratio has a fence.
RULES = {
    "symbol_ratio": ("n_symbols / word_chars", "1 / word_chars"),
    "repeat_ratio": ("n_repeat_words / n_words", "3 / n_words"),
    "dup_line_ratio": ("n_dup_lines / n_lines", "1 / n_lines"),
    "word_length": ("word_chars / n_words", None),
}
#: What is sketched.
SKETCHED = {k: r for k, (r, _) in RULES.items()} | {f"{k}_unit": u for k, (_, u) in RULES.items() if u}
#: The buckets of a stretch.
STRETCH_BUCKETS = int(np.log(STRETCH) / np.log(GAMMA))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts the rules use, for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(3))
        parts = [document_counts(texts[lo:hi]) for lo, hi in slices(texts)]
        found = [pa.array(np.concatenate([p[c] for p in parts])) for c in _COUNTS]
        head = [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string())]
        return pa.record_batch([*head, *found], names=["doc_id", "lang", "source", *_COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS)
    return map_batches(docs, ["doc_id", "lang", "source", "text"], run, schema)


def _bucket(x: Column) -> Column:
    """The logarithmic bucket of a ratio; zero has one below all others."""
    return F.when(x > 0, F.ceil(F.ln(x) / np.log(GAMMA)).cast("int")).otherwise(-(2**30))


def _value(bucket: str) -> Column:
    """A bucket's upper edge; the last factor is for the rounding of logarithms."""
    return F.when(F.col(bucket) > -(2**30), F.exp(F.col(bucket) * float(np.log(GAMMA))) * (1 + 1e-9)).otherwise(0.0)


def mixed(sketch: DataFrame) -> DataFrame:
    """lang, source, rule, bucket and weight: each group's counts with its share of its language's and its source's."""
    groups = sketch.select("lang", "source", "rule").distinct()
    parts = [sketch.select("lang", "source", "rule", "bucket", (F.col("n") * UNIT).alias("weight"))]
    for key in ("lang", "source"):
        whole = sketch.groupBy(key, "rule", "bucket").agg(F.sum("n").alias("n"))
        size = F.sum("n").over(W.partitionBy(key, "rule"))
        whole = whole.select(F.col(key).alias("_key"), F.col("rule").alias("_rule"), "bucket", F.col("n"), size.alias("size"))
        given = groups.join(whole, F.col(key).eqNullSafe(F.col("_key")) & (F.col("rule") == F.col("_rule")))
        parts.append(given.select("lang", "source", "rule", "bucket", F.expr(f"({MIX * UNIT} * n) div size").alias("weight")))
    every = parts[0].union(parts[1]).union(parts[2])
    return every.groupBy("lang", "source", "rule", "bucket").agg(F.sum("weight").alias("weight"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """lang, source and the cutoff of each rule, null where it has no outliers."""
    group = W.partitionBy("lang", "source", "rule")
    upto = F.sum("weight").over(group.orderBy("bucket").rangeBetween(W.unboundedPreceding, 0))  # with what a floor shares its bucket with
    near = F.coalesce(F.sum("weight").over(group.orderBy("bucket").rangeBetween(1, STRETCH_BUCKETS)), F.lit(0))
    size, share = F.sum("weight").over(group), lambda n, of: F.min(F.when(of * F.col("upto") >= n * F.col("size"), F.col("bucket")))
    weights = mixed(sketch)
    least = weights.filter(F.col("rule").endswith("_unit")).select("*", upto.alias("upto"), size.alias("size"))
    least = least.groupBy("lang", "source", "rule").agg(share(1, 2).alias("bucket"))
    floors = least.select("lang", "source", F.expr("left(rule, length(rule) - 5)").alias("rule"), "bucket", F.lit(True).alias("floor"), F.lit(0).alias("weight"))
    rows = weights.filter(~F.col("rule").endswith("_unit")).select("lang", "source", "rule", "bucket", F.lit(False).alias("floor"), "weight").union(floors)
    start = F.min(F.when(F.col("floor"), F.col("bucket"))).over(group)
    ranked = rows.select("*", upto.alias("upto"), near.alias("near"), size.alias("size"), start.alias("start"))
    far = F.col("size") - F.col("upto") - F.col("near")
    apart = (F.col("bucket") >= F.col("start")) & (4 * F.col("upto") >= 3 * F.col("size")) & (far > 0) & (THIN * F.col("near") <= far)
    found = ranked.groupBy("lang", "source", "rule").agg(
        share(1, 4).alias("q1"), share(3, 4).alias("q3"), (F.min(F.when(apart, F.col("bucket"))) + STRETCH_BUCKETS).alias("gap")
    )
    fenced = F.col("rule").isin([k for k, (_, unit) in RULES.items() if unit is None])
    fence = _value("q3") + REACH * (_value("q3") - _value("q1"))
    found = found.select("lang", "source", "rule", F.when(fenced, fence).when(F.col("gap").isNotNull(), _value("gap")).alias("cut"))
    return found.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == k, F.col("cut"))).alias(f"{k}_cutoff") for k in RULES])


def quality_rules(spark: SparkSession, docs: DataFrame, work: Work | None = None) -> DataFrame:
    """The counts of every row of ``docs``, base_failed, the ratios, their cutoffs, and kept."""
    work = work or Work(spark, "rules")
    counts = work.save(rule_counts(docs), "counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ratio = lambda text: F.coalesce(F.try_divide(*[F.expr(c) for c in text.split("/")]), F.lit(0.0))
    rows = counts.withColumns({"base_failed": failed, **{k: ratio(r) for k, (r, _) in RULES.items()}})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), _bucket(ratio(r)).alias("bucket")) for k, r in SKETCHED.items()]))
    sketch = (
        rows.filter(~F.col("base_failed")).select("lang", "source", each.alias("e"))
        .groupBy("lang", "source", "e.rule", "e.bucket").agg(F.count("*").alias("n"))
    )
    sketch = work.save(sketch, "sketch")
    cut = cutoffs(sketch).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = rows.join(cut, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    within = ~F.col("base_failed")
    for k in RULES:
        within = within & F.coalesce(F.col(k) <= F.col(f"{k}_cutoff"), F.lit(True))
    return rows.withColumn("kept", within)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(spark, table(spark, sf_dir, "documents"))
    more = [F.round(F.col(c) + OFF_TIES, 6).alias(c) for k in RULES for c in (k, f"{k}_cutoff")]
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *more)
