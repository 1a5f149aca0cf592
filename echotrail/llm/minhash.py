"""Near-duplicate documents by one-permutation MinHash.

One hash per shingle fills ``BINS`` bins; optimal densification fills the
empty ones; bands of ``ROWS`` bins are the buckets. In each bucket every
member is paired with the bucket's least document only (a star), so a bucket
of n documents gives n - 1 candidates. A star alone would lose a link between
two members that are both unlike the centre; after the stars' verified links
are merged, the documents of buckets that still hold more than one component
are joined across components by exact prefix filtering, and these pairs are
verified as well. Links are always confirmed on the full shingle sets.

Exact copies (equal shingle sets) are merged by a partial-aggregated minimum
before all that, so a group of copies of any size is one row.

Recall: a pair at similarity 0.75 shares no band with probability
(1 - 0.75**5)**40 = 2e-5, and less for closer pairs. Shingles are told apart
by 64-bit hashes, whole sets by 128-bit ones: two documents of 1,000 shingles
each share one by mistake with odds of 5e-14, so among 10**11 documents (about
100 TB) some thousand of the pairs compared count one shingle too many; that
any two different sets have equal digests has odds of 2e-17.

Nulls and texts without words have an empty set, ``n_shingles`` 0, and link
with nothing. A row with a null doc_id has no component and isn't kept.
Repeated doc_ids are not supported by the contract (the id is
the key), but don't crash: rows with one id share a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import Work, as_column, ids_of, map_batches, slices, table, texts_of
from .components import connected_components

WIDTH, BINS, ROWS = 5, 200, 5
#: A link needs LINK_PARTS * intersection >= LINK_OF * union.
LINK_PARTS, LINK_OF = 100, 75

_SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("same", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType())),
])
_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.BinaryType())])


def _sets(texts: list[bytes]):
    return K.shingles(K.Words(texts, lower=True), WIDTH)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a digest of the whole set, and the band hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        sizes, same, rows = [], [], []
        for lo, hi in slices(texts):
            flat, offsets = _sets(texts[lo:hi])
            sizes.append(np.diff(offsets))
            same += [xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            rows.append(K.bands(K.one_permutation_sketch(flat, offsets, BINS), ROWS))
        rows = np.concatenate(rows)
        ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
        return pa.record_batch(
            [batch.column(0).cast(pa.int64()), pa.array(np.concatenate(sizes)), pa.array(same, pa.binary()), pa.ListArray.from_arrays(ends, as_column(rows.ravel()))],
            names=_SKETCH.names,
        )

    return map_batches(docs, ["doc_id", "text"], run, _SKETCH)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted shingle hashes, 8 bytes each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = texts_of(batch.column(1)), []
        for lo, hi in slices(texts):
            flat, offsets = _sets(texts[lo:hi])
            out += [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=_SETS.names)

    return map_batches(docs, ["doc_id", "text"], run, _SETS)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Both joins are plain sort-merge joins, so a centre with many partners is
    split by the adaptive skew join; a set travels once per pair.
    """
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right.hint("merge"), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            p = np.frombuffer(x.as_buffer(), dtype=np.uint64)
            q = np.frombuffer(y.as_buffer(), dtype=np.uint64)
            n, m = len(p), len(q)
            if LINK_PARTS * min(n, m) < LINK_OF * max(n, m) or not n:
                continue
            near = np.concatenate((p, q))
            near.sort()
            shared = int(np.count_nonzero(near[1:] == near[:-1]))
            keep[i] = LINK_PARTS * shared >= LINK_OF * (n + m - shared)
        return pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    return map_batches(both, ["a", "b", "left", "right"], run, "a long, b long")


def sharing_rare_shingles(docs: DataFrame, sets: DataFrame, work: Work) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of ``docs(doc_id, n, component)`` in different components that may be linked.

    Exact prefix filtering: linked sets of n and m shingles have at least
    o = ceil(3/7 (n + m)) in common, so with a common order of all shingles,
    rarest first, they share one among the first n - o + 1 and m - o + 1 (of
    n, at most n - ceil(3/4 n) + 1). Documents that differ from a group's
    others in rare shingles of their own get no candidates, however large the
    group is. Only the documents outside a shingle's largest component meet
    the others.

    The aggregates are written before they are joined, so that every join on
    a shingle stands alone in its stage and a common shingle's rows are split
    by the adaptive skew join.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(3)]
        size = [len(x) for x in own]
        flat = [np.repeat(batch.column(i).to_numpy(), size) for i in range(3)]
        return pa.record_batch([*map(pa.array, flat), pa.array(np.concatenate(own))], names=["doc_id", "n", "component", "shingle"])

    rows = map_batches(docs.join(sets, "doc_id"), ["doc_id", "n", "component", "shingles"], run, "doc_id long, n long, component long, shingle long")
    common = work.save(rows.groupBy("shingle").agg(F.count("*").alias("freq")).filter("freq > 1"), "common")
    rows = rows.join(common, "shingle")
    in_doc = W.partitionBy("doc_id")
    place = F.row_number().over(in_doc.orderBy("freq", "shingle")) + F.col("n") - F.count("*").over(in_doc)
    rows = rows.select("*", place.alias("place"))
    rows = work.save(rows.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1), "prefixes")
    by_component = rows.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    largest = by_component.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("components"))
    largest = work.save(largest.filter("components > 1").select("shingle", F.col("top.component").alias("largest")), "largest")
    rows = work.save(rows.join(largest, "shingle"), "met")
    p = rows.filter("component <> largest").alias("p")
    q = rows.hint("merge").alias("q")
    overlap = F.ceil((F.col("p.n") + F.col("q.n")) * 3 / 7)  # least intersection of a linked pair
    meet = (
        (F.col("p.shingle") == F.col("q.shingle"))
        & (F.col("p.component") != F.col("q.component"))
        & ((F.col("q.component") == F.col("q.largest")) | (F.col("p.doc_id") < F.col("q.doc_id")))
        & (F.col("p.place") <= F.col("p.n") - overlap + 1)
        & (F.col("q.place") <= F.col("q.n") - overlap + 1)
    )
    return p.join(q, meet).select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b"), F.col("p.n").alias("n_a"), F.col("q.n").alias("n_b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, work: Work | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``."""
    work = work or Work(spark, "minhash")
    drawn = work.save(sketches(docs), "sketches")

    # copies: one representative (the least id) for each distinct set; only it keeps its buckets. They are written,
    # so that the join with a large group of copies can be split.
    copies = drawn.filter("n_shingles > 0 and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    copies = work.save(copies.filter("n > 1").select("same", "rep"), "copies")
    rep = F.coalesce("rep", "doc_id")
    own = F.when((F.col("n_shingles") > 0) & (F.col("doc_id") == rep), F.col("buckets"))
    classes = work.save(drawn.join(copies, "same", "left").select("doc_id", F.col("n_shingles").alias("n"), rep.alias("rep"), own.alias("buckets")), "classes")
    members = classes.select("doc_id", "n", F.explode("buckets").alias("bucket"))
    least = members.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.count("*").alias("size")).filter("size > 1").select("bucket", "centre")
    shared = work.save(members.join(least, "bucket"), "buckets")
    work.drop("sketches")
    work.free_shuffles()

    # the ids have no bound, so they are shuffled at every size, never broadcast
    involved = shared.select("doc_id").distinct().hint("merge")
    sets = work.save(shingle_sets(docs.select("doc_id", "text").join(involved, "doc_id", "left_semi")), "sets", "snappy")
    work.free_shuffles()
    size = work.save(shared.select("doc_id", "n").distinct(), "sizes")

    def near_in_size(pairs: DataFrame) -> DataFrame:
        small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        return pairs.filter(LINK_PARTS * small >= LINK_OF * large)

    starred = shared.filter("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"), F.col("n").alias("n_a")).distinct()
    starred = near_in_size(starred.join(size.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b")), "b"))
    links = work.save(verified(starred.select("a", "b"), sets), "links_0")
    work.free_shuffles()

    # buckets whose stars left more than one component
    found = work.save(connected_components(links, work, "cc_0"), "components_0")
    labelled = shared.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", "n", "centre", F.coalesce("component", "doc_id").alias("component")
    )
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    rest = work.save(labelled.join(mixed.filter("lo < hi and size > 2").select("bucket"), "bucket"), "rest")
    across = near_in_size(sharing_rare_shingles(rest.select("doc_id", "n", "component").distinct(), sets, work))
    more = work.save(verified(across.select("a", "b").distinct(), sets), "links_1")
    if not more.isEmpty():
        found = work.save(connected_components(links.union(more), work, "cc_1"), "components_1")
    work.drop("sets", "buckets", "rest", "common", "prefixes", "largest", "met")
    named = found.select(F.col("node").alias("rep"), "component")
    return (
        classes.join(named, "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
