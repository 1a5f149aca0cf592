"""Datasets of entity tables, property search, and pattern search by example."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import save
from . import observe, rescore
from .knn import nearest, similarity
from .marginal import link_attributes, marginal_graph, symmetric_edges
from .pattern import first_tuples, one_per_node_set, pattern_of, top_matches_in_batches, top_matches_with_free, with_query_first

# The constraints of a property match.
EQUALS, NOT, PARTIAL_OPTIONAL, OPTIONAL_EQUALS, REQUIRED_PARTIAL = (
    "REQUIRED_EQUALS", "NOT", "FUZZY_PARTIAL_OPTIONAL", "OPTIONAL_EQUALS", "FUZZY_REQUIRED",
)
OPTIONAL = {PARTIAL_OPTIONAL, OPTIONAL_EQUALS}

# Property tags that may stand for columns.
TAGS = frozenset("ID TYPE NAME LABEL STAT TEXT STATUS GEO DATE AMOUNT COUNT USD DURATION".split())


@dataclass(frozen=True)
class Property:
    """One condition: a column or tag, a value, and how they must agree."""

    key: str
    value: str
    constraint: str = EQUALS

    def on(self, column: str) -> Column:
        own, value = F.col(f"`{column}`").cast("string"), F.lit(str(self.value))
        if self.constraint in (EQUALS, OPTIONAL_EQUALS):
            return own == value
        if self.constraint == NOT:
            return own != value
        if self.constraint in (PARTIAL_OPTIONAL, REQUIRED_PARTIAL):
            return own.contains(value)
        raise ValueError(f"unknown constraint {self.constraint}")


@dataclass(frozen=True)
class EntityTable:
    name: str
    frame: DataFrame
    key: str
    prefix: str
    display: str


@dataclass(frozen=True)
class ForeignLink:
    """Two entity tables joined through a link table's two columns."""

    source: str
    target: str
    link: str
    source_key: str
    target_key: str


@dataclass
class Dataset:
    """Entity tables, the columns each tag stands for, and the joins between tables."""

    tables: list[EntityTable]
    tags: dict[str, list[str]] = field(default_factory=dict)
    links: list[ForeignLink] = field(default_factory=list)

    def tables_with(self, column: str) -> list[EntityTable]:
        return [t for t in self.tables if column in t.frame.columns]

    def by_prefix(self, uid: str) -> EntityTable | None:
        return next((t for t in self.tables if uid.startswith(t.prefix)), None)

    def expand(self, properties: list[Property]) -> list[Property]:
        """Tags (all-capital keys) replaced by a condition on each of their columns."""
        out = []
        for p in properties:
            if p.key.upper() != p.key:
                out.append(p)
            elif p.key not in TAGS:
                raise ValueError(f"{p.key} is no property tag")
            else:
                out += [Property(c, p.value, p.constraint) for c in self.tags.get(p.key, [])]
        return out


def predicate(properties: list[Property]) -> Column:
    """The optional conditions joined by or, and all the others by and."""
    some = [p.on(p.key) for p in properties if p.constraint in OPTIONAL]
    every = [p.on(p.key) for p in properties if p.constraint not in OPTIONAL]
    parts = ([reduce(lambda x, y: x | y, some)] if some else []) + every
    return reduce(lambda x, y: x & y, parts) if parts else F.lit(True)


def _named(t: EntityTable, rows: DataFrame) -> DataFrame:
    uid = F.concat(F.lit(t.prefix), F.col(f"`{t.key}`").cast("string"))
    return rows.select(F.lit(t.name).alias("_table"), uid.alias("uid"), *rows.columns)


def property_search(dataset: Dataset, properties: list[Property], limit: int | None = None, start: int = 0) -> DataFrame:
    """Rows of every table that has a searched column, with _table and uid; tables add their own columns.

    A condition applies in each table that has its column; a table is searched
    by the conditions that apply to it. ``limit`` and ``start`` page through
    each table by its key.
    """
    conditions = dataset.expand(properties)
    found = []
    for t in dataset.tables:
        own = [p for p in conditions if p.key in t.frame.columns]
        if own:
            rows = t.frame.filter(predicate(own))
            if limit is not None:
                rows = rows.orderBy(t.key).offset(start).limit(limit)
            found.append(_named(t, rows))
    if not found:
        raise ValueError("no table has any of the searched columns")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found)


def ranked_search(dataset: Dataset, properties: list[Property], limit: int) -> DataFrame:
    """(_table, uid, score): the share of the conditions that hold, best first; rows with none are left out."""
    conditions, found = dataset.expand(properties), []
    for t in dataset.tables:
        own = [p for p in conditions if p.key in t.frame.columns]
        if own:
            hits = reduce(lambda x, y: x + y, [F.coalesce(p.on(p.key), F.lit(False)).cast("int") for p in own])
            found.append(_named(t, t.frame).select("_table", "uid", (hits / len(properties)).alias("score")))
    if not found:
        raise ValueError("no table has any of the searched columns")
    return reduce(lambda x, y: x.union(y), found).filter("score > 0").orderBy(F.desc("score"), "_table", "uid").limit(limit)


def entities_by_id(dataset: Dataset, uids: list[str]) -> DataFrame:
    """The entities of some ids, each id's prefix naming its table; unknown prefixes give a row with the id alone."""
    spark = dataset.tables[0].frame.sparkSession
    found = []
    for t in dataset.tables:
        keys = sorted({u[len(t.prefix) :] for u in uids if dataset.by_prefix(u) is t})
        if keys:
            found.append(_named(t, t.frame.filter(F.col(t.key).isin(*[int(k) if k.isdigit() else k for k in keys]))))
    lost = sorted({u for u in uids if dataset.by_prefix(u) is None})
    if lost:
        found.append(spark.createDataFrame([(None, u) for u in lost], "_table string, uid string"))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found)


# API types of the storage types.
API_TYPES = {
    T.StringType: "STRING", T.CharType: "STRING", T.VarcharType: "STRING", T.IntegerType: "LONG", T.LongType: "LONG", T.ShortType: "LONG", T.ByteType: "STRING",
    T.DoubleType: "DOUBLE", T.FloatType: "DOUBLE", T.DecimalType: "DOUBLE", T.TimestampType: "DATE", T.TimestampNTZType: "DATE", T.DateType: "DATE",
    T.BooleanType: "BOOLEAN",
}


def properties_of(t: EntityTable) -> DataFrame:
    """(uid, key, value, type): every column but the key as a property, nulls as "null", and the display name as TYPE."""
    uid = F.concat(F.lit(t.prefix), F.col(t.key).cast("string")).alias("uid")
    rows = [
        F.struct(F.lit(f.name).alias("key"), F.coalesce(F.col(f.name).cast("string"), F.lit("null")).alias("value"), F.lit(API_TYPES.get(type(f.dataType), "STRING")).alias("type"))
        for f in t.frame.schema.fields
        if f.name != t.key
    ]
    rows.append(F.struct(F.lit("TYPE").alias("key"), F.lit(t.display).alias("value"), F.lit("STRING").alias("type")))
    return t.frame.select(uid, F.inline(F.array(*rows)))


def linked_entities(dataset: Dataset, link: ForeignLink, links: DataFrame) -> DataFrame:
    """(source_uid, target_uid) of two entity tables joined through a link table."""
    one = next(t for t in dataset.tables if t.name == link.source)
    two = next(t for t in dataset.tables if t.name == link.target)
    left = one.frame.select(F.col(one.key).alias(link.source_key), F.concat(F.lit(one.prefix), F.col(one.key).cast("string")).alias("source_uid"))
    right = two.frame.select(F.col(two.key).alias(link.target_key), F.concat(F.lit(two.prefix), F.col(two.key).cast("string")).alias("target_uid"))
    return links.select(link.source_key, link.target_key).join(left, link.source_key).join(right, link.target_key).select("source_uid", "target_uid")


def search_by_example(
    transactions: DataFrame, exemplars: list[int], k: int = 1000, max_results: int = 10, start: int = 0, hmm: bool = False,
    start_time=None, end_time=None, vectors: DataFrame | None = None, graph: DataFrame | None = None, unlinked: bool = False,
) -> DataFrame:
    """Groups of nodes that are linked like the exemplars: (match, n_0, n_1, ..., score).

    The exemplars' links are the pattern; its k best matches are found, one
    for each set of nodes, the query itself first. With hmm, they are scored
    by their transactions over time instead. An exemplar without a link to
    another stands for any other node. Where no exemplar has a link there is no
    result or, with ``unlinked``, all of them stand for any nodes, at a score
    of 0. A single exemplar gives its nearest neighbours (which needs
    ``vectors(id, vector)``).
    """
    spark = transactions.sparkSession
    if start_time is not None:
        transactions = transactions.filter(F.col("time") >= F.lit(start_time))
    if end_time is not None:
        transactions = transactions.filter(F.col("time") <= F.lit(end_time))
    if len(set(exemplars)) == 1:
        if vectors is None:
            raise ValueError("a single exemplar needs feature vectors")
        found = nearest(vectors, vectors.filter(F.col("id") == exemplars[0]), start + max_results)
        ranked = found.select(F.col("rank").cast("long").alias("match"), F.col("neighbour").alias("n_0"), similarity(F.col("distance")).alias("score"))
        return ranked.orderBy("match").offset(start).limit(max_results)
    graph = marginal_graph(transactions) if graph is None else graph
    known, everyone = pattern_of(spark, graph, exemplars), sorted(set(exemplars))
    if known is None and not unlinked:
        return spark.createDataFrame([], f"match long, {', '.join(f'n_{i} long' for i in range(len(everyone)))}, score double")
    edges = save(symmetric_edges(graph), "edges")
    pattern, nodes = known or (None, everyone)
    if pattern is None:
        found = first_tuples(edges, len(everyone), k)
    elif len(nodes) == len(everyone):
        found = top_matches_in_batches(edges, pattern, k)
    else:
        at = [everyone.index(x) for x in nodes]
        found, nodes = top_matches_with_free(edges, [(at[i], at[j]) for i, j in pattern.edges], len(everyone), k), everyone
    best = one_per_node_set(found).drop("node_set")
    roles = [f"n_{i}" for i in range(len(nodes))]
    rows = with_query_first(best, nodes)
    # at most k + 1 rows are numbered
    rows = rows.withColumn("match", (F.row_number().over(W.orderBy(F.desc("score"), *roles)) - 1).cast("long"))
    if hmm:
        seen = observe.observations(observe.match_links(transactions, rows), len(nodes))
        scores = rescore.rescore(seen, 0)
        rows = rows.drop("score").join(scores.select("match", "score"), "match")
    return rows.select("match", *roles, "score").orderBy(F.desc("score"), *roles).offset(start).limit(max_results)


def result_links(graph: DataFrame, results: DataFrame) -> DataFrame:
    """(match, a, b, ...): the graph's attributes of all links among each result's nodes."""
    who = observe.members(results)
    pairs = who.select("match", F.col("node").alias("id1")).join(who.select("match", F.col("node").alias("id2")), "match").filter("id1 < id2")
    attributes = link_attributes(graph, pairs.select("id1", "id2"))
    return pairs.join(attributes, (F.col("id1") == F.col("a")) & (F.col("id2") == F.col("b"))).drop("id1", "id2")
