"""Queries on the marginal graph and its patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marginal as M
from ..operators import pattern as P
from ..sources.work import save
from . import views as V
from .pattern_sql import match_sql, top_sql
from .registry import query

#: Results of a pattern search.
TOP = 10


@query("canonical_pair", f"with {V.EVENT_SQL} select transid, least(source, target) as a, greatest(source, target) as b from txn")
def canonical_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.canonical_pair(V.txn_event(spark, sf_dir)).select("transid", "a", "b")


@query(
    "self_loop_outlier_filter",
    f"with {V.NATION_SQL} select source, target, count(*) as n from txn where source <> target and source not in (25, 39, 7) and target not in (25, 39, 7) group by 1, 2",
)
def self_loop_outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = M.without_loops_and_outliers(V.txn_nation(spark, sf_dir), (25, 39, 7))
    return kept.groupBy("source", "target").agg(F.count("*").alias("n"))


_ROUNDED = "a, b, round(tot_usd, 4) as tot_usd, num_trans, round(tot_out, 4) as tot_out, round(tot_in, 4) as tot_in"


def _rounded(graph: DataFrame) -> DataFrame:
    return graph.select("a", "b", F.round("tot_usd", 4).alias("tot_usd"), "num_trans", F.round("tot_out", 4).alias("tot_out"), F.round("tot_in", 4).alias("tot_in"))


@query("marginal_graph", f"with {V.EVENT_SQL}, {V.GRAPH_SQL} select {_ROUNDED} from graph")
def marginal_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.marginal_graph(V.txn_event(spark, sf_dir)))


@query("marginal_graph_trade", f"with {V.TRADE_SQL}, {V.GRAPH_SQL} select {_ROUNDED} from graph")
def marginal_graph_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.marginal_graph(V.txn_trade(spark, sf_dir)))


@query("connected_pairs", f"with {V.EVENT_SQL} select distinct source, target from txn")
def connected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.connected_pairs(V.txn_event(spark, sf_dir))


@query(
    "packed_pairs",
    f"with {V.EVENT_SQL} select distinct source + target * 4294967296 as packed, source as source, target as target from txn",
)
def packed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = M.pack_pairs(M.connected_pairs(V.txn_event(spark, sf_dir)))
    return packed.select("packed", F.col("packed").bitwiseAND(0xFFFFFFFF).alias("source"), F.shiftright("packed", 32).alias("target"))


@query(
    "edge_metadata_key",
    f"""with {V.EVENT_SQL}, own as (select source, target, min(transid) as transid from txn group by 1, 2)
    select coalesce(x.source, y.target) as source, coalesce(x.target, y.source) as target, coalesce(x.transid, y.transid) as transid
    from own x full join own y on x.source = y.target and x.target = y.source""",
)
def edge_metadata_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.edge_metadata_key(V.txn_event(spark, sf_dir))


@query(
    "link_attributes",
    f"""with {V.NATION_SQL}, {V.GRAPH_SQL} select a, b, round(coalesce(tot_usd, 0), 2) as tot_usd, num_trans, round(coalesce(tot_out, 0), 2) as tot_out,
    round(coalesce(tot_in, 0), 2) as tot_in from graph where exists (select 1 from nation x, nation y
    where x.n_regionkey = y.n_regionkey and x.n_nationkey = a and y.n_nationkey = b)""",
)
def link_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = V.nation_types(spark, sf_dir)
    pairs = types.select(F.col("node").alias("id1"), "type").join(types.select(F.col("node").alias("id2"), "type"), "type")
    found = M.link_attributes(M.marginal_graph(V.txn_nation(spark, sf_dir)), pairs)
    return found.select("a", "b", *[F.round(c, 2).alias(c) for c in ("tot_usd", "tot_out", "tot_in")], "num_trans")


@query(
    "typed_edges",
    f"""with {V.NATION_SQL}, {V.GRAPH_SQL}, {V.NATION_TYPES_SQL}
    select least(x.type, y.type) as t1, greatest(x.type, y.type) as t2, case when x.type > y.type then b else a end as src,
    case when x.type > y.type then a else b end as dst, num_trans as w from graph join types x on x.node = a join types y on y.node = b""",
)
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.typed_edges(M.marginal_graph(V.txn_nation(spark, sf_dir)), V.nation_types(spark, sf_dir))


@query("max_type", f"with {V.NATION_TYPES_SQL} select max(type) as total_types, count(distinct type) as used_types from types")
def max_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nation_types(spark, sf_dir).agg(F.max("type").alias("total_types"), F.countDistinct("type").alias("used_types"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.symmetric_edges(M.marginal_graph(V.txn_event(spark, sf_dir)))


def written_edges(transactions: DataFrame) -> DataFrame:
    """All edges, written once and in one direction, so that long join chains don't make them anew and know their size."""
    return M.symmetric_edges(save(M.marginal_graph(transactions).select("a", "b", "num_trans"), "edges"))


def written_event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_edges(V.txn_event(spark, sf_dir))


def _event_sql(body: str) -> str:
    return f"with {V.EVENT_SQL}, {V.GRAPH_SQL}, {V.SYM_SQL} {body}"


def _pattern_query(name: str, pattern: P.Pattern, batches: bool = True, **options) -> None:
    @query(name, _event_sql(top_sql(pattern, TOP, **options)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not batches:
            return P.top_matches(event_edges(spark, sf_dir), pattern, TOP, **options)
        return P.top_matches_in_batches(written_event_edges(spark, sf_dir), pattern, TOP, **options)


_pattern_query("pattern_edge_topk", P.EDGE, batches=False)
_pattern_query("pattern_path3_topk", P.PATH3, batches=False)
_pattern_query("pattern_triangle_topk", P.TRIANGLE)
_pattern_query("pattern_star_topk", P.STAR)
_pattern_query("pattern_square_topk", P.SQUARE)
_pattern_query("pattern_path4_topk", P.PATH4)
_pattern_query("pattern_edge_distinct_path4", P.PATH4, injective=False, all_images=True)
_pattern_query("pattern_triangle_topk_batched", P.TRIANGLE)


def _bounded_query(name: str, pattern: P.Pattern, **options) -> None:
    @query(name, _event_sql(top_sql(pattern, TOP, **options)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.top_matches_bounded(written_event_edges(spark, sf_dir), pattern, TOP, **options)


_bounded_query("pattern_triangle_topk_bounded", P.TRIANGLE)
_bounded_query("pattern_square_topk_bounded", P.SQUARE)
_bounded_query("pattern_edge_distinct_path4_bounded", P.PATH4, injective=False, all_images=True)


_TYPED = P.Pattern(P.TRIANGLE.edges, (1, 2, 2))


@query("pattern_typed_triangle_topk", f"with {V.NATION_SQL}, {V.GRAPH_SQL}, {V.NATION_TYPES_SQL}, {V.SYM_SQL} {top_sql(_TYPED, TOP)}")
def pattern_typed_triangle_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = M.symmetric_edges(M.marginal_graph(V.txn_nation(spark, sf_dir)))
    return P.top_matches(edges, _TYPED, TOP, V.nation_types(spark, sf_dir))


#: Matches of which one per node set is kept.
SEARCHED = 1000


@query(
    "pattern_dedup_nodeset",
    _event_sql(
        f"""select array_to_string(list_sort([n_0, n_1, n_2, n_3]), '#') as node_set, n_0, n_1, n_2, n_3, score from ({top_sql(P.SQUARE, SEARCHED, all_images=True)})
        qualify row_number() over (partition by list_sort([n_0, n_1, n_2, n_3]) order by score, n_0, n_1, n_2, n_3) = 1"""
    ),
)
def pattern_dedup_nodeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the best matches, images and all, one for each set of nodes."""
    return P.one_per_node_set(P.top_matches_in_batches(written_event_edges(spark, sf_dir), P.SQUARE, SEARCHED, all_images=True))
