"""Queries for property search, search by example and output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import observe as O
from ..operators import present as H
from ..operators import search as S
from . import views as V
from .behaviour_queries import _AGGREGATE, _BUCKETS_SQL, _DECODED_SQL, _LINKS_SQL, _MATCHES_SQL, _links, top_phases, top_triangles
from .feature_queries import _LOGS_SQL, OFF_TIES
from .hmm_sql import PHASES, decoded_sql
from .registry import query, table


def entity_dataset(spark: SparkSession, sf_dir: str) -> S.Dataset:
    own = lambda name: table(spark, sf_dir, name)
    return S.Dataset(
        [
            S.EntityTable("customer", own("customer"), "c_custkey", "c", "Customer"),
            S.EntityTable("supplier", own("supplier"), "s_suppkey", "s", "Supplier"),
            S.EntityTable("part", own("part"), "p_partkey", "p", "Part"),
            S.EntityTable("nation", own("nation"), "n_nationkey", "n", "Nation"),
        ],
        {"NAME": ["c_name", "s_name", "n_name"], "LABEL": ["c_mktsegment", "p_brand"]},
        [S.ForeignLink("customer", "supplier", "trade", "o_custkey", "l_suppkey")],
    )


@query("property_search_and", "select 'customer' as _table, 'c' || c_custkey as uid, c_name as name from customer where c_mktsegment = 'BUILDING' and c_nationkey <> 3")
def property_search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [S.Property("c_mktsegment", "BUILDING"), S.Property("c_nationkey", "3", S.NOT)]
    return S.property_search(entity_dataset(spark, sf_dir), wanted).select("_table", "uid", F.col("c_name").alias("name"))


@query(
    "property_search_or",
    """select 'customer' as _table, 'c' || c_custkey as uid from customer where (c_mktsegment = 'BUILDING' or c_mktsegment = 'MACHINERY') and contains(c_name, '1')""",
)
def property_search_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [S.Property("c_mktsegment", "BUILDING", S.OPTIONAL_EQUALS), S.Property("c_mktsegment", "MACHINERY", S.OPTIONAL_EQUALS), S.Property("c_name", "1", S.REQUIRED_PARTIAL)]
    return S.property_search(entity_dataset(spark, sf_dir), wanted).select("_table", "uid")


@query(
    "property_search_fuzzy",
    """select 'customer' as _table, 'c' || c_custkey as uid from customer where contains(c_name, '12') union all
    select 'supplier', 's' || s_suppkey from supplier where contains(s_name, '12') union all select 'nation', 'n' || n_nationkey from nation where contains(n_name, '12')""",
)
def property_search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag that stands for a column of three tables."""
    found = S.property_search(entity_dataset(spark, sf_dir), [S.Property("NAME", "12", S.PARTIAL_OPTIONAL)])
    return found.select("_table", "uid")


@query(
    "property_search_page",
    "select 'part' as _table, 'p' || p_partkey as uid, p_brand from part where p_size = 15 order by p_partkey limit 7 offset 3",
)
def property_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.property_search(entity_dataset(spark, sf_dir), [S.Property("p_size", "15")], 7, 3).select("_table", "uid", "p_brand")


@query(
    "ranked_search",
    """select 'customer' as _table, 'c' || c_custkey as uid, (cast(c_mktsegment = 'BUILDING' as int) + cast(c_nationkey = 3 as int)) / 2 as score from customer
    where c_mktsegment = 'BUILDING' or c_nationkey = 3 order by score desc, uid limit 50""",
)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked_search(entity_dataset(spark, sf_dir), [S.Property("c_mktsegment", "BUILDING"), S.Property("c_nationkey", "3")], 50)


@query(
    "entities_by_id",
    """select 'customer' as _table, 'c' || c_custkey as uid, c_name as name from customer where c_custkey in (1, 17) union all
    select 'supplier', 's' || s_suppkey, s_name from supplier where s_suppkey in (3) union all select null, 'zz9', null""",
)
def entities_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.entities_by_id(entity_dataset(spark, sf_dir), ["c1", "c17", "s3", "zz9"])
    return found.select("_table", "uid", F.coalesce("c_name", "s_name").alias("name"))


@query(
    "entity_properties",
    """select 's' || s_suppkey as uid, 's_name' as key, s_name as value, 'STRING' as type from supplier union all
    select 's' || s_suppkey, 's_nationkey', cast(s_nationkey as varchar), 'LONG' from supplier union all
    select 's' || s_suppkey, 's_acctbal', cast(s_acctbal as varchar), 'DOUBLE' from supplier union all
    select 's' || s_suppkey, 'TYPE', 'Supplier', 'STRING' from supplier""",
)
def entity_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = entity_dataset(spark, sf_dir)
    return S.properties_of(next(t for t in dataset.tables if t.name == "supplier"))


@query(
    "linked_entities",
    """select 'c' || o_custkey as source_uid, 's' || l_suppkey as target_uid, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
)
def linked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = entity_dataset(spark, sf_dir)
    trade = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return S.linked_entities(dataset, dataset.links[0], trade).groupBy("source_uid", "target_uid").agg(F.count("*").alias("n"))


#: A query by example: three users.
EXAMPLE = [1, 2, 3]

_LINKED = lambda i, j: f"(select count(*) > 0 from graph where a = {EXAMPLE[i]} and b = {EXAMPLE[j]})"
#: The best matches of the pattern that the three form (two links at least), one for each set of nodes, numbered with the example first.
_SEARCHED_SQL = f"""flags as (select {_LINKED(0, 1)} as e01, {_LINKED(0, 2)} as e02, {_LINKED(1, 2)} as e12),
  nodes as (select distinct src as node from sym),
  triples as (select x.node as n_0, y.node as n_1, z.node as n_2, coalesce(case when e01 then p.w end, 0) + coalesce(case when e02 then q.w end, 0) + coalesce(case when e12 then r.w end, 0) as score
    from flags, nodes x join nodes y on x.node <> y.node join nodes z on z.node <> x.node and z.node <> y.node
    left join sym p on p.src = x.node and p.dst = y.node left join sym q on q.src = x.node and q.dst = z.node left join sym r on r.src = y.node and r.dst = z.node
    where (p.w is not null or not e01) and (q.w is not null or not e02) and (r.w is not null or not e12)
    and case when e01 and e02 and e12 then x.node < y.node and y.node < z.node when e01 and e02 then y.node < z.node when e01 then x.node < z.node else x.node < y.node end),
  best as (select * from triples order by score desc, n_0, n_1, n_2 limit 1000),
  sets as (select n_0, n_1, n_2, score from best qualify row_number() over (partition by list_sort([n_0, n_1, n_2]) order by score, n_0, n_1, n_2) = 1),
  matches as (select row_number() over (order by score desc, n_0, n_1, n_2) - 1 as match, * from (
    select n_0, n_1, n_2, cast(score as double) as score from sets union all select {", ".join(map(str, EXAMPLE))}, cast('inf' as double)))"""
_GRAPHS_SQL = f"{V.EVENT_SQL}, {V.GRAPH_SQL}, {V.SYM_SQL}"


@query("search_by_example", f"with {_GRAPHS_SQL}, {_SEARCHED_SQL} select match, n_0, n_1, n_2, score from matches order by score desc, n_0, n_1, n_2 limit 10")
def search_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_by_example(V.txn_event(spark, sf_dir), EXAMPLE, unlinked=True)


@query(
    "search_by_example_hmm",
    f"""with recursive {_GRAPHS_SQL}, {_SEARCHED_SQL}, {_LINKS_SQL}, {_BUCKETS_SQL}, {decoded_sql()}
    select match, n_0, n_1, n_2, round(r.score + {OFF_TIES}, 6) as score from matches join rescored r using (match) order by r.score desc, n_0, n_1, n_2 limit 10""",
)
def search_by_example_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_by_example(V.txn_event(spark, sf_dir), EXAMPLE, hmm=True, unlinked=True).withColumn("score", F.round(F.col("score") + OFF_TIES, 6))


@query(
    "search_single_entity",
    f"""with {_LOGS_SQL}, vec as (select "user" as id, [{", ".join(X.FEATURES)}] as v from logs)
    select row_number() over (order by list_distance(x.v, y.v), y.id) - 1 as match, y.id as n_0, round(1 / (1 + list_distance(x.v, y.v)) + {OFF_TIES}, 6) as score
    from vec x, vec y where x.id = {EXAMPLE[0]} qualify match < 10""",
)
def search_single_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = V.txn_event(spark, sf_dir)
    logs = X.log_transform(X.user_features(txn))
    found = S.search_by_example(txn, EXAMPLE[:1], vectors=logs.select(F.col("user").alias("id"), F.array(*X.FEATURES).alias("vector")))
    return found.withColumn("score", F.round(F.col("score") + OFF_TIES, 6))


_AGGREGATED_SQL = f"aggregated as (select match, least(role_s, role_t) as role_a, greatest(role_s, role_t) as role_b, {_AGGREGATE} from links group by 1, 2, 3)"


def _aggregated(spark: SparkSession, sf_dir: str, matches: DataFrame) -> DataFrame:
    found = O.aggregate_links(O.match_links(V.txn_event(spark, sf_dir), matches))
    return found.withColumns({c: F.round(c, 4) for c in ("out_flow", "in_flow", "net_flow")})


@query(
    "sankey_json",
    f"""{_DECODED_SQL}, {PHASES}, {_AGGREGATED_SQL},
    ph as (select match, phase, least(role_s, role_t) as role_a, greatest(role_s, role_t) as role_b, {_AGGREGATE} from phased group by 1, 2, 3, 4),
    flows as (select match, -1 as phase, role_a, role_b, net_flow from aggregated
      union all select a.match, s.phase, a.role_a, a.role_b, coalesce(ph.net_flow, 0) from aggregated a join (select distinct match, phase from ph) s on s.match = a.match
      left join ph on ph.match = a.match and ph.phase = s.phase and ph.role_a = a.role_a and ph.role_b = a.role_b),
    nth as (select *, row_number() over (partition by match, phase order by role_a, role_b) - 1 as id from flows),
    lists as (select match, phase, '[' || string_agg('{{"id":' || id || ',"source":' || case when net_flow < 0 then role_b else role_a end || ',"target":'
      || case when net_flow < 0 then role_a else role_b end || ',"value":' || abs(net_flow) || '}}', ',' order by id) || ']' as l from nth group by 1, 2),
    whole as (select match, string_agg(l, ',' order by phase) as l from lists group by 1)
    select m.match, '{{"nodes":[{{"name":"' || n_0 || '"}},{{"name":"' || n_1 || '"}},{{"name":"' || n_2 || '"}}],"links":[' || coalesce(l, '') || ']}}' as json from matches m left join whole on whole.match = m.match""",
)
def sankey_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = top_triangles(V.txn_event(spark, sf_dir))
    return H.sankey(matches, _aggregated(spark, sf_dir, matches), top_phases(spark, sf_dir))


@query(
    "results_json",
    f"""with {_MATCHES_SQL}, {_AGGREGATED_SQL}, lists as (select match, string_agg('{{"role_a":' || role_a || ',"role_b":' || role_b || ',"num_edges":' || num_edges || ',"out_flow":' || out_flow
      || ',"in_flow":' || in_flow || ',"net_flow":' || net_flow || '}}', ',' order by role_a, role_b) as l from aggregated group by 1)
    select m.match, '{{"score":' || score || ',"entities":[{{"role":"E0","uid":"' || n_0 || '"}},{{"role":"E1","uid":"' || n_1 || '"}},{{"role":"E2","uid":"' || n_2
      || '"}}],"links":[' || coalesce(l, '') || ']}}' as json from matches m left join lists on lists.match = m.match""",
)
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = top_triangles(V.txn_event(spark, sf_dir))
    return H.results_json(matches, _aggregated(spark, sf_dir, matches))


@query(
    "time_plot_rows",
    f"""with {_MATCHES_SQL}, spans as (select match, max(epoch_ms(time)) - min(epoch_ms(time)) as span from links group by 1)
    select match, time, role_s, role_t, usd, case when role_s < role_t then 'down' else 'up' end as direction,
    case when span >= 172800000 then 'days' when span >= 7200000 then 'hours' when span >= 120000 then 'minutes' else 'seconds' end as unit from links join spans using (match)""",
)
def time_plot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.time_plot_rows(_links(spark, sf_dir))
