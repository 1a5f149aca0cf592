"""Queries that write files, read them back and give the rows: every reader and writer against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import features as X
from ..operators import graphs as G
from ..operators import ingest as I
from ..operators import marginal as M
from ..operators import observe as O
from ..operators import pattern as P
from ..operators import present as H
from ..operators import rescore as R
from ..operators import shortlist as L
from ..sources import readers, writers
from ..sources.work import folder
from . import views as V
from .behaviour_queries import _MATCHES_SQL, _OBSERVED, _OBSERVED_SQL, _links, top_triangles
from .feature_queries import _FEATURES_SQL, _RATES_SQL, _WHOLE_SQL, OFF_TIES, UNION_LIMIT, _rates, _round, _rounds_sql
from .graph_queries import event_edges
from .pattern_sql import top_sql
from .registry import query, table


def _text(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


@query(
    "transaction_text_round_trip",
    f"""with {V.EVENT_SQL} select transid, source, target, date_trunc('second', time) as time, amount, transid % 1000 = 7 as malformed from txn where transid % 1000 <> 8""",
)
def transaction_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines have a field too many (and are marked), some a word for an amount (and are left out)."""
    path, at = folder(spark, "transactions"), F.col("transid") % 1000
    fields = ["transid", "source", "target", F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.when(at == 8, "much").otherwise(F.col("amount").cast("string"))]
    line = F.concat(F.concat_ws(" ", *fields), F.when(at == 7, " more").otherwise(""))
    _text(V.txn_event(spark, sf_dir).select(line.alias("value")), path)
    return readers.read_transactions(spark, path).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("rates_round_trip", f"with {_RATES_SQL} select day, rate from rates")
def rates_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "rates")
    _text(_rates(spark, sf_dir).select(F.concat_ws(" ", F.date_format("day", "M/d/yyyy"), "rate").alias("value")), path)
    return readers.read_rates(spark, path)


@query(
    "transaction_table_round_trip",
    f"""with {V.TRADE_SQL} select strftime(time, '%Y-%m') as month, count(*) as n, count(distinct source) as sources, count(distinct target) as targets,
    round(sum(usd) + {OFF_TIES}, 2) as usd, min(time) as first, max(time) as last from txn group by 1""",
)
def transaction_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table by months, summed up month by month."""
    path = folder(spark, "transaction_table")
    writers.write_transactions(V.txn_trade(spark, sf_dir), path)
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    return rows.groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"), F.round(F.sum("usd") + OFF_TIES, 2).alias("usd"),
        F.min("time").alias("first"), F.max("time").alias("last"),
    )


_SCHEMA_FILE = "c_custkey: [Integer]\nc:name: [String]\nc_acctbal[]: [Real]\nc_rich: [Boolean]\nc_seen: [Date]"


@query(
    "schema_and_tsv_round_trip",
    """select cast(c_custkey as integer) as c_custkey, nullif(c_name, 'Customer#000000002') as c_name, c_acctbal, c_acctbal > 5000 as c_rich from customer""",
)
def schema_and_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tab-separated values, read by a schema file; an empty field is null."""
    root = folder(spark, "schema")
    spark.createDataFrame([(_SCHEMA_FILE,)], "value string").coalesce(1).write.text(f"{root}/schema")
    name = F.when(F.col("c_name") != "Customer#000000002", F.col("c_name")).otherwise("")
    fields = [F.col("c_custkey").cast("string"), name, F.col("c_acctbal").cast("string"), (F.col("c_acctbal") > 5000).cast("string"), F.lit("2024-01-02 03:04:05 +0000")]
    _text(table(spark, sf_dir, "customer").select(F.concat_ws("\t", *fields).alias("value")), f"{root}/rows")
    return readers.read_tsv(spark, f"{root}/rows", readers.read_schema(spark, f"{root}/schema")).drop("c_seen")


@query("graph_file_round_trip", f"with {V.EVENT_SQL}, {V.GRAPH_SQL}, {V.SYM_SQL} select src, dst, cast(w as double) as w from sym")
def graph_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "graph")
    writers.write_graph(event_edges(spark, sf_dir), path)
    return readers.read_graph(spark, path)


@query("types_file_round_trip", f"with {V.NATION_TYPES_SQL} select node, cast(type as integer) as type from types")
def types_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "types")
    lines = V.nation_types(spark, sf_dir).select(F.concat_ws("\t", "node", "type").alias("value"))
    _text(lines.union(spark.createDataFrame([("#node\ttype",)], "value string")), path)
    return readers.read_types(spark, path)


@query(
    "feature_file_round_trip",
    f"""with {_FEATURES_SQL} select cast("user" as varchar) as id, unnest(range({len(X.FEATURES)})) as place,
    unnest([{", ".join(f"round(cast(cast({c} + {OFF_TIES} as float) as double), 1)" for c in X.FEATURES)}]) as value from features""",
)
def feature_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as a table with a header, read back as vectors of 32-bit numbers."""
    path = folder(spark, "features")
    features = X.user_features(V.txn_event(spark, sf_dir))
    writers.write_features(features.select("user", *[(F.col(c) + OFF_TIES).alias(c) for c in X.FEATURES]), path)
    found = readers.read_features(spark, path).select("id", F.posexplode("vector").alias("place", "value"))
    return found.select("id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 1).alias("value"))


@query(
    "index_round_trip",
    f"""with {V.NATION_SQL}, {V.GRAPH_SQL}, {V.NATION_TYPES_SQL}
    select least(x.type, y.type) as t1, greatest(x.type, y.type) as t2, case when x.type > y.type then b else a end as src,
    case when x.type > y.type then a else b end as dst, num_trans as w from graph join types x on x.node = a join types y on y.node = b""",
)
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed edge lists, a folder for each pair of types."""
    path = folder(spark, "index")
    writers.write_index(M.typed_edges(M.marginal_graph(V.txn_nation(spark, sf_dir)), V.nation_types(spark, sf_dir)), path, "t1", "t2")
    return readers.read_index(spark, path).select("t1", "t2", "src", "dst", "w")


_FILE_PATTERN = P.Pattern(P.TRIANGLE.edges, (1, 2, 2))


@query("pattern_file_search", f"with {V.NATION_SQL}, {V.GRAPH_SQL}, {V.NATION_TYPES_SQL}, {V.SYM_SQL} {top_sql(_FILE_PATTERN, 10)}")
def pattern_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query graph and its types from files, matched against the nations' graph."""
    root = folder(spark, "pattern")
    spark.createDataFrame([("#a triangle",), ("5#6",), ("5#9",), ("6#9",)], "value string").write.text(f"{root}/graph")
    spark.createDataFrame([("5\t1",), ("6\t2",), ("9\t2",)], "value string").write.text(f"{root}/types")
    pattern, _ = readers.read_pattern(spark, f"{root}/graph", f"{root}/types")
    edges = M.symmetric_edges(M.marginal_graph(V.txn_nation(spark, sf_dir)))
    return P.top_matches(edges, pattern, 10, V.nation_types(spark, sf_dir))


@query("observation_dump_round_trip", f"with {_OBSERVED_SQL} select match, " + ", ".join(f"round({c} + {OFF_TIES}, 5) as {c}" for c in _OBSERVED) + " from observed")
def observation_dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "observations")
    writers.write_observations(O.observations(_links(spark, sf_dir), 3), path)
    return _round(spark.read.csv(path, header=True, schema="match long, " + ", ".join(f"{c} double" for c in _OBSERVED)), 5)


@query("external_scores", f"with {_MATCHES_SQL} select match, n_0, n_1, n_2, case when match = 0 then 0.0 when match % 2 = 0 then n_0 / 8 end as score from matches")
def external_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every second match from a file; the query's is 0, a missing one null."""
    path, found = folder(spark, "scores"), top_triangles(V.txn_event(spark, sf_dir))
    found.filter("match % 2 = 0").select("match", F.col("n_0") / 8).write.csv(path, sep="\t")
    return R.external_scores(found, readers.read_scores(spark, path)).select("match", "n_0", "n_1", "n_2", "score")


@query("json_round_trip", f"with {V.EVENT_SQL}, {V.GRAPH_SQL} select a, b, round(tot_usd, 4) as tot_usd, num_trans, round(tot_out, 4) as tot_out, round(tot_in, 4) as tot_in from graph")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of the marginal graph as JSON text in a file and back; nulls stay nulls."""
    path, graph = folder(spark, "json"), M.marginal_graph(V.txn_event(spark, sf_dir))
    _text(writers.to_json(graph).withColumnRenamed("json", "value"), path)
    back = writers.from_json(spark.read.text(path).withColumnRenamed("value", "json"), graph.schema)
    return back.select("a", "b", F.round("tot_usd", 4).alias("tot_usd"), "num_trans", F.round("tot_out", 4).alias("tot_out"), F.round("tot_in", 4).alias("tot_in"))


@query(
    "users_still_present",
    _rounds_sql(_WHOLE_SQL, UNION_LIMIT, "union", 9)
    + """ select "user", n from (select source as "user", count(*) as n from t0 group by 1) where "user" in (select source from t9 union select target from t9)""",
)
def users_still_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the first table, with their transactions as source there, who are left after the activity fixpoint."""
    txn = V.txn_event(spark, sf_dir)
    users = txn.groupBy(F.col("source").alias("user")).agg(F.count("*").alias("n"))
    return A.users_in(A.activity_fixpoint(txn, UNION_LIMIT), users)


_SINCE_SQL = _OBSERVED_SQL.replace("(first - coalesce(lag(first)", "(first - coalesce(lag(last)").replace("observed as", "observed_since as")


@query("observation_vectors_since_transaction", f"with {_SINCE_SQL} select match, bucket, n, " + ", ".join(f"round({c} + {OFF_TIES}, 5) as {c}" for c in _OBSERVED) + " from observed_since")
def observation_vectors_since_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that counts the gap from the last bucket's last transaction."""
    return _round(O.observations(_links(spark, sf_dir), 3, since="transaction"), 5)


@query(
    "prioritized_product",
    """with lists as (select n_nationkey // 5 as list, n_nationkey % 5 as r, n_name as item from nation), l0 as (select * from lists where list = 0), l1 as (select * from lists where list = 1),
    l2 as (select * from lists where list = 2) select l0.item as item_0, l0.r as rank_0, l1.item as item_1, l1.r as rank_1, l2.item as item_2, l2.r as rank_2,
    row_number() over (order by greatest(l0.r, l1.r, l2.r), 4 * cast(l0.r = greatest(l0.r, l1.r, l2.r) as int) + 2 * cast(l1.r = greatest(l0.r, l1.r, l2.r) as int)
      + cast(l2.r = greatest(l0.r, l1.r, l2.r) as int), l0.r, l1.r, l2.r) - 1 as place from l0, l1, l2""",
)
def prioritized_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples of three ranked lists of five nations, numbered in prioritised order."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("item"), F.col("n_nationkey").alias("key"))
    lists = [nation.filter(F.floor(F.col("key") / 5) == i).select("item", (F.col("key") % 5).alias("rank")) for i in range(3)]
    return L.prioritized_product(lists)


#: The session setting that names a database for the round trip; without it a local master's own, in memory.
DATABASE = "spark.echotrail.jdbc.url"


@query(
    "relational_round_trip",
    f"with {V.EVENT_SQL} select transid, source, target, time, usd from txn where usd > 25 and source < 100",
)
def relational_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions to a database and back, in ranges of their ids; the filter and the columns go to the database."""
    url = spark.conf.get(DATABASE, None)
    if url is None:
        spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
        url = "jdbc:derby:memory:echotrail;create=true"
    transactions = V.txn_event(spark, sf_dir).select("transid", "source", "target", "time", "amount", "usd")
    writers.write_jdbc(transactions, url, "transactions")
    back = readers.read_jdbc_ranges(spark, url, "transactions", "transid")
    return back.filter("usd > 25 and source < 100").select("transid", "source", "target", "time", "usd")


#: Nodes whose links make a pattern.
_EXAMPLE = (1, 2, 3, 4)


@query(
    "pattern_of_exemplars",
    f"""with {V.EVENT_SQL}, {V.GRAPH_SQL}, own as (select a, b from graph where a in {_EXAMPLE} and b in {_EXAMPLE}),
    nodes as (select node, row_number() over (order by node) - 1 as role from (select a as node from own union select b from own))
    select x.role as role_a, y.role as role_b, a, b from own join nodes x on x.node = a join nodes y on y.node = b""",
)
def pattern_of_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern that four users form, edge by edge, with the node of each role."""
    known = P.pattern_of(spark, M.marginal_graph(V.txn_event(spark, sf_dir)), list(_EXAMPLE))
    rows = [(i, j, known[1][i], known[1][j]) for i, j in known[0].edges] if known else []
    return spark.createDataFrame(rows, "role_a long, role_b long, a long, b long")


@query(
    "graph_mutation",
    f"""with {V.EVENT_SQL}, {V.GRAPH_SQL}, {V.SYM_SQL}, kept as (select * from sym where (src + dst) % 7 <> 0), more as (select distinct src, src + 1000000 as dst, 1 as w from sym where src % 5 = 0)
    select * from kept union all select src, dst, w from more union all select dst, src, w from more""",
)
def graph_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges taken out of the event graph and put into it."""
    edges = event_edges(spark, sf_dir)
    fewer = G.without_edges(edges, edges.filter("(src + dst) % 7 = 0 and src < dst"))
    return G.with_edges(fewer, edges.filter("src % 5 = 0").select("src", (F.col("src") + 1_000_000).alias("dst"), F.lit(1).cast("long").alias("w")).distinct())


@query(
    "results_text",
    f"""with {_MATCHES_SQL}, best as (select *, row_number() over (order by score desc, n_0, n_1, n_2) as place from ({top_sql(P.TRIANGLE, 10)}))
    select string_agg(score || chr(9) || 'E0:' || n_0 || chr(9) || 'E1:' || n_1 || chr(9) || 'E2:' || n_2, chr(10) order by place) as text from best""",
)
def results_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best triangles as a table of text."""
    rows = [r.asDict() for r in top_triangles(V.txn_event(spark, sf_dir)).orderBy("match").select("score", "n_0", "n_1", "n_2").collect()]
    return spark.createDataFrame([(H.text_table(rows),)], "text string")


@query(
    "entity_html",
    """with t as (select *, row_number() over (order by n_nationkey) as place from nation)
    select '<table><tr><th>Score</th><th>ID</th><th>KEY</th><th>NAME</th></tr>' || string_agg('<tr><td>0.5</td><td>n' || n_nationkey || '</td><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' order by place)
    || '</table>' as html from t""",
)
def entity_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()  # 25 rows
    page = H.entity_table([(0.5, f"n{r.n_nationkey}", {"NAME": r.n_name, "KEY": str(r.n_nationkey)}) for r in rows])
    return spark.createDataFrame([(page,)], "html string")


@query(
    "lines_without_rate",
    f"""with {_RATES_SQL}, lines as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as day, l_quantity as amount from lineitem)
    select l_orderkey, l_linenumber, rate is null as no_rate from lines left join rates using (day) where rate is null""",
)
def lines_without_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on days without a rate of their own: with_rate gives them the nearest end's, or 0 inside the range."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("amount"))
    rates = _rates(spark, sf_dir)
    ends = rates.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    priced = I.with_rate(lines, rates).join(F.broadcast(ends), how="left")
    return priced.filter("rate = 0 or day < lo or day > hi").select("l_orderkey", "l_linenumber", F.lit(True).alias("no_rate"))
