"""Transaction views over the driver tables, as DataFrames and as SQL.

Each has transid, source, target, time, amount, usd. No view moves all rows
through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import with_next
from .registry import table

#: Suppliers' node ids in the trade view start here.
SUPPLIER_BASE = 1_000_000


def txn_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's user acts on the user of the next event."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    followed = with_next(events, "user_id", ["ts", "event_id"])
    return followed.filter("next is not null and next <> user_id").select(
        F.col("event_id").alias("transid"), F.col("user_id").alias("source"), F.col("next").alias("target"), F.col("ts").alias("time"),
        F.col("value").alias("amount"), F.col("value").alias("usd"),
    )


EVENT_SQL = """txn as (
  select event_id as transid, user_id as source, nxt as target, ts as time, value as amount, value as usd, event_type
  from (select *, lead(user_id) over (order by ts, event_id) as nxt from events)
  where nxt is not null and nxt <> user_id)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("usd", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    )


def txn_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's nation buys from the supplier's."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("source"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("target"))
    return (
        _lines(spark, sf_dir)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("source").cast("long"), F.col("target").cast("long"), F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("amount"), "usd")
    )


NATION_SQL = """txn as (
  select cast(c_nationkey as bigint) as source, cast(s_nationkey as bigint) as target, l_shipdate as time, l_quantity as amount,
         l_extendedprice * (1 - l_discount) as usd
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"""


def nation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_regionkey") + 1).alias("type"))


NATION_TYPES_SQL = "types as (select cast(n_nationkey as bigint) as node, n_regionkey + 1 as type from nation)"


def txn_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer buys from a supplier."""
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("source"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("target"), F.col("l_shipdate").alias("time"),
        F.col("l_quantity").alias("amount"), "usd",
    )


TRADE_SQL = f"""txn as (
  select o_custkey as source, l_suppkey + {SUPPLIER_BASE} as target, l_shipdate as time, l_quantity as amount, l_extendedprice * (1 - l_discount) as usd
  from lineitem join orders on l_orderkey = o_orderkey)"""

#: A user's type in the event view.
USER_TYPES = 3


def user_types(graph: DataFrame) -> DataFrame:
    nodes = graph.select(F.col("a").alias("node")).union(graph.select("b")).distinct()
    return nodes.select("node", (F.col("node") % USER_TYPES + 1).cast("int").alias("type"))


GRAPH_SQL = """graph as (
  select least(source, target) as a, greatest(source, target) as b, sum(usd) as tot_usd, count(*) as num_trans,
         sum(case when source < target then usd end) as tot_out, sum(case when source > target then usd end) as tot_in
  from txn where source <> target group by 1, 2)"""
USER_TYPES_SQL = f"types as (select node, node % {USER_TYPES} + 1 as type from (select a as node from graph union select b from graph))"
SYM_SQL = "sym as (select a as src, b as dst, num_trans as w from graph union all select b, a, num_trans from graph)"
