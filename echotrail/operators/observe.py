"""Transactions among the nodes of matches, and what is observed of them over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import save

#: Transactions in a bucket, and of an ordered pair at most.
BUCKET, PAIR_LIMIT = 2, 250


def millis(time: str) -> Column:
    """Milliseconds of a timestamp (one without a zone counts as the session's)."""
    return F.unix_millis(F.col(time).cast("timestamp"))


def links_among(transactions: DataFrame, ids: DataFrame, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Transactions between different nodes of ``ids(id)``, in an inclusive time range.

    limit: the first so many of each ordered pair, by time (then USD and amount).
    """
    own = ids.select("id").distinct()
    found = transactions.filter("source <> target")
    if start is not None:
        found = found.filter(F.col("time") >= F.lit(start))
    if end is not None:
        found = found.filter(F.col("time") <= F.lit(end))
    found = found.join(own.withColumnRenamed("id", "source"), "source", "left_semi").join(own.withColumnRenamed("id", "target"), "target", "left_semi")
    if limit is None:
        return found
    place = F.row_number().over(W.partitionBy("source", "target").orderBy("time", "usd", "amount"))
    return found.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def one_hop(transactions: DataFrame, ids: DataFrame, start=None, end=None) -> DataFrame:
    """Transactions with at least one end among ``ids(id)``, in an inclusive time range."""
    found = transactions
    if start is not None:
        found = found.filter(F.col("time") >= F.lit(start))
    if end is not None:
        found = found.filter(F.col("time") <= F.lit(end))
    own = ids.select("id").distinct()
    out = found.join(own.withColumnRenamed("id", "source"), "source", "left_semi").select(transactions.columns)
    into = found.join(own.withColumnRenamed("id", "target"), "target", "left_semi").join(own.withColumnRenamed("id", "source"), "source", "left_anti")
    return out.union(into.select(transactions.columns))


def data_summary(transactions: DataFrame) -> DataFrame:
    """(key, value): the numbers of entities, links and pairs, the USD moved, and the first and last day."""
    ends = transactions.select(F.col("source").alias("n")).union(transactions.select("target")).agg(F.countDistinct("n").cast("string").alias("entities"))
    rest = transactions.agg(
        F.count("*").cast("string").alias("links"), F.countDistinct(F.least("source", "target"), F.greatest("source", "target")).cast("string").alias("pairs"),
        F.round(F.sum("usd"), 2).cast("decimal(20,2)").cast("string").alias("usd"), F.to_date(F.min("time")).cast("string").alias("first"), F.to_date(F.max("time")).cast("string").alias("last"),
    )
    both = ends.join(F.broadcast(rest))  # one row each
    return both.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in both.columns]), F.array(*both.columns))).alias("key", "value"))


def accounts(transactions: DataFrame, entities: DataFrame) -> DataFrame:
    """Per entity: how many transactions and counterparts it has, its USD in and out, and its first and last day."""
    flat = transactions.select(F.col("source").alias("entity"), F.col("target").alias("other"), (-F.col("usd")).alias("v"), "time").union(
        transactions.select("target", "source", "usd", "time")
    )
    return flat.join(entities.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(
        F.count("*").alias("n"), F.countDistinct("other").alias("counterparts"), F.sum(F.when(F.col("v") > 0, F.col("v")).otherwise(0.0)).alias("incoming"),
        F.sum(F.when(F.col("v") < 0, -F.col("v")).otherwise(0.0)).alias("outgoing"), F.to_date(F.min("time")).alias("first"), F.to_date(F.max("time")).alias("last"),
    )


def members(matches: DataFrame) -> DataFrame:
    """(match, role, node) of ``matches(match, n_0, n_1, ...)``."""
    roles = [c for c in matches.columns if c.startswith("n_")]
    each = F.array(*[F.struct(F.lit(int(c[2:])).alias("role"), F.col(c).alias("node")) for c in roles])
    return matches.select("match", F.explode(each).alias("m")).select("match", "m.role", "m.node")


def match_links(transactions: DataFrame, matches: DataFrame) -> DataFrame:
    """The transactions among each match's nodes, with match, role_s and role_t."""
    who = members(matches)
    source = who.select("match", F.col("role").alias("role_s"), F.col("node").alias("source"))
    target = who.select("match", F.col("role").alias("role_t"), F.col("node").alias("target"))
    return transactions.join(source, "source").join(target, ["match", "target"]).filter("role_s <> role_t")


def _flow(i: int, j: int) -> Column:
    forth, back = (F.col("role_s") == i) & (F.col("role_t") == j), (F.col("role_s") == j) & (F.col("role_t") == i)
    return F.coalesce(F.sum(F.when(forth, F.col("usd")).when(back, -F.col("usd"))), F.lit(0.0)).alias(f"flow_{i}_{j}")


def observations(links: DataFrame, roles: int, bucket: int = BUCKET, since: str = "bucket") -> DataFrame:
    """One vector per match and bucket of ``bucket`` transactions in time order.

    f0: the time within the bucket; f1: from the last bucket's start to this
    one's; then the net flow of each pair of roles. A bucket that lasts d > 0
    has f0 and f1 over d (a last, unfull one f1 over its end minus the last
    bucket's start). Times are in milliseconds. Transactions at the same time
    go by their roles and USD. since="transaction": f1 counts from the last
    transaction instead of the last bucket's start.
    """
    if since not in ("bucket", "transaction"):
        raise ValueError("since must be bucket or transaction")
    order = W.partitionBy("match").orderBy("time", "role_s", "role_t", "usd")
    numbered = links.withColumns({"ms": millis("time"), "bucket": F.floor((F.row_number().over(order) - 1) / bucket).cast("long")})
    flows = [_flow(i, j) for i in range(roles) for j in range(i + 1, roles)]
    rows = numbered.groupBy("match", "bucket").agg(F.min("ms").alias("first"), F.max("ms").alias("last"), F.count("*").alias("n"), *flows)
    before = F.lag("first" if since == "bucket" else "last").over(W.partitionBy("match").orderBy("bucket"))
    rows = rows.withColumns({"before": F.coalesce(before, F.col("first")), "d": (F.col("last") - F.col("first")).cast("double")})
    gap = (F.col("first") - F.col("before")).cast("double")
    f0 = F.when(F.col("d") > 0, 1.0).otherwise(0.0)
    f1 = F.when(F.col("d") <= 0, gap).when(F.col("n") == bucket, F.try_divide(gap, F.col("d"))).otherwise(F.try_divide(gap, (F.col("last") - F.col("before")).cast("double")))
    names = [f"flow_{i}_{j}" for i in range(roles) for j in range(i + 1, roles)]
    return rows.select("match", "bucket", "n", f0.alias("f0"), f1.alias("f1"), *names)


def transaction_features(links: DataFrame) -> DataFrame:
    """Per transaction of a match: its deviations, the time since the last one over the match's length, and the amount over the last one's."""
    order = W.partitionBy("match").orderBy("time", "role_s", "role_t", "usd")
    whole = W.partitionBy("match")
    ms = links.withColumn("ms", millis("time"))
    length = (F.max("ms").over(whole) - F.min("ms").over(whole)).cast("double")
    since = (F.col("ms") - F.coalesce(F.lag("ms").over(order), F.col("ms"))).cast("double")
    return ms.withColumns({
        "gap": F.coalesce(F.try_divide(since, length), F.lit(0.0)),
        "ratio": F.coalesce(F.try_divide(F.col("amount"), F.coalesce(F.lag("amount").over(order), F.col("amount"))), F.lit(0.0)),
    })


def aggregate_links(links: DataFrame, *by: str) -> DataFrame:
    """Per match (and ``by``) and pair of roles: how many transactions, and the USD out (low to high role), in and net."""
    low, high = F.least("role_s", "role_t"), F.greatest("role_s", "role_t")
    out = F.sum(F.when(F.col("role_s") < F.col("role_t"), F.col("usd")).otherwise(0.0))
    back = F.sum(F.when(F.col("role_s") > F.col("role_t"), F.col("usd")).otherwise(0.0))
    return links.groupBy("match", *by, low.alias("role_a"), high.alias("role_b")).agg(
        F.count("*").alias("num_edges"), out.alias("out_flow"), back.alias("in_flow"), (out - back).alias("net_flow")
    )


def sessions(transactions: DataFrame, gap_ms: int, key: str = "source") -> DataFrame:
    """Each transaction with its ``session`` (from 0): a new one where the key's last was over ``gap_ms`` ago.

    Windows hold one key's day: a day's first transaction is compared with the
    last day's end, and the sessions of earlier days are added, both from a
    table with a row per key and day. So a busy key is no task of its own.
    """
    whole = transactions.withColumns({"_ms": millis("time"), "_day": F.to_date("time")})
    before = W.partitionBy(key).orderBy("_day")
    ends = whole.groupBy(key, "_day").agg(F.max("_ms").alias("_end")).select(key, "_day", F.lag("_end").over(before).alias("_before"))
    order = W.partitionBy(key, "_day").orderBy("time", "transid")
    apart = F.col("_ms") - F.coalesce(F.lag("_ms").over(order), F.col("_before")) > gap_ms
    rows = whole.join(ends, [key, "_day"]).withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int"))
    opened = rows.groupBy(key, "_day").agg(F.sum("_new").alias("_opened"))
    earlier = opened.select(key, "_day", F.coalesce(F.sum("_opened").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    within = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.join(earlier, [key, "_day"]).withColumn("session", within + F.col("_earlier")).select(*[F.col(f"`{c}`") for c in transactions.columns], "session")


#: Distinct centers of a density that travel as one row, on average, and blocks of them between writes.
CENTERS_AT_ONCE, BLOCKS_AT_ONCE = 4096, 8


def kernel_density(rows: DataFrame, centers: DataFrame, columns: list[str], bandwidth: float, floor: float = 1e-18, at_once: int | None = None) -> DataFrame:
    """``rows`` with ``likelihood``: the Gaussian kernel density of their columns around ``centers``.

    Equal centers are counted, and the distinct ones travel in blocks of
    ``at_once``, one row a block, whose sums add up; after every few blocks the
    sums are written. A center with a null makes every density the floor.
    """
    points = centers.groupBy(*columns).agg(F.count("*").alias("_times"))
    points = save(points.select(F.array(*[F.col(c) for c in columns]).alias("_point"), "_times"), "centers")
    distinct, n = points.agg(F.count("*"), F.coalesce(F.sum("_times"), F.lit(0))).first()
    blocks = max(1, -(-distinct // (at_once or CENTERS_AT_ONCE)))
    here = F.array(*[F.col(c) for c in columns])
    square = lambda c: F.aggregate(F.zip_with(here, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    partial = F.aggregate("_centers", F.lit(0.0), lambda s, c: s + c["_times"] * F.exp(-0.5 * square(c["_point"]) / bandwidth**2))
    summed = rows.withColumn("_total", F.lit(0.0))
    for i in range(blocks):
        own = points.filter(F.pmod(F.xxhash64("_point"), F.lit(blocks)) == i).agg(F.collect_list(F.struct("_point", "_times")).alias("_centers"))
        summed = summed.join(F.broadcast(own), how="left").withColumn("_total", F.col("_total") + partial).drop("_centers")
        if (i + 1) % BLOCKS_AT_ONCE == 0:
            summed = save(summed, "densities")
    density = F.try_divide(F.col("_total"), F.pow(F.lit(n) * 2 * bandwidth**2 * 3.141592653589793, F.lit(len(columns) / 2)))
    return summed.withColumn("likelihood", F.greatest(F.coalesce(F.nanvl(density, F.lit(floor)), F.lit(floor)), F.lit(floor))).drop("_total")


def flow_aggregation(transactions: DataFrame, entities: DataFrame, focus: DataFrame | None = None, direction: str = "both", start=None, end=None) -> DataFrame:
    """Per entity and counterpart: the number and USD of transactions out, in or both ways."""
    rows = transactions
    if start is not None:
        rows = rows.filter(F.col("time") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("time") <= F.lit(end))
    sides = []
    if direction in ("out", "both"):
        sides.append(rows.select(F.col("source").alias("entity"), F.col("target").alias("counterpart"), F.lit("out").alias("direction"), "usd"))
    if direction in ("in", "both"):
        sides.append(rows.select(F.col("target").alias("entity"), F.col("source").alias("counterpart"), F.lit("in").alias("direction"), "usd"))
    if not sides:
        raise ValueError("direction must be out, in or both")
    flat = reduce(lambda x, y: x.union(y), sides).join(entities.select("entity").distinct(), "entity", "left_semi")
    if focus is not None:
        flat = flat.join(focus.select(F.col("entity").alias("counterpart")).distinct(), "counterpart", "left_semi")
    return flat.groupBy("entity", "counterpart", "direction").agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))


def time_series(transactions: DataFrame, entities: DataFrame, start: str, bins: int, days: int) -> DataFrame:
    """Per entity and bin of ``days`` days from ``start``: USD in, out and net; bins without any are 0."""
    flat = transactions.select(F.col("source").alias("entity"), "time", (-F.col("usd")).alias("v")).union(transactions.select("target", "time", "usd"))
    own = entities.select("entity").distinct()
    flat = flat.join(own, "entity", "left_semi").withColumn("bin", F.floor(F.datediff(F.to_date("time"), F.lit(start).cast("date")) / days).cast("int"))
    flat = flat.filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    sums = flat.groupBy("entity", "bin").agg(
        F.sum(F.when(F.col("v") > 0, F.col("v")).otherwise(0.0)).alias("incoming"), F.sum(F.when(F.col("v") < 0, -F.col("v")).otherwise(0.0)).alias("outgoing")
    )
    every = own.select("entity", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(sums, ["entity", "bin"], "left").fillna(0.0, ["incoming", "outgoing"]).withColumn("net", F.col("incoming") - F.col("outgoing"))
