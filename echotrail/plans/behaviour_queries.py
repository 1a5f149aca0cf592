"""Queries on the behaviour of matches over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import marginal as M
from ..operators import observe as O
from ..operators import pattern as P
from ..operators import rescore as R
from ..sources.work import save
from . import views as V
from .feature_queries import _AVERAGES_SQL, OFF_TIES, _round
from .graph_queries import TOP, written_edges
from .hmm_sql import OBSERVED, PHASES, decoded_sql, session_sql
from .pattern_sql import top_sql
from .registry import query, table

#: A time range of the events, and exemplar ids.
START, END = "2024-01-08 00:00:00", "2024-01-21 23:59:59"
EXEMPLARS = list(range(1, 21))


def _ids(spark: SparkSession, name: str = "id") -> DataFrame:
    return spark.createDataFrame([(x,) for x in EXEMPLARS], f"{name} long")


_LINK_COLUMNS = "transid, source, target, time, usd"


@query(
    "links_in_time_range",
    f"""with {V.EVENT_SQL} select {_LINK_COLUMNS} from txn where source between 1 and 20 and target between 1 and 20 and source <> target
    and time between timestamp '{START}' and timestamp '{END}'""",
)
def links_in_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp")
    return O.links_among(V.txn_event(spark, sf_dir), _ids(spark), start, end).select(*_LINK_COLUMNS.split(", "))


@query(
    "links_limit_250",
    f"""with {V.NATION_SQL} select source, target, count(*) as n, max(time) as until from (select *, row_number() over (partition by source, target order by time, usd, amount) as place
    from txn where source <> target) where place <= 250 group by 1, 2""",
)
def links_limit_250(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.nation_types(spark, sf_dir).select(F.col("node").alias("id"))
    found = O.links_among(V.txn_nation(spark, sf_dir), ids, limit=O.PAIR_LIMIT)
    return found.groupBy("source", "target").agg(F.count("*").alias("n"), F.max("time").alias("until"))


def top_triangles(transactions: DataFrame) -> DataFrame:
    """The best triangles as matches 0, 1, ...; at most TOP rows are numbered."""
    found = save(P.top_matches_bounded(written_edges(transactions), P.TRIANGLE, TOP), "top_triangles")
    return found.withColumn("match", (F.row_number().over(W.orderBy(F.desc("score"), "n_0", "n_1", "n_2")) - 1).cast("long"))


#: The links among ``matches(match, n_0, n_1, n_2)``.
_LINKS_SQL = """members as (select match, 0 as role, n_0 as node from matches union all select match, 1, n_1 from matches union all select match, 2, n_2 from matches),
  links as (select s.match, s.role as role_s, t.role as role_t, txn.* from txn join members s on s.node = source join members t on t.node = target and t.match = s.match)"""
_MATCHES_SQL = f"""{V.EVENT_SQL}, {V.GRAPH_SQL}, {V.SYM_SQL},
  matches as (select row_number() over (order by score desc, n_0, n_1, n_2) - 1 as match, n_0, n_1, n_2, score from ({top_sql(P.TRIANGLE, TOP)})),
  {_LINKS_SQL}"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the best triangles, written: few rows, which later steps read several times."""
    transactions = V.txn_event(spark, sf_dir)
    return save(O.match_links(transactions, top_triangles(transactions)), "links")


@query("match_links", f"with {_MATCHES_SQL} select match, role_s, role_t, transid, source, target, time, usd from links")
def match_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("match", "role_s", "role_t", "transid", "source", "target", "time", "usd")


_AGGREGATE = """count(*) as num_edges, round(sum(case when role_s < role_t then usd else 0 end), 4) as out_flow,
    round(sum(case when role_s > role_t then usd else 0 end), 4) as in_flow, round(sum(case when role_s < role_t then usd else -usd end), 4) as net_flow"""


@query("aggregate_links", f"with {_MATCHES_SQL} select match, least(role_s, role_t) as role_a, greatest(role_s, role_t) as role_b, {_AGGREGATE} from links group by 1, 2, 3")
def aggregate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.aggregate_links(_links(spark, sf_dir))
    return found.select("match", "role_a", "role_b", "num_edges", *[F.round(c, 4).alias(c) for c in ("out_flow", "in_flow", "net_flow")])


def _flow_sql(i: int, j: int) -> str:
    return f"coalesce(sum(case when role_s = {i} and role_t = {j} then usd when role_s = {j} and role_t = {i} then -usd end), 0) as flow_{i}_{j}"


_BUCKETS_SQL = f"""numbered as (select *, epoch_us(time) // 1000 as ms, (row_number() over (partition by match order by time, role_s, role_t, usd) - 1) // 2 as bucket from links),
  buckets as (select match, bucket, min(ms) as first, max(ms) as last, count(*) as n, {_flow_sql(0, 1)}, {_flow_sql(0, 2)}, {_flow_sql(1, 2)} from numbered group by 1, 2),
  observed as (select match, bucket, n, case when last > first then 1.0 else 0.0 end as f0,
    (first - coalesce(lag(first) over (partition by match order by bucket), first)) / (case when last > first then last - first else 1 end) as f1, flow_0_1, flow_0_2, flow_1_2 from buckets)"""
_OBSERVED_SQL, _OBSERVED = f"{_MATCHES_SQL}, {_BUCKETS_SQL}", OBSERVED


@query("observation_vectors", f"with {_OBSERVED_SQL} select match, bucket, n, " + ", ".join(f"round({c} + {OFF_TIES}, 5) as {c}" for c in _OBSERVED) + " from observed")
def observation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(O.observations(_links(spark, sf_dir), 3), 5)


@query(
    "kde_loglik",
    f"""with {_OBSERVED_SQL}, scaled as (select match, bucket, f0, flow_0_1 / 100 as x, flow_0_2 / 100 as y, flow_1_2 / 100 as z from observed),
    c as (select * from scaled where match = 0)
    select s.match, s.bucket, round(ln(greatest(sum(exp(-0.5 * ((s.f0 - c.f0) ** 2 + (s.x - c.x) ** 2 + (s.y - c.y) ** 2 + (s.z - c.z) ** 2) / 0.5625))
      / pow(count(*) * 2 * 0.5625 * pi(), 2), 1e-18)) + {OFF_TIES}, 6) as log_likelihood from scaled s cross join c group by 1, 2""",
)
def kde_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.observations(_links(spark, sf_dir), 3)
    scaled = found.select("match", "bucket", "f0", *[(F.col(c) / 100).alias(c) for c in _OBSERVED[2:]])
    dense = O.kernel_density(scaled, scaled.filter("match = 0"), ["f0", *_OBSERVED[2:]], 0.75)
    return dense.select("match", "bucket", F.round(F.log("likelihood") + OFF_TIES, 6).alias("log_likelihood"))


_DECODED_SQL = f"with recursive {_OBSERVED_SQL}, {decoded_sql()}"


@query("hmm_rescore", f"{_DECODED_SQL} select match, round(score + {OFF_TIES}, 6) as score, start, array_to_string(states, ',') as states from rescored")
def hmm_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best triangle as the query, the others against it."""
    found = _round(R.rescore(O.observations(_links(spark, sf_dir), 3), 0))
    return found.withColumn("states", F.array_join(F.col("states").cast("array<string>"), ","))


def top_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    found = R.phase_links(links, R.rescore(O.observations(links, 3), 0))
    return found.withColumns({c: F.round(c, 4) for c in ("out_flow", "in_flow", "net_flow")})


@query("phase_links", f"{_DECODED_SQL}, {PHASES} select match, phase, least(role_s, role_t) as role_a, greatest(role_s, role_t) as role_b, {_AGGREGATE} from phased group by 1, 2, 3, 4")
def phase_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phases(spark, sf_dir)


@query(
    "normalized_observations",
    f"{_DECODED_SQL} select match, t as place, unnest(range({len(OBSERVED)})) as slot, round(unnest(v) + {OFF_TIES}, 5) as value from seq",
)
def normalized_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches' observations on a common scale, number by number."""
    found = R.normalized_observations(O.observations(_links(spark, sf_dir), 3))
    each = found.select("match", F.posexplode("vectors").alias("place", "v")).select("match", F.col("place").cast("long").alias("place"), F.posexplode("v").alias("slot", "value"))
    return each.select("match", "place", F.col("slot").cast("long").alias("slot"), F.round(F.col("value") + OFF_TIES, 5).alias("value"))


def _match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    transactions = V.txn_event(spark, sf_dir)
    links = save(O.match_links(transactions, top_triangles(transactions)), "links")
    return O.transaction_features(I.deviations(transactions, links))


@query(
    "transaction_features",
    f"""with {_MATCHES_SQL}, w as (select match, transid, amount, epoch_ms(time) as ms, lag(epoch_ms(time)) over o as ms0, lag(amount) over o as amount0,
      max(epoch_ms(time)) over (partition by match) - min(epoch_ms(time)) over (partition by match) as span
      from links window o as (partition by match order by time, role_s, role_t, usd))
    select match, transid, round((ms - coalesce(ms0, ms)) / span + {OFF_TIES}, 6) as gap,
    round(coalesce(case when coalesce(amount0, amount) <> 0 then amount / coalesce(amount0, amount) end, 0) + {OFF_TIES}, 6) as ratio from w""",
)
def transaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_match_features(spark, sf_dir).select("match", "transid", "gap", "ratio"))


_DEVIATIONS = ["devpop", "creditdev", "debitdev", "gap", "ratio"]
_POINTS_SQL = f"""{_MATCHES_SQL}, {_AVERAGES_SQL}, mean as (select avg(usd) as m from txn),
  w as (select links.*, epoch_ms(time) as ms, lag(epoch_ms(time)) over o as ms0, lag(amount) over o as amount0,
    max(epoch_ms(time)) over (partition by match) - min(epoch_ms(time)) over (partition by match) as span
    from links window o as (partition by match order by time, role_s, role_t, usd)),
  points as (select match, ms, (usd - m) / m as devpop, case when c.avg_credit = 0 then -1 else (usd - c.avg_credit) / c.avg_credit end as creditdev,
    case when d.avg_debit = 0 then -1 else (usd - d.avg_debit) / d.avg_debit end as debitdev,
    coalesce(case when span <> 0 then (ms - coalesce(ms0, ms)) / span end, 0) as gap,
    coalesce(case when coalesce(amount0, amount) <> 0 then amount / coalesce(amount0, amount) end, 0) as ratio
    from w cross join mean join averages c on c."user" = source join averages d on d."user" = target)"""
_SESSION_GAP = 3 * 24 * 3600 * 1000


@query(
    "session_hmm_score",
    f"with recursive {_POINTS_SQL}, {session_sql(_DEVIATIONS, _SESSION_GAP, 1.0)} select match, round(log_probability + {OFF_TIES}, 5) as log_probability from scored",
)
def session_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.session_scores(_match_features(spark, sf_dir), 0, _DEVIATIONS, _SESSION_GAP, 1.0), 5)


@query(
    "session_split",
    f"""with {V.EVENT_SQL}, d as (select *, case when epoch_ms(time) - lag(epoch_ms(time)) over (partition by source order by time, transid) > 21600000 then 1 else 0 end as new from txn)
    select source, transid, cast(sum(new) over (partition by source order by time, transid) as bigint) as session from d""",
)
def session_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sessions(V.txn_event(spark, sf_dir), 6 * 3600 * 1000).select("source", "transid", "session")


@query(
    "flow_aggregation",
    f"""with {V.EVENT_SQL}, flat as (select source as entity, target as counterpart, 'out' as direction, usd, time from txn union all select target, source, 'in', usd, time from txn)
    select entity, counterpart, direction, count(*) as n, round(sum(usd), 4) as usd from flat where time between timestamp '{START}' and timestamp '{END}' group by 1, 2, 3""",
)
def flow_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = V.txn_event(spark, sf_dir)
    everyone = txn.select(F.col("source").alias("entity"))
    start, end = F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp")
    found = O.flow_aggregation(txn, everyone.union(txn.select("target")), None, "both", start, end)
    return found.withColumn("usd", F.round("usd", 4))


@query(
    "time_series_aggregation",
    f"""with {V.EVENT_SQL}, flat as (select source as entity, -usd as v, time from txn union all select target, usd, time from txn),
    bins as (select entity, datediff('day', date '2024-01-01', cast(time as date)) // 7 as bin, sum(case when v > 0 then v else 0 end) as incoming,
      sum(case when v < 0 then -v else 0 end) as outgoing from flat group by 1, 2)
    select e.entity, cast(b.bin as integer) as bin, round(coalesce(incoming, 0), 4) as incoming, round(coalesce(outgoing, 0), 4) as outgoing,
    round(coalesce(incoming, 0) - coalesce(outgoing, 0), 4) as net
    from (select distinct entity from flat) e cross join range(4) b(bin) left join bins on bins.entity = e.entity and bins.bin = b.bin""",
)
def time_series_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = V.txn_event(spark, sf_dir)
    everyone = txn.select(F.col("source").alias("entity")).union(txn.select("target"))
    found = O.time_series(txn, everyone, "2024-01-01", 4, 7)
    return found.select("entity", "bin", *[F.round(c, 4).alias(c) for c in ("incoming", "outgoing", "net")])


@query(
    "one_hop_links",
    f"""with {V.EVENT_SQL} select {_LINK_COLUMNS} from txn where (source between 1 and 20 or target between 1 and 20) and time between timestamp '{START}' and timestamp '{END}'""",
)
def one_hop_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp")
    return O.one_hop(V.txn_event(spark, sf_dir), _ids(spark), start, end).select(*_LINK_COLUMNS.split(", "))


@query(
    "data_summary",
    f"""with {V.EVENT_SQL}, s as (select cast((select count(distinct n) from (select source as n from txn union all select target from txn)) as varchar) as entities,
    cast(count(*) as varchar) as links, cast(count(distinct least(source, target) * 10000000 + greatest(source, target)) as varchar) as pairs,
    cast(cast(round(sum(usd), 2) as decimal(20, 2)) as varchar) as usd, cast(cast(min(time) as date) as varchar) as first, cast(cast(max(time) as date) as varchar) as last from txn)
    select unnest(['entities', 'links', 'pairs', 'usd', 'first', 'last']) as key, unnest([entities, links, pairs, usd, first, last]) as value from s""",
)
def data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.data_summary(V.txn_event(spark, sf_dir))


@query(
    "entity_accounts",
    f"""with {V.TRADE_SQL}, flat as (select source as entity, target as other, -usd as v, time from txn union all select target, source, usd, time from txn)
    select entity, count(*) as n, count(distinct other) as counterparts, round(sum(case when v > 0 then v else 0 end) + {OFF_TIES}, 2) as incoming,
    round(sum(case when v < 0 then -v else 0 end) + {OFF_TIES}, 2) as outgoing, cast(min(time) as date) as first, cast(max(time) as date) as last from flat group by 1""",
)
def entity_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = V.txn_trade(spark, sf_dir)
    everyone = txn.select(F.col("source").alias("entity")).union(txn.select("target"))
    return _round(O.accounts(txn, everyone), 2)


#: A discrete model of a user's day: calm and busy, each with its probabilities of the event types in this order.
_SYMBOLS = ("click", "error", "purchase", "signup", "view")
_MOVES = [[0.0, 0.6, 0.4, 0.0], [0.0, 0.7, 0.25, 0.05], [0.0, 0.35, 0.6, 0.05], [0.0, 0.0, 0.0, 1.0]]
_EMITS = [[0.2, 0.05, 0.05, 0.1, 0.6], [0.35, 0.15, 0.25, 0.1, 0.15]]


def _days_sql() -> str:
    emits = ", ".join(f"({s + 1}, '{x}', {p}e0)" for s, ps in enumerate(_EMITS) for x, p in zip(_SYMBOLS, ps, strict=True))
    moves = ", ".join(f"({i}, {j}, {p}e0)" for i, row in enumerate(_MOVES) for j, p in enumerate(row) if p)
    return f"""with recursive emit(s, x, p) as (values {emits}), move(i, j, p) as (values {moves}),
  seq as (select user_id as "user", cast(ts as date) as day, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as t, event_type as x from events),
  vit("user", day, t, s, score, probability, states) as (
    select "user", day, t, emit.s, ln(move.p) + ln(emit.p), move.p * emit.p, [emit.s] from seq join emit on emit.x = seq.x join move on i = 0 and j = emit.s where t = 0
    union all
    select "user", day, t, s, score, probability, states from (
      select v."user", v.day, seq.t, emit.s, v.score + ln(move.p) + ln(emit.p) as score, v.probability * move.p * emit.p as probability, list_append(v.states, emit.s) as states,
        row_number() over (partition by v."user", v.day, emit.s order by round(v.score + ln(move.p), 12) desc, v.s) as place
      from vit v join seq on seq."user" = v."user" and seq.day = v.day and seq.t = v.t + 1 join emit on emit.x = seq.x join move on i = v.s and j = emit.s) where place = 1),
  ends as (select "user", day, max(t) as t from seq group by 1, 2),
  last as (select v.*, v.score + ln(move.p) as total, v.probability * move.p as whole,
    row_number() over (partition by v."user", v.day order by round(v.score + ln(move.p), 12) desc, v.s) as place from vit v join ends using ("user", day, t) join move on i = v.s and j = 3)
  select "user", day, array_to_string(states, '') as states, round(total + {OFF_TIES}, 6) as score, round(whole * 1e6 + {OFF_TIES}, 5) as per_million from last where place = 1"""


@query("day_states", _days_sql())
def day_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's days, decoded event by event under the discrete model, with the path's probability in millionths."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    symbol = F.array_position(F.array(*[F.lit(x) for x in _SYMBOLS]), F.col("event_type")) - 1
    days = events.groupBy("user", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", symbol.alias("x")))).alias("o"))
    found = R.decoded_symbols(days.select("user", "day", F.col("o.x").alias("symbols")), _MOVES, _EMITS)
    return found.select(
        "user", "day", F.array_join(F.transform("states", lambda x: x.cast("string")), "").alias("states"), F.round(F.col("score") + OFF_TIES, 6).alias("score"),
        F.round(F.col("probability") * 1e6 + OFF_TIES, 5).alias("per_million"),
    )
