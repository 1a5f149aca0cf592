"""Queries for ingest, activity and user features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import features as X
from ..operators import ingest as I
from ..operators import spectrum as S
from . import views as V
from .registry import ORACLES, query, table

#: Added before rounding, in queries and oracles alike: a mean that ends in ...5 may differ in its last bit between engines.
OFF_TIES = 1e-8

_RATES_SQL = f"""rates as (select cast(o_orderdate as date) as day, round(avg(o_totalprice) / 100000 + {OFF_TIES}, 6) as rate from orders
  where extract(day from o_orderdate) <= 20 group by 1)"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for the first 20 days of each month, so that interior days are missing."""
    orders = table(spark, sf_dir, "orders").filter(F.dayofmonth("o_orderdate") <= 20)
    return orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice") / 100000 + OFF_TIES, 6).alias("rate"))


@query(
    "fx_convert",
    f"""with {_RATES_SQL}, ends as (select min(day) as lo, max(day) as hi, arg_min(rate, day) as lo_rate, arg_max(rate, day) as hi_rate from rates),
    days as (select cast(l_shipdate as date) as day, count(*) as n, sum(l_quantity) as amount from lineitem group by 1)
    select d.day, n, amount, coalesce(rate, case when d.day < lo then lo_rate when d.day > hi then hi_rate end, 0.0) as rate,
    round(amount * coalesce(rate, case when d.day < lo then lo_rate when d.day > hi then hi_rate end, 0.0) + {OFF_TIES}, 4) as usd
    from days d cross join ends left join rates r on r.day = d.day""",
)
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("amount"))
    priced = I.with_rate(lines, _rates(spark, sf_dir))
    return priced.groupBy("day", "rate").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).withColumn("usd", F.round(F.col("amount") * F.col("rate") + OFF_TIES, 4))


_AVERAGES_SQL = """sides as (select source as "user", usd as debit, cast(null as double) as credit from txn union all select target, null, usd from txn),
  averages as (select "user", coalesce(avg(debit), 0) as avg_debit, coalesce(avg(credit), 0) as avg_credit from sides group by 1)"""


@query("user_credit_debit_avg", f'with {V.TRADE_SQL}, {_AVERAGES_SQL} select "user", round(avg_debit + {OFF_TIES}, 4) as avg_debit, round(avg_credit + {OFF_TIES}, 4) as avg_credit from averages')
def user_credit_debit_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(I.user_averages(V.txn_trade(spark, sf_dir)), 4)


@query(
    "txn_deviation",
    f"""with {V.EVENT_SQL}, {_AVERAGES_SQL}, mean as (select avg(usd) as m from txn)
    select transid, round((usd - m) / m + {OFF_TIES}, 6) as devpop,
    round(case when c.avg_credit = 0 then -1 else (usd - c.avg_credit) / c.avg_credit end + {OFF_TIES}, 6) as creditdev,
    round(case when d.avg_debit = 0 then -1 else (usd - d.avg_debit) / d.avg_debit end + {OFF_TIES}, 6) as debitdev
    from txn cross join mean join averages c on c."user" = source join averages d on d."user" = target""",
)
def txn_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(I.deviations(V.txn_event(spark, sf_dir)).select("transid", "devpop", "creditdev", "debitdev"))


#: Transactions of an active user (the event table has about 130 a user at every scale), and the limits of the
#: fixpoints: for counts that a distinct union collapses, and for all.
ACTIVE, UNION_LIMIT, BAG_LIMIT = 120, 52, 100

_WHOLE_SQL = f"{V.EVENT_SQL}, t0 as (select transid, source, target from txn)"


def _inactive_sql(t: str, least: int, union: str) -> str:
    return f"""(select "user" from (select source as "user", count(*) as n from {t} group by 1 {union} select target, count(*) from {t} group by 1) group by 1 having sum(n) < {least})"""


@query(
    "active_users_bag",
    f"""with {_WHOLE_SQL} select "user", cast(sum(n) as bigint) as n from (select source as "user", count(*) as n from t0 where source <> 25 group by 1
    union all select target, count(*) from t0 where target <> 25 group by 1) group by 1 having sum(n) >= {ACTIVE}""",
)
def active_users_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.active_users(V.txn_event(spark, sf_dir), ACTIVE)


@query("inactive_users_union", f"with {_WHOLE_SQL} select * from {_inactive_sql('t0', UNION_LIMIT, 'union')}")
def inactive_users_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.inactive_users(V.txn_event(spark, sf_dir), UNION_LIMIT).select("user")


@query("inactive_users_union_60", f"with {V.EVENT_SQL} select * from {_inactive_sql('txn', 60, 'union')}")
def inactive_users_union_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.inactive_users(V.txn_event(spark, sf_dir), 60).select("user")


def _rounds_sql(first: str, least: int, union: str, rounds: int) -> str:
    """Enough unrolled rounds for the fixpoint at the oracle's scale."""
    steps = [
        f"t{i + 1} as (select * from t{i} where source not in {_inactive_sql(f't{i}', least, union)} and target not in {_inactive_sql(f't{i}', least, union)})"
        for i in range(rounds)
    ]
    return f"with {first}, " + ", ".join(steps)


@query("activity_fixpoint", _rounds_sql(_WHOLE_SQL, UNION_LIMIT, "union", 9) + " select transid, source, target from t9")
def activity_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activity_fixpoint(V.txn_event(spark, sf_dir), UNION_LIMIT).select("transid", "source", "target")


@query("activity_fixpoint_bag", _rounds_sql(_WHOLE_SQL, BAG_LIMIT, "union all", 9) + " select transid, source, target from t9")
def activity_fixpoint_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activity_fixpoint(V.txn_event(spark, sf_dir), BAG_LIMIT, "bag").select("transid", "source", "target")


@query(
    "busy_users",
    f"""with {V.EVENT_SQL}, d as (select source as "user", count(*) as debits from txn group by 1), c as (select target as "user", count(*) as credits from txn group by 1)
    select coalesce(d."user", c."user") as "user", coalesce(debits, 0) as debits, coalesce(credits, 0) as credits from d full join c on d."user" = c."user"
    where debits > 5 or credits > 5""",
)
def busy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.busy_users(V.txn_event(spark, sf_dir))


@query(
    "user_transaction_counts",
    f"""with {V.TRADE_SQL} select source as "user", count(*) as n from txn group by 1 having count(*) > 5
    union select target, count(*) from txn group by 1 having count(*) > 5""",
)
def user_transaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counts_over(V.txn_trade(spark, sf_dir))


@query(
    "active_user_pairs",
    f"""with {_WHOLE_SQL}, active as (select "user" from (select source as "user", count(*) as n from t0 where source <> 25 group by 1
    union all select target, count(*) from t0 where target <> 25 group by 1) group by 1 having sum(n) >= {ACTIVE})
    select distinct source, target from t0 where source in (select * from active) and target in (select * from active)""",
)
def active_user_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = V.txn_event(spark, sf_dir)
    return A.between_users(txn.select("source", "target").distinct(), A.active_users(txn, ACTIVE))


_SIDES_SQL = """sides as (
  select target as "user", source as other, 'credit' as side, amount as value, cast(time as date) as day, time, amount, target from txn
  union all select source, target, 'debit', -amount, cast(time as date), time, amount, target from txn)"""
_GAPS_SQL = """gaps as (select *, datediff('day', lag(day) over (partition by "user", side order by time, amount, target), day) as gap from sides)"""
_PERPLEXITY_SQL = """shares as (select "user", side, n / sum(n) over (partition by "user", side) as p
    from (select "user", side, other, count(*) as n from sides group by 1, 2, 3)),
  perplexity as (select "user", pow(2, -coalesce(sum(case when side = 'credit' then p * log2(p) end), 0)) as perp_in,
    pow(2, -coalesce(sum(case when side = 'debit' then p * log2(p) end), 0)) as perp_out from shares group by 1)"""


def _moments_sql(side: str, value: str, name: str) -> str:
    own = f"case when side = '{side}' then {value} end"
    return f"coalesce(avg({own}), 0) as {name}_mean, coalesce(stddev_samp({own}), 0) as {name}_std"


_AMOUNTS_SQL = f"""amounts as (select "user", {_moments_sql("credit", "value", "credit")}, {_moments_sql("debit", "value", "debit")} from sides group by 1)"""
_ARRIVALS_SQL = f"""arrivals as (select "user", {_moments_sql("credit", "gap", "credit_interarr")}, {_moments_sql("debit", "gap", "debit_interarr")} from gaps group by 1)"""
_FEATURES_SQL = f"""{V.EVENT_SQL}, {_SIDES_SQL}, {_GAPS_SQL}, {_AMOUNTS_SQL}, {_ARRIVALS_SQL}, {_PERPLEXITY_SQL},
  features as (select amounts."user", {", ".join(X.FEATURES)} from amounts join arrivals on arrivals."user" = amounts."user" join perplexity on perplexity."user" = amounts."user")"""


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c) + OFF_TIES, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _round_sql(columns: tuple[str, ...], digits: int = 6) -> str:
    return ", ".join(f"round({c} + {OFF_TIES}, {digits}) as {c}" for c in columns)


@query("credit_debit_stats", f'with {V.EVENT_SQL}, {_SIDES_SQL}, {_AMOUNTS_SQL} select "user", {_round_sql(("credit_mean", "credit_std", "debit_mean", "debit_std"))} from amounts')
def credit_debit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.amount_stats(V.txn_event(spark, sf_dir)))


_ARRIVAL_COLUMNS = ("credit_interarr_mean", "credit_interarr_std", "debit_interarr_mean", "debit_interarr_std")


@query("interarrival_stats", f'with {V.EVENT_SQL}, {_SIDES_SQL}, {_GAPS_SQL}, {_ARRIVALS_SQL} select "user", {_round_sql(_ARRIVAL_COLUMNS)} from arrivals')
def interarrival_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.interarrival_stats(V.txn_event(spark, sf_dir)))


@query("perplexity", f'with {V.EVENT_SQL}, {_SIDES_SQL}, {_PERPLEXITY_SQL} select "user", {_round_sql(("perp_in", "perp_out"))} from perplexity')
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.perplexities(V.txn_event(spark, sf_dir)))


@query("user_features_raw", f'with {_FEATURES_SQL} select "user", {_round_sql(X.FEATURES)} from features')
def user_features_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.user_features(V.txn_event(spark, sf_dir)))


_LOGS = ", ".join(f"ln({c}) as {c}" if c.startswith("perp") else f"ln(1 + abs({c})) as {c}" for c in X.FEATURES)
_LOGS_SQL = f'{_FEATURES_SQL}, logs as (select "user", {_LOGS} from features)'


@query("feature_log_transform", f'with {_LOGS_SQL} select "user", {_round_sql(X.FEATURES)} from logs')
def feature_log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.log_transform(X.user_features(V.txn_event(spark, sf_dir))))


def _normal_sql(zeros: bool) -> str:
    own = (lambda c: f"case when {c} <> 0 then {c} end") if zeros else (lambda c: c)
    ends = ", ".join(f"quantile_cont({own(c)}, 0.025) as lo_{c}, quantile_cont({own(c)}, 0.975) as hi_{c}" for c in X.FEATURES)
    scaled = lambda c: f"coalesce(case when hi_{c} <> lo_{c} then ({c} - (lo_{c} + hi_{c}) / 2) / ((hi_{c} - lo_{c}) / 4) end, 0)"
    columns = ", ".join(f"round({f'case when {c} = 0 then 0 else {scaled(c)} end' if zeros else scaled(c)} + {OFF_TIES}, 5) as {c}" for c in X.FEATURES)
    return f'with {_LOGS_SQL}, ends as (select {ends} from logs) select "user", {columns} from logs cross join ends'


@query("percentile_normalize", _normal_sql(False))
def percentile_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.normalized(X.log_transform(X.user_features(V.txn_event(spark, sf_dir)))), 5)


@query("percentile_normalize_nonzero", _normal_sql(True))
def percentile_normalize_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.normalized(X.log_transform(X.user_features(V.txn_event(spark, sf_dir))), ignore_zeros=True), 5)


@query(
    "outlier_cleanup",
    f"""with {_LOGS_SQL} select "user", {", ".join(f"round(greatest(-4, least(4, case when {c} = 0 then 0.001 else {c} end)) + {OFF_TIES}, 6) as {c}" for c in X.FEATURES)} from logs""",
)
def outlier_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.clean_outliers(X.log_transform(X.user_features(V.txn_event(spark, sf_dir))), X.FEATURES))


@query(
    "feature_summary",
    f"with {_FEATURES_SQL} "
    + " union all ".join(f"select '{c}' as feature, round(avg({c}) + {OFF_TIES}, 5) as mean, round(coalesce(stddev_samp({c}), 0) + {OFF_TIES}, 5) as std from features" for c in X.FEATURES),
)
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.feature_summary(X.user_features(V.txn_event(spark, sf_dir))), 5)


@query(
    "daily_series",
    f"""with {V.EVENT_SQL}, {_SIDES_SQL}, days as (select "user", day, sum(case when side = 'credit' then value end) as credit,
    sum(case when side = 'debit' then value end) as debit, sum(value) as total from sides group by 1, 2),
    spans as (select "user", min(day) as lo, max(day) as hi from days group by 1),
    every as (select "user", cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from spans)
    select every."user", every.day, round(coalesce(credit, 0) + {OFF_TIES}, 4) as credit, round(coalesce(debit, 0) + {OFF_TIES}, 4) as debit, round(coalesce(total, 0) + {OFF_TIES}, 4) as total
    from every left join days on days."user" = every."user" and days.day = every.day""",
)
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.daily_series(V.txn_event(spark, sf_dir)), 4)


_HALF = S.LENGTH // 2


@query(
    "spectra",
    f"""with {V.EVENT_SQL}, {_SIDES_SQL}, days as (select "user", day, sum(value) as total from sides group by 1, 2),
    placed as (select "user", total, datediff('day', min(day) over (partition by "user"), day) as t, datediff('day', min(day) over (partition by "user"), max(day) over (partition by "user")) // {_HALF} as last from days),
    waves as (select "user", f, last + 1 as n, sum(total * cos(2 * pi() * f * (t - last * {_HALF}) / {S.LENGTH})) as re from placed, range(1, {_HALF}) w(f) where t >= last * {_HALF} group by all)
    select "user", f as bin, round(abs(re) / n + {OFF_TIES}, 4) as power from waves union all select distinct "user", {_HALF}, 0.0 from placed""",
)
def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of every bin from 1 on."""
    found = S.spectra(X.daily_series(V.txn_event(spark, sf_dir))).select("user", F.posexplode("spectrum").alias("bin", "power"))
    return found.select("user", (F.col("bin") + 1).cast("long").alias("bin"), F.round(F.col("power") + OFF_TIES, 4).alias("power"))


@query("clustered_types")
def clustered_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in four types by their normalised features."""
    found = X.normalized(X.log_transform(X.user_features(V.txn_event(spark, sf_dir))))
    return X.clustered_types(found, 4).select("user", "type")


@query("user_table", f'with {_FEATURES_SQL} select "user", 1 as type, {_round_sql(X.FEATURES)} from features')
def user_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.user_table(X.user_features(V.txn_event(spark, sf_dir))))
