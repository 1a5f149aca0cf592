"""DuckDB SQL for what hidden Markov models do to observation sequences: decoding, phases, session scores.

All build on tables named ``observed`` (match, bucket, OBSERVED columns),
``numbered`` (the links with their bucket) and ``links``.
"""

from __future__ import annotations

#: Observation columns of matches of three roles.
OBSERVED = ("f0", "f1", "flow_0_1", "flow_0_2", "flow_1_2")


def decoded_sql(bandwidth: float = 0.75, scale: float = 0.1) -> str:
    """Tables up to ``rescored(match, score, start, states)``; needs ``with recursive``.

    A chain of states, one for each of match 0's observations; a state stays
    or moves on with 1/2 each. A sub-sequence begins in the first state, at no
    cost and so better than any that stays there, and ends in the last.
    """
    ends = ", ".join(f"quantile_cont({c}, 0.025) as lo_{c}, quantile_cont({c}, 0.975) as hi_{c}" for c in OBSERVED)
    scaled = ", ".join(f"coalesce(case when hi_{c} <> lo_{c} then ({c} - (lo_{c} + hi_{c}) / 2) / ((hi_{c} - lo_{c}) / 4) end, 0.0)" for c in OBSERVED)
    return f"""ends as (select {ends} from observed),
  seq as (select match, row_number() over (partition by match order by bucket) - 1 as t, [{scaled}] as v from observed cross join ends),
  em as (select seq.match, seq.t, c.t + 1 as s, ln(greatest(exp(-0.5 * list_distance(seq.v, c.v) ** 2 / {bandwidth**2}) / pow(2 * {bandwidth**2} * pi(), {len(OBSERVED) / 2}), 1e-18)) as e
    from seq join (select * from seq where match = 0) c on true),
  vit(match, t, s, score, began, states) as (
    select match, t, s, e, t, [s] from em where t = 0 and s = 1
    union all
    select match, t, s, score, began, states from (
      select em.match, em.t, em.s, case when em.s = 1 then e else p.score + ln(0.5) + e end as score, case when em.s = 1 then em.t else p.began end as began,
        case when em.s = 1 then [em.s] else list_append(p.states, em.s) end as states,
        row_number() over (partition by em.match, em.s order by p.score desc, p.s) as place
      from vit p join em on em.match = p.match and em.t = p.t + 1 and (em.s = p.s or em.s = p.s + 1)) where place = 1),
  found as (select match, score + ln(0.5) as score, began, states from vit where s = (select count(*) from seq where match = 0)
    qualify row_number() over (partition by match order by score desc, t) = 1),
  rescored as (select match, 1 / (1 + {scale} * abs(score - (select score from found where match = 0))) as score, cast(began as integer) as start, cast(states as integer[]) as states from found)"""


#: Tables up to ``phased``: the links with the phase that their bucket is in.
PHASES = """marked as (select match, start + i - 1 as bucket, states[i] as state from (select *, unnest(range(1, len(states) + 1)) as i from rescored)),
  turns as (select match, bucket, case when state <> lag(state) over (partition by match order by bucket) then 1 else 0 end as turn from marked),
  phases as (select match, bucket, cast(sum(turn) over (partition by match order by bucket) as integer) as phase from turns),
  phased as (select numbered.*, phase from numbered join phases on phases.match = numbered.match and phases.bucket = numbered.bucket)"""


def session_sql(columns: list[str], gap_ms: int, bandwidth: float) -> str:
    """Tables up to ``scored(match, log_probability)``, from ``points(match, ms, columns)``; needs ``with recursive``.

    The forward algorithm over the states of match 0's sessions and an end state.
    """
    d = len(columns)
    order = ", ".join(["ms", *columns])
    return f"""pts as (select match, row_number() over (partition by match order by {order}) - 1 as t, ms, [{", ".join(columns)}] as v from points),
  cut as (select t, v, case when ms - lag(ms) over (order by t) > {gap_ms} then 1 else 0 end as new from pts where match = 0),
  cen as (select v, cast(sum(new) over (order by t) as bigint) as s from cut),
  size as (select s, count(*) as n from cen group by 1),
  m as (select count(*) as m, sum(n) as total from size),
  tr as (
    select s, s as s2, n / total as p from size, m
    union all select s, s + 1, case when s < m - 1 then 1 - n / total - 1e-15 else 1 - n / total end from size, m
    union all select s, m, 1e-15 from size, m where s < m - 1
    union all select m, m, 1.0 from m),
  seen as (select match, t, v from pts union all select match, max(t) + 1, cast(null as double[]) from pts group by 1),
  em as (
    select match, t, s, case when x.v is null then 1e-18 else greatest(x.p / pow(n * 2 * {bandwidth**2} * pi(), {d / 2}), 1e-18) end as e from (
      select match, t, seen.v, cen.s, sum(exp(-0.5 * list_distance(seen.v, cen.v) ** 2 / {bandwidth**2})) as p from seen, cen group by all) x join size using (s)
    union all select match, t, m, case when v is null then 1 / pow(2 * 1e6 * pi(), {d / 2}) else 1e-18 end from seen, m),
  fwd(match, t, s, f, total) as (
    select match, t, s, f / norm, ln(norm) from (
      select match, t, em.s, e * case when em.s = m then 0 when em.s = 0 then 0.9 else 0.1 / m end as f,
        sum(e * case when em.s = m then 0 when em.s = 0 then 0.9 else 0.1 / m end) over (partition by match) as norm from em, m where t = 0)
    union all
    select match, t, s, f / norm, total + ln(norm) from (
      select *, sum(f) over (partition by match) as norm from (
        select distinct on (em.match, em.s) em.match, em.t, em.s, e * sum(fwd.f * tr.p) over (partition by em.match, em.s) as f, fwd.total
        from fwd join tr on tr.s = fwd.s join em on em.match = fwd.match and em.t = fwd.t + 1 and em.s = tr.s2))),
  scored as (select match, max_by(total, t) as log_probability from fwd group by 1)"""
