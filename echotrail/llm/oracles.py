"""DuckDB SQL for the corpus operators that SQL can express, from their definitions."""

from __future__ import annotations

from . import media as media_op
from .rules import GAMMA, MIX, REACH, RULES, SKETCHED, STRETCH_BUCKETS, THIN, UNIT

#: Exact all-pairs similarity by shared shingles, and reachability over the links.
NEAR_DEDUP = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 75 * (x.n + y.n - m)),
reach(node, other) as (select doc_id, doc_id from documents union select node, b from reach join e on a = other)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other) as component_id, min(other) = d.doc_id as kept
from documents d join reach on node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""

#: Bytes as pairs of hexadecimal digits; every 100-byte string, in order of its start.
REPEATS = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 200) as s from (select doc_id, h, unnest(range(n - 99)) as i from t where n >= 100)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from w) where k > 1),
j as (select doc_id, i, i + 100 as e, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as fresh from r),
g as (select *, sum(fresh) over (partition by doc_id order by i) as span from j),
spans as (select doc_id, span, min(i) as a, max(e) as b from g group by 1, 2),
gaps as (select doc_id, b as a, lead(a) over (partition by doc_id order by a, b) as b from (select doc_id, a, b from spans union all select doc_id, 0, 0 from t)),
kept as (
  select t.doc_id, string_agg(substr(h, cast(2 * g.a + 1 as bigint), cast(2 * (coalesce(g.b, n) - g.a) as bigint)), '' order by g.a) as k
  from t join gaps g on g.doc_id = t.doc_id group by 1)
select t.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(sum(b - a), 0) as bigint) as n_removed, count(a) as n_spans, sha256(unhex(any_value(k))) as kept_sha256
from t join kept on kept.doc_id = t.doc_id left join spans on spans.doc_id = t.doc_id group by t.doc_id, n
"""


def quality_rules(off_ties: float) -> str:
    """The counts by regular expressions and windows, and the cutoffs from the same logarithmic buckets."""
    ratios = ", ".join(f"coalesce(case when {r.split('/')[1]} <> 0 then {r} end, 0.0) as {k}" for k, (r, _) in RULES.items())
    ratio = lambda r: f"coalesce(case when {r.split('/')[1]} <> 0 then {r} end, 0.0)"
    flat = " union all ".join(f"select lang, source, '{k}' as rule, {ratio(r)} as x from rows where not base_failed" for k, r in SKETCHED.items())
    fenced = ", ".join(f"'{k}'" for k, (_, unit) in RULES.items() if unit is None)
    value = lambda b: f"case when {b} > -1073741824 then exp({b} * ln({GAMMA})) * (1 + 1e-9) when {b} is not null then 0 end"

    def share(key: str) -> str:
        """A group's part of its language's, or source's, sketch."""
        return f"""select groups.lang, groups.source, groups.rule, bucket, ({MIX * UNIT} * n) // size as weight from groups join
          (select {key}, rule, bucket, sum(n) as n, sum(sum(n)) over (partition by {key}, rule) as size from sketch group by 1, 2, 3) p on p.rule = groups.rule and p.{key} is not distinct from groups.{key}"""

    one = lambda k: f"(select cut from cuts where cuts.lang is not distinct from rows.lang and cuts.source is not distinct from rows.source and rule = '{k}') as {k}_cutoff"
    rounded = ", ".join(f"round({c} + {off_ties}, 6) as {c}" for k in RULES for c in (k, f"{k}_cutoff"))
    within = " and ".join(f"coalesce({k} <= {k}_cutoff, true)" for k in RULES)
    return rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
triples as (select doc_id, i, count(*) over (partition by doc_id, g) as n from (
  select doc_id, i, array_to_string(ws[i:i + 2], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from t where len(ws) >= 3))),
covered as (select doc_id, count(distinct i + k) as n from triples cross join range(3) r(k) where n > 1 group by 1),
base as (select t.doc_id, lang, source, len(ws) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
  from t left join lines on lines.doc_id = t.doc_id left join covered on covered.doc_id = t.doc_id),
rows as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {ratios} from base),
flat as (select *, case when x > 0 then ceil(ln(x) / ln({GAMMA})) else -1073741824 end as bucket from ({flat})),
sketch as (select lang, source, rule, bucket, count(*) as n from flat group by all),
groups as (select distinct lang, source, rule from sketch),
mixed as (select lang, source, rule, bucket, sum(weight) as weight from (select lang, source, rule, bucket, n * {UNIT} as weight from sketch
  union all {share("lang")} union all {share("source")}) group by all),
least as (select lang, source, rule, min(case when 2 * upto >= size then bucket end) as bucket from (select *, sum(weight) over (g order by bucket) as upto, sum(weight) over (g) as size
  from mixed where rule like '%\_unit' escape '\' window g as (partition by lang, source, rule)) group by 1, 2, 3),
floored as (select *, false as floor from mixed where rule not like '%\_unit' escape '\' union all select lang, source, left(rule, length(rule) - 5), bucket, 0, true from least),
ranked as (select *, sum(weight) over (g order by bucket) as upto, coalesce(sum(weight) over (g order by bucket range between 1 following and {STRETCH_BUCKETS} following), 0) as near,
  sum(weight) over (g) as size, min(case when floor then bucket end) over (g) as start from floored window g as (partition by lang, source, rule)),
ends as (select lang, source, rule, min(case when 4 * upto >= size then bucket end) as q1, min(case when 4 * upto >= 3 * size then bucket end) as q3,
  min(case when bucket >= start and 4 * upto >= 3 * size and size - upto - near > 0 and {THIN} * near <= size - upto - near then bucket end) + {STRETCH_BUCKETS} as gap from ranked group by 1, 2, 3),
cuts as (select lang, source, rule, case when rule in ({fenced}) then {value("q3")} + {REACH} * ({value("q3")} - {value("q1")}) else {value("gap")} end as cut from ends),
found as (select *, {", ".join(map(one, RULES))} from rows)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {within} as kept, {rounded} from found
"""


def media(block: int = media_op.BLOCK, rate: int = media_op.RATE) -> str:
    """The WAV file's bytes, and its spectrum by sums of cosines and sines, in plain SQL."""
    half, bins = block // 2, block // 2
    wave = lambda f: f"cast(list_transform(range({block}), lambda j: (0.5 - 0.5 * cos(2 * pi() * j / {block})) * {f}(2 * pi() * k * j / {block})) as double[{block}])"
    le = lambda x, n: "".join(f" || printf('%02x', ({x} >> {8 * i}) & 255)" for i in range(n))[4:]
    header = f"""hex(encode('RIFF')) || {le("(n + 36)", 4)} || hex(encode('WAVEfmt ')) || '1000000001000100' || {le(rate, 4)} || {le(rate, 4)} || '01000800' || hex(encode('data')) || {le("n", 4)}"""
    pairs = " union all ".join(
        f"select doc_id, (t << 20) | (f << 13) | ((lead(f, {k}) over w) << 6) | (lead(t, {k}) over w - t) as code, lead(t, {k}) over w - t as gap from peaks window w as (partition by doc_id order by t)"
        for k in range(1, media_op.FAN + 1)
    )
    return f"""
with crcs as (select list(c order by i) as c from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(256) r(i))),
basis as (select k, {wave("cos")} as c, {wave("sin")} as s from range(1, {bins + 1}) r(k)),
t as (select doc_id, octet_length(encode(coalesce(text, ''))) as size, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, size, h || repeat('20', case when size = 0 then {block} else (-size % {block} + {block}) % {block} end) as h from t),
b as (select doc_id, size, h, octet_length(unhex(h)) as n,
  list_transform(regexp_extract_all(h, '..'), lambda x: 16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1) as v from p),
frames as (select doc_id, i as t, cast(list_transform(v[i * {half} + 1:i * {half} + {block}], lambda x: x - 128.0e0) as double[{block}]) as x from (select doc_id, v, unnest(range(n // {half} - 1)) as i from b)),
power as (select doc_id, t, max({{'p': round(sqrt(array_inner_product(x, c) ** 2 + array_inner_product(x, s) ** 2), {media_op.DIGITS}), 'k': -k}}) as m from frames, basis group by 1, 2),
best as (select doc_id, t, m.p as size, -m.k as f from power),
near as (select *, lag(size) over w as before, lead(size) over w as behind from best window w as (partition by doc_id order by t)),
peaks as (select doc_id, t, f from near where (before is null or size > before) and (behind is null or size >= behind)),
codes as (select doc_id, code from ({pairs}) where gap <= {media_op.REACH}),
prints as (select doc_id, list(code order by code) as codes, string_agg({le("code", 8)}, '' order by code) as h from codes group by 1),
n_peaks as (select doc_id, count(*) as n from peaks group by 1)
select b.doc_id, size as n_bytes, n as payload_bytes, sha256(unhex(b.h)) as payload_sha256,
  xor(list_reduce(v[n - 15:n], lambda c, x: xor(c >> 8, crcs.c[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as tail_crc32,
  n + 44 as media_bytes, sha256(unhex({header} || b.h)) as media_sha256,
  (n // {half} - 1) || ':' || (select n from n_peaks where n_peaks.doc_id = b.doc_id) || ':' || coalesce(len(codes), 0) || ':' || sha1(unhex(coalesce(prints.h, ''))) as feature, coalesce(array_to_string(codes, ','), '') as fingerprints
from b cross join crcs left join prints on prints.doc_id = b.doc_id
"""
