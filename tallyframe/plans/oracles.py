"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from . import canonical
from ..operators.cluster import ABBREVIATIONS, KIN

LEGACY = """legacy as (select
  'PCM-' || lpad(cast(o_orderkey as varchar), 8, '0') as "POL_NO",
  lpad(cast(o_orderkey % 3 as varchar), 2, '0') as "POL_NO_SEQ",
  case when o_orderkey % 11 = 0 then '00000000' else strftime(o_orderdate, '%Y%m%d') end as "EFF_DT",
  month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) as "SIGN_DT",
  strftime(o_orderdate, '%Y-%m-%d') as "ISO_DT",
  cast(cast(round(o_totalprice * 100) as bigint) as varchar) as "PREM_AMT",
  case when o_orderkey % 7 = 0 then '' else cast(o_orderkey % 500 as varchar) || '.50' end as "DEDUCT",
  case when o_orderkey % 2 = 0 then 'Y' else 'N' end as "WINBK_FLG",
  case when o_orderkey % 5 = 0 then 'TRUE' else 'false' end as "CLAIMS_IND",
  '  ' || upper(o_orderpriority) || ' ' as "INS_NM",
  case when o_orderkey % 13 = 0 then '' else o_orderstatus end as "POL_STAT_CD",
  o_orderkey as pos
  from orders)"""
LEGACY_COLUMNS = ["POL_NO", "POL_NO_SEQ", "EFF_DT", "SIGN_DT", "ISO_DT", "PREM_AMT", "DEDUCT", "WINBK_FLG", "CLAIMS_IND", "INS_NM", "POL_STAT_CD"]
COLUMNS = {
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "legacy": ("pos", LEGACY_COLUMNS),
    "lineitem": ("l_orderkey * 10 + l_linenumber", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]),
}
TEXTS = {
    **{c: f"strftime({c}, '%Y-%m-%d')" for c in ("o_orderdate", "l_shipdate")},
    "ts": "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')",
    **{c: f"cast({c} as varchar)" for c in ("c_acctbal", "o_totalprice", "s_acctbal", "value", "l_quantity", "l_extendedprice", "l_discount", "l_tax")},
}


def _cells(name: str = "cells", tables: dict | None = None) -> str:
    parts = []
    for table, (key, columns) in (tables or COLUMNS).items():
        for i, c in enumerate(columns):
            text = TEXTS.get(c, f'cast("{c}" as varchar)')
            parts.append(f"select '{table}' as table_name, '{c}' as column_name, {i} as ordinal, cast({key} as bigint) as pos, nullif(trim(coalesce({text}, '')), '') as value from {table}")
    return f"{name} as (" + " union all ".join(parts) + ")"


KIND = """case
  when regexp_full_match(value, '\\d{8}') and cast(value[1:4] as int) between 1900 and 2099 and cast(value[5:6] as int) between 1 and 12 and cast(value[7:8] as int) between 1 and 31 then 'date'
  when regexp_full_match(value, '\\d{4}-\\d{2}-\\d{2}') and cast(value[6:7] as int) between 1 and 12 and cast(value[9:10] as int) between 1 and 31 then 'date'
  when regexp_full_match(value, '\\d{1,2}/\\d{1,2}/\\d{4}') then 'date'
  when lower(value) in ('y', 'n', 'true', 'false', 'yes', 'no', 't', 'f') then 'boolean'
  when regexp_full_match(value, '-*\\d+') then 'integer'
  when regexp_full_match(value, '[+-]?(\\d+\\.\\d*|\\.\\d+)([eE][+-]?\\d+)?') then 'decimal'
  else 'string' end"""


def _profile(p: str = "", cells: str = "cells") -> str:
    """CTEs values, votes, profile with a name prefix."""
    return f"""{p}vals as (select table_name, column_name, value, count(*) as n, min(pos) as first_pos, {KIND} as cell_type from {cells} where value is not null group by all),
{p}vals2 as (select *, case when cell_type = 'date' then case when regexp_full_match(value, '\\d{{8}}') then 'YYYYMMDD' when value like '____-%' then 'ISO8601' else 'US' end end as date_format from {p}vals),
{p}votes as (select table_name, column_name, cell_type, sum(n) as v, min(first_pos) as p from {p}vals group by all),
{p}winner as (select table_name, column_name, cell_type as t from {p}votes qualify row_number() over (partition by table_name, column_name order by v desc, p) = 1),
{p}formats as (select table_name, column_name, date_format as f, sum(n) as v, min(first_pos) as p from {p}vals2 where date_format is not null group by all),
{p}format as (select table_name, column_name, f from {p}formats qualify row_number() over (partition by table_name, column_name order by v desc, p) = 1),
{p}shape as (select table_name, column_name, count(*) as d, max(length(value)) as longest from {p}vals group by all),
{p}counts as (select table_name, column_name, min(ordinal) as ordinal, count(*) as row_count, count(value) as filled from {cells} group by all),
{p}profile as (select c.table_name, c.column_name, c.ordinal, c.row_count, case when row_count = 0 then 1.0 else round_even((row_count - filled) / row_count, 4) end as null_rate,
  least(coalesce(d, 0), 1000) as distinct_count, coalesce(d, 0) as exact_distinct, coalesce(t, 'string') as inferred_type, case when t = 'date' then f end as date_format,
  regexp_matches(c.column_name, '(?i)(_ID|_NO|_NBR|_SEQ|_NUM|_KEY|_REF)$') as is_id,
  coalesce(d, 0) < 20 and coalesce(t, 'string') in ('string', 'boolean') and coalesce(longest, 0) <= 10 as is_coded,
  coalesce(t, 'string') = 'integer' and regexp_matches(c.column_name, '(?i)(AMT|PREM|LIM|DED|VAL|REV|EXPO|COST|FEE|CHG|BAL)') as is_cents
  from {p}counts c left join {p}shape using (table_name, column_name) left join {p}winner using (table_name, column_name) left join {p}format using (table_name, column_name))"""


BASE = f"with {LEGACY}, {_cells()}, {_profile()}"
SAMPLES = "samples as (select table_name, column_name, list(value order by pos, value) as samples from (select * from cells where value is not null qualify row_number() over (partition by table_name, column_name order by pos, value) <= 10) group by all)"
TOP = "top as (select table_name, column_name, row_number() over (partition by table_name, column_name order by n desc, first_pos, value) as rank, value, n from vals join (select table_name, column_name from vals group by all having count(*) <= 20) using (table_name, column_name) qualify rank <= 5)"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, by bits of a 128-bit number."""
    full = f"((cast(1 as hugeint) << length({b})) - 1)"
    match = f"list_transform(string_split({a}, ''), lambda ch: coalesce(list_sum(list_transform(range(1, length({b}) + 1), lambda j: case when {b}[j] = ch then cast(1 as hugeint) << (j - 1) else cast(0 as hugeint) end)), 0)::hugeint)"
    reduced = f"list_reduce({match}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(case when length({a}) = 0 or length({b}) = 0 then 0 else bit_count(xor({reduced}, {full})) end)"


def ratio(a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 1.0 else 2.0 * {lcs(a, b)} / (length({a}) + length({b})) end)"


def token_set(table: str, a: str, b: str, keys: str) -> str:
    """A query with the token-set ratio of columns a and b of a table of distinct pairs."""
    return f"""(select {keys}, {a}, {b}, case when len(x) = 0 or len(y) = 0 then 0.0 when s > 0 and (lx = 0 or ly = 0) then 1.0
 when s > 0 then greatest(first, 1.0 - (1 + lx) / (s + s + 1 + lx), 1.0 - (1 + ly) / (s + s + 1 + ly)) else first end as ts
 from (select *, 1.0 - (lx + ly - 2 * {lcs('ox', 'oy')}) / greatest(1, (s + gap + lx) + (s + gap + ly)) as first
 from (select *, length(ox) as lx, length(oy) as ly, length(both_) as s, case when length(both_) > 0 then 1 else 0 end as gap
 from (select *, array_to_string(list_sort(list_intersect(x, y)), ' ') as both_, array_to_string(list_sort(list_filter(x, lambda t: not list_contains(y, t))), ' ') as ox, array_to_string(list_sort(list_filter(y, lambda t: not list_contains(x, t))), ' ') as oy
 from (select *, list_distinct(list_filter(string_split({a}, ' '), lambda t: t <> '')) as x, list_distinct(list_filter(string_split({b}, ' '), lambda t: t <> '')) as y from {table})))))"""


def _fields() -> str:
    rows = canonical.rows("policy", canonical.POLICY)
    q = lambda v: "null" if v is None else f"'{v}'"
    policy = ", ".join(f"('policy', {o}, '{n}', '{t}', {str(r).lower()}, {q(s)}, {names!r})" for _, o, n, t, r, s, names in rows)
    shop = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "decimal"), ("c_mktsegment", "string")]
    table = ", ".join(f"('customer_table', {i}, '{n}', '{t}', false, null, ['{n}'])" for i, (n, t) in enumerate(shop))
    return f"fields(schema_key, field_ordinal, field, target_type, required, secondary, names) as (values {policy}, {table})"


CLEAN = "trim(replace(lower(regexp_replace({0}, '^_+', '')), '_', ' '))"
SCORED = f"""{_fields()},
columns_ as (select *, case when table_name in ('orders', 'events', 'lineitem') then 'customer_table' else 'policy' end as schema_key, case when table_name = 'legacy' then 'oldsys' else 'shop' end as source_name from profile where not regexp_matches(column_name, '(?i)^_CDC_')),
names_ as (select schema_key, field, {CLEAN.format('n')} as b from (select schema_key, field, unnest(names) as n from fields)),
lefts as (select distinct column_name, schema_key, {CLEAN.format('column_name')} as a from columns_),
joined as (select distinct l.column_name, l.schema_key, l.a, n.field, n.b from lefts l join names_ n using (schema_key)),
distinct_pairs as (select distinct a, b from joined),
token_sets as {token_set('distinct_pairs', 'a', 'b', '1 as one')},
name_scores as (select column_name, schema_key, field, max(greatest({ratio('j.a', 'j.b')}, ts)) as name_score from joined j join token_sets t on j.a = t.a and j.b = t.b group by all),
typed as (select c.*, f.field, f.field_ordinal, f.target_type, f.required, f.secondary, name_score,
  case when inferred_type = target_type then 1.0 else case inferred_type || '>' || target_type
   when 'integer>decimal' then 0.85 when 'integer>bigint' then 0.90 when 'decimal>integer' then 0.60
   when 'string>integer' then case when is_id then 0.75 else 0.40 end when 'string>bigint' then case when is_id then 0.70 else 0.35 end
   when 'string>date' then case when date_format is not null then 0.70 else 0.25 end when 'string>boolean' then case when is_coded then 0.75 else 0.30 end
   when 'boolean>string' then 0.60 when 'integer>string' then 0.50 else 0.20 end end::double as type_score,
  case when target_type = 'date' and regexp_matches(column_name, '(?i)(_DT|_DATE|_DAT)$') then 1.0 when target_type = 'decimal' and regexp_matches(column_name, '(?i)(_AMT|_PREM|_LIM|_DED|_VAL|_REV)$') then 1.0
   when target_type in ('integer', 'bigint') and is_id then 1.0 when target_type = 'boolean' and regexp_matches(column_name, '(?i)(_FLG|_FLAG|_IND)$') then 1.0
   when target_type = 'string' and regexp_matches(column_name, '(?i)(_CD|_CODE|_STAT|_TYP|_TYPE)$') then 0.5 else 0.0 end::double as pattern_score
  from columns_ c join name_scores using (column_name, schema_key) join fields f using (schema_key, field)),
scored as (select *, least(1.0::double, 0.65::double * name_score + 0.25::double * type_score + 0.10::double * pattern_score) as confidence from typed)"""
BEST = """best as (select * exclude (name_score, type_score, pattern_score, confidence), case when confidence >= 0.30 then field end as target, round_even(name_score, 4) as name_score, round_even(type_score, 4) as type_score, round_even(pattern_score, 4) as pattern_score, round_even(confidence, 4) as confidence
  from scored qualify row_number() over (partition by source_name, table_name, column_name order by scored.confidence desc, field_ordinal) = 1)"""
CONTENDED = """placed as (select *, row_number() over (partition by source_name, table_name, target order by confidence desc, ordinal) as place from best),
gaps as (select *, max(case when place = 1 then confidence end) over w as c1, max(case when place = 2 then confidence end) over w as c2 from placed window w as (partition by source_name, table_name, target)),
acted as (select *, case when target is null then 'unmapped' when place = 1 and near and secondary is null then 'contested' when place = 1 then 'kept' when place = 2 and near and secondary is not null then 'promoted' else 'demoted' end as action from (select *, coalesce(round_even(c1 - c2, 10) < 0.05, false) as near from gaps)),
contended as (select *, case when action in ('kept', 'contested') then target when action = 'promoted' then secondary end as final_target from acted)"""
MAPPED = f"{BASE}, {SCORED}"

_H = """h as (select event_id as id, 'run-' || user_id % 20 as run_id, 'src' || user_id % 5 as source_name, 'COL_' || event_id % 40 as source_column,
  case when event_id % 9 = 0 then null else 'field_' || event_id * 7 % 24 end as target,
  case when event_id % 10 = 0 then null when event_id % 4 = 1 then 'field_' || event_id * 5 % 24 else 'field_' || event_id * 7 % 24 end as truth,
  (event_id * 37 % 101)::double / 100 as confidence, event_id % 3 = 0 as is_hard, 0.6::double as confidence_floor,
  case when event_id % 5 = 0 then 'cents' when event_id % 5 = 1 then 'date' end as chk, case when event_id % 2 = 0 then 'x / 100' else 'try_to_date(x)' end as expression,
  case when event_id % 6 = 0 then 'critic' else 'rule' end as method, case when event_id % 4 = 0 then 'accepted' when event_id % 4 = 1 then 'auto_approved' end as reviewer_action,
  case when event_id % 8 <> 3 then 'sig' || event_id % 7 end as profile_signature, ts as recorded_at, event_type from events)"""
_VERDICT = "case when truth is null and target is null then 'TN' when truth is null then 'FP' when target is null then 'FN' when truth = target then 'TP' else 'WRONG_TARGET' end"
HIST = f"with {_H}, hv as (select *, {_VERDICT} as verdict from h)"
_SC = f"""sc0 as (select id, run_id, source_name, source_column, truth, is_hard, confidence_floor, chk, case when id % 17 <> 0 then target end as target, case when id % 17 <> 0 then confidence else 0 end as confidence, case when id % 17 <> 0 then expression else '' end as expression from h),
sc1 as (select *, {_VERDICT} as verdict from sc0),
sc2 as (select *, verdict in ('TP', 'TN') as ok, case when verdict = 'TP' and chk = 'cents' then contains(expression, '/') and contains(expression, '100') when verdict = 'TP' and chk = 'date' then contains(lower(expression), 'date') end as sql_ok, target is not null and confidence < confidence_floor as below_floor,
  round_even((confidence - verdict in ('TP', 'TN')::int) * (confidence - verdict in ('TP', 'TN')::int), 4) as calibration from sc1),
sc as (select *, round_even(case when is_hard then 2.0 else 1.0 end * ((not ok)::int + 0.3::double * calibration + coalesce((not sql_ok)::int, 0)), 4) as loss from sc2)"""
_SC = _SC.replace("verdict in ('TP', 'TN')::int", "(verdict in ('TP', 'TN'))::int")
SCORES = f"with {_H}, {_SC}"
_CALLS = """calls as (select 'run-' || user_id % 20 as run_id, 'COL_' || event_id % 40 as source_column, case when event_id % 11 = 0 then 'critic' else 'mapping' end as agent, event_type as tool_name, event_id as call_order, '{"q":' || event_id % 4 || '}' as inputs_json from events)"""
_USAGE = f"""{_CALLS}, per as (select run_id, source_column, list(tool_name order by call_order, tool_name) as tools, count(*) as calls from calls where agent = 'mapping' group by all),
latest as (select run_id, source_column, verdict, 'sig' || cast(source_column[5:] as int) % 6 as signature from hv where id % 23 <> 1 qualify row_number() over (partition by run_id, source_column order by recorded_at desc, id desc) = 1),
usage as (select run_id, source_column, verdict, signature, coalesce(tools, []) as tools, coalesce(calls, 0) as calls from latest left join per using (run_id, source_column))"""
_VALUE = """tool as (select distinct event_type as tool from events),
each as (select signature, tool, verdict in ('TP', 'TN') as ok, list_contains(tools, tool) as called from usage join tool on true where verdict is not null and signature in (select signature from usage where verdict is not null group by all having count(*) >= 2)),
value as (select signature, tool, count(*) filter (called) as with_n, count(*) filter (not called) as without_n, avg(ok::int) filter (called) as a, avg(ok::int) filter (not called) as b from each group by all having with_n > 0 and without_n > 0),
valued as (select signature, tool, with_n, without_n, round_even(a, 6) as with_accuracy, round_even(b, 6) as without_accuracy, round_even(a - b, 6) as delta from value)"""
_DECIDED = """known as (select distinct target as name from h where target is not null),
dec as (select id, case when id % 3 = 0 then 'accept' when id % 3 = 1 then 'modify' else 'skip' end as decision, 'field_' || case when id % 40 < 10 then id % 26 else id % 24 end as new_target from h where id % 40 <> 7 or id % 3 <> 0),
decided as (select h.id, h.source_name, h.source_column, h.confidence, coalesce(decision, 'pending') as decision, case when decision = 'accept' then target when decision = 'modify' then new_target end as approved_target, case when decision = 'modify' then 'manual' else method end as method
  from h left join (select * from dec where decision <> 'modify' or new_target in (select name from known)) using (id)),
states as (select d.source_column, count(*) as columns, count(*) filter (decision = 'pending') as pending, any_value(coalesce(c, 0)) as contests from decided d left join (select source_column, count(*) as c from decided where confidence > 0.985 and source_name = 'src0' and source_column in ('COL_1', 'COL_2', 'COL_3') group by all) using (source_column) group by all)"""
DECIDED = f"with {_H}, {_DECIDED}"

_MAP = ", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items())
_PAIRS = f"""{SAMPLES}, {TOP},
catalog as (select table_name as source_name, regexp_replace(column_name, '^[a-z]_', '') as column_name, ordinal, inferred_type, is_id, is_coded, is_cents, case when row_count > 0 then exact_distinct / row_count else 0 end as distinct_ratio, null_rate,
  case when is_coded or tops is not null then list_distinct(list_concat(coalesce(tops, []), list_transform(coalesce(samples, []), lambda v: upper(v)))) else [] end as vocabulary
  from profile left join (select table_name, column_name, list_distinct(list(upper(value))) as tops from top group by all) using (table_name, column_name) left join samples using (table_name, column_name)),
worded as (select *, array_to_string(list_transform(list_filter(string_split(translate(lower(column_name), '_-', '  '), ' '), lambda t: t <> ''), lambda t: coalesce(map {{{_MAP}}}[t], t)), ' ') as words from catalog where not regexp_matches(column_name, '(?i)^(_cdc|_meta|_ingest|_load)')),
crossed as (select a.source_name as a_source_name, a.column_name as a_column_name, a.ordinal as a_ordinal, b.source_name as b_source_name, b.column_name as b_column_name, b.ordinal as b_ordinal, a.words as wa, b.words as wb, a.vocabulary as va, b.vocabulary as vb,
  a.inferred_type = b.inferred_type as same, a.inferred_type = b.inferred_type or a.inferred_type || '>' || b.inferred_type in ({', '.join(f"'{k}'" for k in map(">".join, KIN))}) as kin,
  abs(a.distinct_ratio - b.distinct_ratio) as dd, abs(a.null_rate - b.null_rate) as dn, (a.is_id <> b.is_id)::int + (a.is_coded <> b.is_coded)::int + (a.is_cents <> b.is_cents)::int as flags
  from worded a join worded b on a.source_name < b.source_name),
word_pairs as (select distinct wa, wb from crossed),
sets_ as {token_set('word_pairs', 'wa', 'wb', '1 as one')},
sorted_ as (select wa, wb, array_to_string(list_sort(string_split(wa, ' ')), ' ') as p, array_to_string(list_sort(string_split(wb, ' ')), ' ') as q from word_pairs),
named as (select s.wa, s.wb, greatest(ts, {ratio('p', 'q')}) as name from sets_ s join sorted_ using (wa, wb)),
gated as (select c.*, name, case when len(va) > 0 and len(vb) > 0 then len(list_intersect(va, vb)) / len(list_distinct(list_concat(va, vb))) else 0 end as overlap,
  case when not kin then 0.25 when not same then 0.85 else 1.0 end::double * (1 - 0.6::double * dd) * (1 - 0.3::double * dn) * pow(0.9::double, flags) as g from crossed c join named using (wa, wb)),
pairs as (select *, round_even(raw * case when kin then greatest(g, 0.72::double) else g end, 6) as score from (select *, case when overlap > 0 then greatest(0.75::double * overlap + 0.25::double * name, case when name >= 0.62 then 0.85::double * name else 0 end) when name >= 0.62 then 0.85::double * name else 0 end as raw from gated) where score >= 0.55)"""
_MUTUAL = """mutual as (select * from pairs qualify row_number() over (partition by a_source_name, a_column_name, b_source_name order by score desc, b_ordinal) = 1 and row_number() over (partition by b_source_name, b_column_name, a_source_name order by score desc, a_ordinal) = 1)"""
CLUSTER = f"{BASE}, {_PAIRS}"

_ROWSHAPE = """rs as (select *, 0.6::double * case when row_count > 0 then exact_distinct / row_count else 0 end + 0.2::double * (1 - null_rate) + 0.2::double * is_id::int as key_score, regexp_matches(upper(column_name), 'CDC|OPERATION') as captured,
  case when is_id and inferred_type = 'integer' and regexp_matches(upper(column_name), 'SEQ|VER|REV') then 0.9 when regexp_matches(upper(column_name), 'CDC|OPERATION') then 0.85 when inferred_type = 'date' then 0.5 end as recency from profile),
rk as (select *, row_number() over (partition by table_name order by key_score desc, ordinal) = 1 as is_key from rs),
rr as (select table_name, column_name from rk where not is_key and recency is not null qualify row_number() over (partition by table_name order by recency desc, ordinal) = 1),
rowshape as (select k.table_name, k.column_name as natural_key, rr.column_name as recency_column, s.strategy, round_even(least(1.0, least(k.key_score, 1.0) * 0.6::double + case when rr.column_name is not null then 0.3 else 0.0 end::double + case when s.strategy = 'none' and k.exact_distinct = k.row_count then 0.1 else 0.0 end::double), 3) as confidence
  from rk k left join rr using (table_name) join (select x.table_name, case when bool_or(captured) then 'cdc_latest' when any_value(r.column_name) is not null then 'row_number' when bool_or(is_key and exact_distinct = row_count) then 'none' else 'row_number' end as strategy from rk x left join rr r using (table_name) group by all) s using (table_name) where k.is_key)"""

_NEXT = {"next": ("pos", ["POL_NO", "POL_NO_SEQ", "EFF_DT", "SIGN_DT", "ISO_DT", "PREM_AMT", "DEDUCT", "WINBK_FLAG", "HOLDER", "POL_STATUS_CD", "BATCH_NO"])}
_DRIFT = f"""with {LEGACY}, next as (select * exclude ("POL_STAT_CD", "WINBK_FLG", "INS_NM", "CLAIMS_IND", "SIGN_DT"), "POL_STAT_CD" as "POL_STATUS_CD", "WINBK_FLG" as "WINBK_FLAG", "INS_NM" as "HOLDER", 'unknown' as "SIGN_DT", '7' as "BATCH_NO" from legacy),
{_cells('ocells', {'legacy': COLUMNS['legacy']})}, {_cells('ncells', _NEXT)}, {_profile('o', 'ocells')}, {_profile('n', 'ncells')},
both_ as (select coalesce(o.column_name, n.column_name) as name, o.inferred_type as old_type, n.inferred_type as new_type from oprofile o full join nprofile n using (column_name)),
removed as (select name as old_name, old_type, lower(name) as a from both_ where new_type is null), added as (select name as new_name, new_type, lower(name) as b from both_ where old_type is null),
sim as (select *, {ratio('a', 'b')} as s from removed, added),
renamed as (select * from (select * from sim where s >= 0.85) qualify row_number() over (partition by old_name order by s desc, new_name) = 1 and row_number() over (partition by new_name order by s desc, old_name) = 1)
select 'oldsys' as source_name, 'renamed' as kind, old_name, new_name, old_type, new_type, round_even(s, 3)::double as similarity, false as breaking from renamed
union all select 'oldsys', 'removed', old_name, null, old_type, null, null, true from removed where old_name not in (select old_name from renamed)
union all select 'oldsys', 'added', null, new_name, null, new_type, null, false from added where new_name not in (select new_name from renamed)
union all select 'oldsys', 'type_changed', name, name, old_type, new_type, null, true from both_ where old_type <> new_type"""


_GRID = "grid as (select (i * (43 - i) / 2 + j)::int as point, i / 20 as wa, j / 20 as wb, (20 - i - j) / 20 as wc from range(21) a(i), range(21) b(j) where i + j <= 20)"
_TUNE_LABELS = """labels(column_name, truth, is_hard) as (values ('POL_NO', 'policy_id', true), ('EFF_DT', 'start_date', true), ('PREM_AMT', 'premium_amount', true), ('DEDUCT', 'policy_deductible', false), ('WINBK_FLG', 'win_back_eligible', false), ('POL_STAT_CD', 'policy_status', false), ('INS_NM', null, false), ('ISO_DT', null, false), ('SIGN_DT', null, false), ('CLAIMS_IND', null, false), ('POL_NO_SEQ', null, false))"""
TUNE = f"""{MAPPED}, {_GRID}, {_TUNE_LABELS},
gridded as (select point, column_name, ordinal, field, field_ordinal, secondary, least(1.0::double, wa * name_score + wb * type_score + wc * pattern_score) as confidence from typed, grid where table_name = 'legacy'),
gbest as (select point, column_name, ordinal, secondary, case when confidence >= 0.30 then field end as target, round_even(confidence, 4) as confidence from gridded qualify row_number() over (partition by point, column_name order by gridded.confidence desc, field_ordinal) = 1),
gplaced as (select *, row_number() over (partition by point, target order by confidence desc, ordinal) as place from gbest),
ggaps as (select *, coalesce(round_even(max(case when place = 1 then confidence end) over w - max(case when place = 2 then confidence end) over w, 10) < 0.05, false) as near from gplaced window w as (partition by point, target)),
gfinal as (select point, column_name, confidence, case when target is null then null when place = 1 then target when place = 2 and near and secondary is not null then secondary end as target from ggaps),
gscored as (select point, is_hard, case when truth is null and target is null then 'TN' when truth is null then 'FP' when target is null then 'FN' when truth = target then 'TP' else 'WRONG_TARGET' end as verdict, confidence from grid join labels on true join gfinal using (point, column_name)),
gloss as (select *, round_even(case when is_hard then 2.0 else 1.0 end::double * ((verdict not in ('TP', 'TN'))::int + 0.3::double * round_even((confidence - (verdict in ('TP', 'TN'))::int) * (confidence - (verdict in ('TP', 'TN'))::int), 4)), 4) as loss from gscored),
gm as (select point, count(*) filter (verdict = 'TP') as tp, count(*) filter (verdict = 'FP') as fp, count(*) filter (verdict = 'FN') as fn, count(*) filter (verdict = 'WRONG_TARGET') as wrong, round_even(avg(loss), 4) as mean_loss from gloss group by all),
gf as (select *, coalesce(tp / nullif(tp + fp + wrong, 0), 0) as p, coalesce(tp / nullif(tp + fn + wrong, 0), 0) as q from gm)
select point, tp, fp, fn, wrong, round_even(coalesce(2 * p * q / nullif(p + q, 0), 0), 4) as f1, mean_loss from gf order by mean_loss, f1 desc, point limit 10"""
SIMILAR = f"""{BASE}, flagged as (select *, {CLEAN.format('column_name')} as a from profile),
ex_pairs as (select distinct x.a as p, y.a as q from flagged x, flagged y), ex_sets as {token_set('ex_pairs', 'p', 'q', '1 as one')},
sims as (select x.table_name, x.column_name, y.column_name as example, round_even(0.5::double * ((x.inferred_type is not distinct from y.inferred_type)::int + (x.is_id is not distinct from y.is_id)::int + (x.is_coded is not distinct from y.is_coded)::int + (x.is_cents is not distinct from y.is_cents)::int + (x.date_format is not distinct from y.date_format)::int) / 5 + 0.5::double * greatest({ratio('x.a', 'y.a')}, ts), 4) as similarity
  from flagged x join flagged y on x.column_name <> y.column_name join ex_sets s on s.p = x.a and s.q = y.a)
select 'all' as source_name, table_name, column_name, row_number() over (partition by table_name, column_name order by similarity desc, example) as rank, example, similarity from sims where similarity >= 0.35 qualify rank <= 3"""
_TARGET = "case when {0} in ('name', 'nationkey', 'acctbal') then {0} end"
CLUSTER_SCORE = f"""{CLUSTER}, best_pairs as (select * from pairs where a_source_name = 'customer' and b_source_name = 'supplier'),
{_MUTUAL.replace('from pairs', 'from best_pairs')},
t as (select {_TARGET.format('a_column_name')} as x, {_TARGET.format('b_column_name')} as y from mutual),
c as (select count(*) filter (coalesce(x = y, false)) as tp, count(*) filter ((x is not null or y is not null) and not coalesce(x = y, false)) as fp, count(*) filter (x is null and y is null) as unscored from t),
n as (select count(*) as truth from (select column_name from catalog where source_name in ('customer', 'supplier') and column_name in ('name', 'nationkey', 'acctbal') group by all having count(*) = 2)),
r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(truth, 0), 0) as q from c, n)
select tp, fp, truth, unscored, 0 as secondary, round_even(p, 4) as precision, round_even(q, 4) as recall, round_even(coalesce(2 * p * q / nullif(p + q, 0), 0), 4) as f1 from r"""
_SUGGEST = """sug as (select *, case column_name when 'c_custkey' then 'customer_id' when 's_suppkey' then 'no_such_field' when 'INS_NM' then 'policy_type' when 'POL_NO' then 'policy_number' end as s_target from best),
merged as (select *, case when s_target is not null then 0.8 when confidence < 0.70 then 0.30 end as s_conf from sug),
taken as (select *, coalesce(s_conf > confidence, false) as better from merged),
chosen as (select * exclude (target, confidence), case when better then case when s_target in (select f.field from fields f where f.schema_key = taken.schema_key) then s_target end else target end as target, case when better then s_conf else confidence end as confidence, case when better then 'suggested' else 'rule' end as method from taken),
overridden as (select * exclude (target, method), case column_name when 'ISO_DT' then 'end_date' when 'c_name' then null else target end as target, case when column_name in ('ISO_DT', 'c_name') then 'critic' else method end as method from chosen)"""


_TRANSFORM = """case when {0} is null then 'blank_as_null' when target_type = 'date' then case date_format when 'US' then 'us_date' when 'ISO8601' then 'iso_date' else 'compact_date' end when target_type = 'boolean' then case when truth_ then 'true_false' else 'yes_no' end
  when target_type in ('integer', 'bigint') and prefix is not null then 'prefixed_id' when target_type in ('integer', 'bigint') then 'whole_number' when target_type = 'decimal' and inferred_type = 'integer' and is_cents then 'cents' when target_type = 'decimal' then 'money' else 'blank_as_null' end"""
_EXPRESSION = """case transform when 'compact_date' then 'try_to_date(' || q || ', ''yyyyMMdd'')' when 'us_date' then 'try_to_date(' || q || ', ''M/d/yyyy'')' when 'iso_date' then 'try_cast(' || q || ' as date)'
  when 'yes_no' then 'case upper(' || q || ') when ''Y'' then true when ''N'' then false end' when 'true_false' then 'try_cast(lower(' || q || ') as boolean)' when 'prefixed_id' then 'try_cast(replace(' || q || ', ''' || prefix || ''', '''') as bigint)'
  when 'whole_number' then 'try_cast(' || q || ' as bigint)' when 'cents' then 'cast(try_cast(' || q || ' as decimal(14,0)) / 100 as decimal(14,2))' when 'money' then 'try_cast(' || q || ' as decimal(12,2))' else 'nullif(trim(' || q || '), '''')' end"""


_PRINT = "'[' || string_agg(column_name || ':' || inferred_type || ':' || is_id || ':' || is_coded || ':' || coalesce(date_format, ''), ', ' order by lower(column_name), column_name) || ']'"
_ROUNDED = "rounded as (select * exclude (confidence), round_even(confidence, 1) as confidence from best)"
_SQL_TYPES = {"integer": "bigint", "bigint": "bigint", "decimal": "decimal(12, 2)", "date": "date", "boolean": "boolean", "string": "varchar"}
_STAGED_BY = {
    "policy_id": """try_cast(replace("POL_NO", 'PCM-', '') as bigint)""", "policy_number": """nullif(trim("POL_NO"), '')""", "risk_score": 'try_cast("POL_NO_SEQ" as bigint)', "start_date": """cast(try_strptime("EFF_DT", '%Y%m%d') as date)""",
    "end_date": 'try_cast("ISO_DT" as date)', "premium_amount": 'cast(try_cast("PREM_AMT" as decimal(14, 0)) / 100 as decimal(14, 2))', "policy_deductible": """try_cast(nullif("DEDUCT", '') as decimal(12, 2))""",
    "win_back_eligible": """case upper("WINBK_FLG") when 'Y' then true when 'N' then false end""", "policy_status": """nullif(trim("POL_STAT_CD"), '')""", "region_code": "'TX'", "customer_id": 'try_cast("POL_NO"[5:] as bigint)', "annual_revenue_impact": "12.50::decimal(12, 2)",
}
_STAGED = ", ".join([f"{_STAGED_BY.get(name, f'null::{_SQL_TYPES[kind]}')} as {name}" for name, kind, *_ in canonical.POLICY] + ["""'{"SIGN_DT":"' || "SIGN_DT" || '","CLAIMS_IND":"' || "CLAIMS_IND" || '"}' as extended_attributes"""])


def oracle_sql() -> dict[str, str]:
    ends = "a_source_name, a_column_name, b_source_name, b_column_name"
    return {
        "canonical_staging": f"""with {LEGACY} select try_cast(replace(trim("POL_NO"), 'PCM-', '') as bigint) as policy_id, try_cast("POL_NO_SEQ" as bigint) as policy_seq, nullif(trim("POL_NO"), '') as policy_number,
  cast(try_strptime("EFF_DT", '%Y%m%d') as date) as start_date, cast(try_strptime("SIGN_DT", '%m/%d/%Y') as date) as sign_date, try_cast("ISO_DT" as date) as end_date,
  cast(try_cast("PREM_AMT" as decimal(14, 0)) / 100 as decimal(14, 2)) as premium_amount, try_cast(nullif("DEDUCT", '') as decimal(12, 2)) as policy_deductible, case upper("WINBK_FLG") when 'Y' then true when 'N' then false end as win_back_eligible,
  try_cast(lower("CLAIMS_IND") as boolean) as claims_made, array_to_string(list_transform(string_split(lower(trim("INS_NM")), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as insured_name,
  case trim("POL_STAT_CD") when 'F' then 'Final' when 'O' then 'Open' else trim("POL_STAT_CD") end as policy_status, 'TX' as region_code, length("POL_NO") as number_length, cast(null as bigint) as customer_id,
  '{{"POL_NO_SEQ":"' || "POL_NO_SEQ" || '","CLAIMS_IND":"' || "CLAIMS_IND" || '"}}' as extended_attributes from legacy""",
        "definition_staging": f"with {LEGACY} select {_STAGED} from legacy",
        "canonical_codes": f"""with {LEGACY} select "POL_NO", case trim("POL_STAT_CD") when 'P' then 'P' when '' then '' else 'state ' || lower(trim("POL_STAT_CD")) end as "POL_STAT_CD", lower(trim("INS_NM")) as "INS_NM", "WINBK_FLG" from legacy""",
        "canonical_codes_missing": f"""with {LEGACY} select 'POL_STAT_CD' as column_name, 'P' as code, count(*) as rows from legacy where "POL_STAT_CD" = 'P' having count(*) > 0 union all select 'WINBK_FLG', "WINBK_FLG", count(*) from legacy group by all""",
        "canonical_unmapped": f"""with {LEGACY}, {_fields()} select field as name, required, "POL_STAT_CD", count(*) as rows from legacy, fields where schema_key = 'policy'
  and field not in ('policy_id', 'policy_number', 'risk_score', 'start_date', 'end_date', 'premium_amount', 'policy_deductible', 'win_back_eligible', 'policy_status', 'region_code', 'customer_id', 'agent_id', 'annual_revenue_impact') group by all""",
        "staging_projection": f"with {LEGACY} select {_STAGED} from legacy",
        "label_catalog": f"""with {_H}, t as (select *, 't' || id % 3 as table_name from h)
select source_name, table_name, source_column, arg_max_null(truth, id) as truth, min(truth) as secondary, max(confidence_floor) as confidence_floor, max(chk) as "check", bool_or(is_hard) as is_hard from t group by all
union all select distinct source_name, table_name, '-', target, null, null, null, null from t where id % 97 = 5 and target is not null""",
        "profile_vote_limit": f"""{BASE}, lasts as (select table_name, max(pos) as last_pos from (select * from cells where ordinal = 0 qualify row_number() over (partition by table_name order by pos) <= 700) group by all),
vcells as (select cells.* from cells join lasts using (table_name) where pos <= last_pos), {_profile('v', 'vcells')}
select p.table_name, p.column_name, v.inferred_type, v.date_format, p.row_count, p.null_rate from profile p join vprofile v using (table_name, column_name)""",
        "map_contest_list": f"""{MAPPED}, {BEST}, {_ROUNDED}, {CONTENDED.replace('from best', 'from rounded')},
open_ as (select source_name, table_name, target, column_name as provisional from contended where action = 'contested')
select source_name, table_name, target, provisional, string_agg(column_name || '=' || printf('%.1f', confidence), ',' order by confidence desc, ordinal) as columns from contended join open_ using (source_name, table_name, target) group by all""",
        "map_reasons": f"""{MAPPED}, {BEST}, {_ROUNDED}, {CONTENDED.replace('from best', 'from rounded')},
won as (select *, max(case when place = 1 then column_name end) over (partition by source_name, table_name, target) as winner from contended)
select table_name, column_name, target, action, final_target, case action when 'demoted' then 'target taken by ' || winner when 'promoted' then 'near tie with ' || winner || ', moved to ' || secondary else 'near tie, kept until decided' end as reason from won where action in ('demoted', 'promoted', 'contested')""",
        "map_schemas": """with c as (select distinct event_type as table_name, case event_id % 10 when 0 then '_cdc_op' when 1 then '_CDC_TS' else 'COL_' || event_id % 10 end as column_name from events)
select table_name, column_name, case table_name when 'click' then 'clicks' when 'purchase' then 'sales' when 'view' then 'views' else 'policy' end as schema_key, lower(column_name) like '\\_cdc\\_%' escape '\\' as excluded from c""",
        "map_review_selection": f"with {_H} select id, confidence, is_hard, (id % 5) / 4 as confidence_floor from h where id % 7 <> 0 and (is_hard or confidence < (id % 5) / 4)",
        "map_catalog": f"""{MAPPED}, {BEST}, {CONTENDED}, {_ROWSHAPE}
select table_name, case when final_target is null then 'unmapped' else 'mapped' end as kind, column_name as name, final_target as detail from contended
union all select table_name, 'contested', target, column_name from contended where action = 'contested'
union all select t.table_name, 'missing', f.field, null from (select distinct table_name, schema_key from columns_) t join fields f using (schema_key) where required and not exists (select 1 from contended c where c.table_name = t.table_name and c.final_target = f.field)
union all select table_name, 'key', natural_key, strategy from rowshape""",
        "drift_to_map": f"select source_name, new_name, new_type from ({_DRIFT}) where kind = 'added'",
        "backfill_rows": f"with {_H} select source_name, 't' as table_name, source_column, target as target_field, count(*) as n from h where id % 50 = 3 group by all",
        "score_export": f"{SCORES} select cast(id as varchar) as id, verdict, cast(below_floor as varchar) as below_floor from sc",
        "stratified_split": f"with {_H} select id, is_hard, case when row_number() over (partition by is_hard order by md5('7:' || id), id) <= round_even(count(*) over (partition by is_hard) * 0.7::double, 0) then 'train' else 'holdout' end as part from h",
        "curation_counts": f"""{HIST}, l as (select source_name, source_column, bool_or(is_hard) as hard from h group by all), q as (select hv.*, case when hard and verdict = 'TP' then 'hard_case' when method = 'critic' and reviewer_action in ('accepted', 'auto_approved') then 'critic_accepted' end as origin from hv join l using (source_name, source_column)),
n as (select *, exists (select 1 from h where h.id % 211 = 0 and h.source_name = x.source_name and h.source_column = x.source_column) as held from (select * from q where origin is not null qualify row_number() over (partition by source_name, source_column order by recorded_at desc, id desc) = 1) x)
select count(*) filter (not held and profile_signature is not null and origin = 'hard_case') as added_hard, count(*) filter (not held and profile_signature is not null and origin = 'critic_accepted') as added_critic, count(*) filter (held) as skipped_existing, count(*) filter (not held and profile_signature is null) as skipped_no_signature from n""",
        "improvement": f"""{SCORES}, c as (select count(*) filter (id % 2 = 0) as before_columns, count(*) filter (id % 2 = 1) as after_columns, avg(loss) filter (id % 2 = 0) as b, avg(loss) filter (id % 2 = 1) as a from sc),
r as (select count(*) as regressed from sc x where x.id % 2 = 0 and x.ok and not exists (select 1 from sc y where y.id = x.id + 1 and y.ok))
select before_columns, after_columns, regressed, round_even(b, 6) as before_loss, round_even(a, 6) as after_loss, a < b and regressed = 0 as improved from c, r""",
        "delimited_scan": f"with {LEGACY} select * exclude (pos) from legacy",
        "delimited_quoted": r"""select cast(doc_id as varchar) as DOC_ID, coalesce(text, '') as BODY, '"' || coalesce(source, '') || '", \' as SAID, chr(10) || case when strpos(coalesce(text, ''), chr(10)) = 0 then coalesce(text, '') else array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)) end || '"' || chr(10) as HEAD, coalesce(lang, '') as LANG from documents""",
        "source_row_counts": " union all ".join(f"select '{x}' as table_name, count(*) as row_count from {x}" for x in ("customer", "orders", "supplier", "events", "lineitem", "documents")),
        "drift_versions": _DRIFT.split("both_ as (")[0].rstrip().rstrip(",") + f" select 'new' as source_name, 1 as version, count(*)::int as columns, {_PRINT} as fingerprint from oprofile union all select 'forced', 2, count(*)::int, {_PRINT} from nprofile",
        "tune_grid": TUNE,
        "tune_simplex": f"{MAPPED}, {_GRID} select point, count(*) as scores, round_even(sum(least(1.0::double, wa * name_score + wb * type_score + wc * pattern_score)), 3)::decimal(18, 3) as total from typed, grid group by all",
        "similar_examples": SIMILAR,
        "cluster_score": CLUSTER_SCORE,
        "map_suggestions": f"""{MAPPED}, {BEST}, {SAMPLES}, {_SUGGEST},
prefixed as (select c.*, case when len(samples) > 0 and 2 * len(found) >= len(samples) and len(list_distinct(found)) = 1 then found[1] end as prefix, len(samples) > 0 and len(list_filter(samples, lambda s: lower(s) not in ('true', 'false'))) = 0 as truth_, b.target as first_target
  from overridden c join (select table_name, column_name, target from best) b using (table_name, column_name) join (select *, list_filter(list_transform(samples, lambda s: regexp_extract(s, '^([A-Z]{{2,5}}-)', 1)), lambda p: p <> '') as found from samples) using (table_name, column_name)),
kinds as (select *, {_TRANSFORM.format('first_target')} as transform, '`' || column_name || '`' as q from prefixed),
texts as (select *, {_EXPRESSION} as expression from kinds)
select table_name, column_name, case when target = 'policy_status' then null else target end as target, confidence, method, case when column_name = 'ISO_DT' then 'to_date(ISO_DT)' else expression end as expression, confidence < 0.70 as low from texts""",
        "dedup_latest": "select user_id, event_id, ts, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
        "dedup_cdc": "select user_id, event_type, ts, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
        "profile_columns": f"{BASE} select * exclude (ordinal) from profile",
        "profile_deliveries": f"{BASE}, {TOP}, tops as (select table_name, column_name, string_agg(value, '|' order by rank) as top from top group by all) select table_name, column_name, row_count, null_rate, inferred_type, date_format, is_id, is_coded, is_cents, exact_distinct <= 20 as distinct_exact, true as distinct_close, top from profile left join tops using (table_name, column_name)",
        "profile_type_votes": f"{BASE} select table_name, column_name, cell_type, v as votes, p as first_pos from votes",
        "profile_top_values": f"{BASE}, {TOP} select * from top",
        "profile_samples": f"{BASE}, {SAMPLES} select table_name, column_name, array_to_string(samples, '|') as samples from samples",
        "profile_hashes": f"""{BASE} select table_name, sha256('["' || string_agg(column_name || ':' || inferred_type, '", "' order by column_name || ':' || inferred_type) || '"]')[1:16] as profile_hash, count(*) as columns from profile group by all""",
        "rowshape_infer": f"{BASE}, {_ROWSHAPE} select * from rowshape",
        "rowshape_score": f"""{BASE}, {_ROWSHAPE}, truth(table_name, k, r, s) as (values ('orders', 'O_ORDERKEY', 'o_orderdate', 'row_number'), ('events', 'event_id', null, 'none'), ('customer', 'c_custkey', null, 'none'), ('legacy', 'POL_NO', 'POL_NO_SEQ', 'row_number')),
ok as (select table_name, lower(natural_key) is not distinct from lower(k) as key_ok, lower(recency_column) is not distinct from lower(r) as recency_ok, strategy is not distinct from s as strategy_ok from truth left join rowshape using (table_name))
select *, round_even(0.5::double * (not key_ok)::int + 0.3::double * (not recency_ok)::int + 0.2::double * (not strategy_ok)::int, 4) as loss from ok""",
        "map_scores": f"{MAPPED} select table_name, column_name, field, round_even(name_score, 6) as name_score, round_even(type_score, 6) as type_score, round_even(pattern_score, 6) as pattern_score, round_even(confidence, 6) as confidence from scored",
        "map_best": f"{MAPPED}, {BEST} select table_name, column_name, target, name_score, type_score, pattern_score, confidence from best",
        "map_top3": f"{MAPPED} select source_name, table_name, column_name, row_number() over (partition by source_name, table_name, column_name order by name_score desc, field_ordinal) as rank, field, round_even(name_score, 4) as name_score from scored qualify rank <= 3",
        "map_contention": f"""{MAPPED}, {BEST}, {CONTENDED}, {SAMPLES},
prefixed as (select c.*, case when len(samples) > 0 and 2 * len(found) >= len(samples) and len(list_distinct(found)) = 1 then found[1] end as prefix, len(samples) > 0 and len(list_filter(samples, lambda s: lower(s) not in ('true', 'false'))) = 0 as truth_
  from contended c join (select *, list_filter(list_transform(samples, lambda s: regexp_extract(s, '^([A-Z]{{2,5}}-)', 1)), lambda p: p <> '') as found from samples) using (table_name, column_name)),
kinds as (select *, {_TRANSFORM.format("target")} as transform, '`' || column_name || '`' as q from prefixed)
select table_name, column_name, target, confidence, action, final_target, transform, {_EXPRESSION} as expression from kinds""",
        "map_contests": f"""{MAPPED}, {BEST}, rounded as (select * exclude (confidence), round_even(confidence, 1) as confidence from best), {CONTENDED.replace('from best', 'from rounded')},
open_ as (select source_name, table_name, target from contended where action = 'contested')
select c.table_name, c.column_name, c.target, case when o.target is not null and action in ('contested', 'demoted') then case when place = 2 then 'kept' else 'demoted' end else action end as action, case when o.target is not null and action in ('contested', 'demoted') then case when place = 2 then c.target end else final_target end as final_target
from contended c left join open_ o using (source_name, table_name, target) where action <> 'unmapped'""",
        "map_missing": f"{MAPPED}, {BEST}, {CONTENDED} select t.table_name, f.field from (select distinct table_name, schema_key from columns_) t join fields f using (schema_key) where required and not exists (select 1 from contended c where c.table_name = t.table_name and c.final_target = f.field)",
        "drift_deliveries": _DRIFT.split("both_ as (")[0].rstrip().rstrip(",") + f" select x.source_name, '1' as run_id, 1 as version, count(*)::int as columns, {_PRINT} as fingerprint from oprofile, (values ('forced'), ('blocked')) x(source_name) group by x.source_name union all select 'forced', '3', 2, count(*)::int, {_PRINT} from nprofile",
        "drift_changes": _DRIFT,
        "cluster_groups": CLUSTER.replace("with ", "with recursive ", 1) + f""", {_MUTUAL},
k_ends as (select a_source_name || '.' || a_column_name as x, a_source_name as sx, b_source_name || '.' || b_column_name as y, b_source_name as sy, score from pairs),
k_met as (select m, list({{'o': o, 's': score}}) as near from (select x as m, y as o, score from k_ends union all select y, x, score from k_ends) group by m),
k_edges as (select row_number() over (order by score desc, x, y) as k, e.x, e.sx, e.y, e.sy, e.score, p.near as nx, q.near as ny
  from (select a_source_name || '.' || a_column_name as x, a_source_name as sx, b_source_name || '.' || b_column_name as y, b_source_name as sy, score from mutual) e join k_met p on p.m = e.x join k_met q on q.m = e.y),
k_fold as (select 0::bigint as k, []::struct(m varchar, s varchar, c bigint, w double)[] as g
  union all select k, case when cx is null and cy is null then list_concat(g, [{{'m': x, 's': sx, 'c': k, 'w': score}}, {{'m': y, 's': sy, 'c': k, 'w': score}}])
    when cx is null and cy is not null and fits_x = len(in_y) then list_concat(g, [{{'m': x, 's': sx, 'c': cy, 'w': list_min(list_transform(in_y, lambda t: list_filter(nx, lambda p: p.o = t.m)[1].s))}}])
    when cy is null and cx is not null and fits_y = len(in_x) then list_concat(g, [{{'m': y, 's': sy, 'c': cx, 'w': list_min(list_transform(in_x, lambda t: list_filter(ny, lambda p: p.o = t.m)[1].s))}}]) else g end
  from (select *, len(list_filter(in_y, lambda t: t.s <> sx and len(list_filter(nx, lambda p: p.o = t.m)) > 0)) as fits_x, len(list_filter(in_x, lambda t: t.s <> sy and len(list_filter(ny, lambda p: p.o = t.m)) > 0)) as fits_y
    from (select *, list_filter(g, lambda t: t.c = cx) as in_x, list_filter(g, lambda t: t.c = cy) as in_y
      from (select e.*, f.g, list_filter(f.g, lambda t: t.m = e.x)[1].c as cx, list_filter(f.g, lambda t: t.m = e.y)[1].c as cy from k_fold f join k_edges e on e.k = f.k + 1)))),
k_grouped as (select t.u.m as member, t.u.c as c, t.u.w as w from (select unnest(g) as u from k_fold where k = (select count(*) from k_edges)) t),
k_named as (select c, min(member) as cluster, count(*)::int as size, min(w) as confidence from k_grouped group by c)
select m.member, coalesce(n.cluster, m.member) as cluster, coalesce(n.size, 1)::int as size, coalesce(n.confidence, 0.0) as confidence
from (select source_name || '.' || column_name as member from catalog) m left join k_grouped g on g.member = m.member left join k_named n on n.c = g.c""",
        "cluster_votes": """with recursive v as (select 's' || user_id % 4 as pair, event_id % 10 as run, 'a' || event_id % 6 as a, 'b' || user_id % 7 as b, (event_id * 13 % 50 + 50) / 100 as confidence from events),
once as (select pair, run, a, b, max(confidence) as c from v where a <> 'a5' group by all),
tally as (select pair, a, b, count(*)::int as votes, round_even(avg(c), 6) as mean from once group by all having count(*) >= 5 and round_even(avg(c), 6) >= 0.6),
e as (select *, row_number() over (partition by pair order by votes desc, mean desc, a, b) as k from tally),
g as (select pair, 0::bigint as k, ''::varchar as a, ''::varchar as b, 0 as votes, 0::double as mean, false as took, []::varchar[] as used from (select distinct pair from e)
  union all select e.pair, e.k, e.a, e.b, e.votes, e.mean, not list_contains(g.used, e.a) and not list_contains(g.used, e.b), case when list_contains(g.used, e.a) or list_contains(g.used, e.b) then g.used else list_concat(g.used, [e.a, e.b]) end from g join e on e.pair = g.pair and e.k = g.k + 1)
select pair, a, b, votes, mean from g where took""",
        "cluster_pairs": f"{CLUSTER} select {ends}, round_even(name, 4) as name, round_even(overlap, 4) as overlap, round_even(score, 4) as score from pairs",
        "cluster_mutual": f"{CLUSTER}, {_MUTUAL} select {ends}, round_even(score, 4) as score from mutual",
        "score_columns": f"{SCORES} select id, verdict, sql_ok, below_floor, calibration::decimal(10, 4) as calibration, loss::decimal(10, 4) as loss from sc",
        "score_subset": f"{HIST} select source_column, verdict, count(*) as n from hv where source_column in ('COL_1', 'COL_2', 'COL_3') group by all",
        "score_metrics": f"""{SCORES}, m as (select source_name, count(*) as columns, count(*) filter (verdict = 'TP') as tp, count(*) filter (verdict = 'TN') as tn, count(*) filter (verdict = 'FP') as fp, count(*) filter (verdict = 'FN') as fn, count(*) filter (verdict = 'WRONG_TARGET') as wrong,
  count(*) filter (verdict = 'TP' and is_hard) as htp, count(*) filter (verdict in ('FP', 'WRONG_TARGET') and is_hard) as hfp, count(*) filter (verdict = 'FN' and is_hard) as hfn, count(*) filter (below_floor) as below_floor, round_even(avg(loss), 4) as mean_loss, count(*) filter (sql_ok) as sok, count(sql_ok) as sn from sc group by all),
r as (select *, coalesce(tp / nullif(tp + fp + wrong, 0), 0) as p, coalesce(tp / nullif(tp + fn + wrong, 0), 0) as q, coalesce(htp / nullif(htp + hfp, 0), 0) as hp, coalesce(htp / nullif(htp + hfn, 0), 0) as hq from m)
select source_name, columns, tp, tn, fp, fn, wrong, round_even(p, 4) as precision, round_even(q, 4) as recall, round_even(coalesce(2 * p * q / nullif(p + q, 0), 0), 4) as f1, round_even(coalesce(tn / nullif(tn + fp, 0), 1), 4) as left_out_accuracy, round_even(hp, 4) as hard_precision, round_even(hq, 4) as hard_recall,
  round_even(coalesce(2 * hp * hq / nullif(hp + hq, 0), 0), 4) as hard_f1, below_floor, mean_loss, round_even(coalesce(sok / nullif(sn, 0), 1), 4) as sql_rate, f1 >= 0.3 and mean_loss <= 0.9 as passed from r""",
        "score_missing": f"""with {_H}, a as (select distinct source_name, truth as field from h where truth is not null and id % 4 = 1), b as (select distinct source_name, target as field from h where target is not null and id % 3 = 1)
select source_name, field, a.source_name is not null and a.field is not null as in_labels, b.field is not null as found, (a.field is not null) = (b.field is not null) as agree from a full join b using (source_name, field)""",
        "verdict_write_back": f"{SCORES} select h.id, h.run_id, h.source_column, coalesce(case when h.id % 3 = 0 then sc.verdict end, case when h.id % 2 = 0 then 'OLD' end) as verdict from h join sc using (id)",
        "threshold_sweep": f"with {_H}, t as (select unnest([0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85])::double as threshold) select threshold, count(*) filter (confidence < threshold) as routed, count(*) as columns from t, h group by all",
        "curate_examples": f"""{HIST}, l as (select source_name, source_column, bool_or(is_hard) as hard from h group by all), q as (select hv.*, case when hard and verdict = 'TP' then 'hard_case' when method = 'critic' and reviewer_action in ('accepted', 'auto_approved') then 'critic_accepted' end as origin from hv join l using (source_name, source_column))
select source_name, source_column, id, target as target_field, origin from (select * from q where origin is not null qualify row_number() over (partition by source_name, source_column order by recorded_at desc, id desc) = 1) n where profile_signature is not null and not exists (select 1 from h where h.id % 211 = 0 and h.source_name = n.source_name and h.source_column = n.source_column)""",
        "example_stats": f"with {_H} select method as origin, case when id % 5 = 0 then 'retired' else 'active' end as status, count(*) as n from h group by all",
        "split_sizes": f"with {_H}, s as (select is_hard, count(*) as c from h group by all) select is_hard, 'train' as part, cast(round_even(c * 0.7, 0) as bigint) as n from s union all select is_hard, 'holdout', c - cast(round_even(c * 0.7, 0) as bigint) from s",
        "diagnosis": f"{SCORES} select source_name, verdict, ok and calibration >= 0.15 as fragile, count(*) as n from sc where not ok or calibration >= 0.15 group by all",
        "regressions": f"""{HIST}, b as (select source_name, source_column, verdict from hv where id % 2 = 0 qualify row_number() over (partition by source_name, source_column order by recorded_at desc, id desc) = 1), a as (select source_name, 'COL_' || (cast(source_column[5:] as int) - 1) as source_column, verdict from (select * from hv where id % 2 = 1 qualify row_number() over (partition by source_name, source_column order by recorded_at desc, id desc) = 1))
select source_name, source_column from b where verdict in ('TP', 'TN') and not exists (select 1 from a where a.source_name = b.source_name and a.source_column = b.source_column and a.verdict in ('TP', 'TN'))""",
        "repeat_variance": f"{SCORES} select run_id, round_even(avg(loss), 6) as mean, round_even(stddev_pop(loss), 6) as stdev, count(*) as runs from sc group by all",
        "latest_prompts": "select event_type as agent_name, event_id as version_id, ts as accepted_at from events where event_id % 3 = 0 qualify row_number() over (partition by event_type order by ts desc, event_id desc) = 1",
        "usage_join": f"{HIST}, {_USAGE} select run_id, source_column, verdict, signature, calls, array_to_string(tools[1:5], ',') as first_tools from usage",
        "usage_value": f"{HIST}, {_USAGE}, {_VALUE} select * from valued",
        "usage_under_triggered": f"{HIST}, {_USAGE}, {_VALUE} select * from valued where round_even(with_accuracy - without_accuracy, 6) >= 0.05",
        "usage_efficiency": f"with {_CALLS}, own as (select * from calls where agent = 'mapping'), per as (select run_id, count(*) as traces, count(*) filter (n >= 5) as at_cap from (select run_id, source_column, count(*) as n from own group by all) group by all), again as (select run_id, sum(d)::bigint as repeated from (select run_id, source_column, tool_name, inputs_json, count(*) - 1 as d from own group by all) group by all) select * from per join again using (run_id)",
        "tuning_history": """select 'run-' || r as run_id, n, '{"tuning_layer":' || n % 3 || '}' as config_snapshot from (select event_id % 400 as r, max(event_id) as n from events group by all) where n % 3 = 0""",
        "history_newest": f"with {_H} select source_name, source_column, row_number() over (partition by source_name, source_column order by recorded_at desc, id desc) as rank, id from h qualify rank <= 3",
        "review_auto": f"with {_H} select id, case when confidence >= 0.85 then 'auto' when confidence >= 0.5 then 'flagged' else 'low' end as tier, case when target is not null and confidence >= 0.7 then 'accepted' else 'skipped' end as action, case when confidence >= 0.7 then target end as approved_target from h",
        "review_apply": f"{DECIDED} select id, decision, approved_target, method from decided",
        "review_status": f"{DECIDED} select *, pending = 0 and contests = 0 as ready from states",
        "review_finalise": f"{DECIDED} select source_column, id, approved_target, approved_target is null as extended from decided join states using (source_column) where pending = 0 and contests = 0",
        "review_upsert": f"{DECIDED}, new as (select id + 500 as id, decision as reviewer_action, 'review' as method from decided) select h.id, coalesce(new.reviewer_action, h.reviewer_action) as reviewer_action, h.method from h left join new using (id) union all select * from new where id not in (select id from h)",
    }
