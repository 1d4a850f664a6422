"""SQL twins of the queries, for DuckDB."""

from tieout.functions.headers import CENSUS, NUMBERS, PROPOSAL, SYNONYMS
from tieout.operators import units
from tieout.queries import columns, doubt, full, pages, reconcile, reports, scalars, texts

#: An id as functions.ids.same_id has it.
_ID = r"nullif(regexp_extract(ltrim(regexp_replace(upper(regexp_replace(trim({c}), '\.0+\s*$', '')), '[^\p{{L}}\p{{N}}]', '', 'g'), '0'), '^.*[1-9].*$'), '')"

_P1 = f"""
with c as (select pack_id, rec_id, {_ID.format(c="employee_id")} as id, loaded_at, withdrawn_at from census),
shared as (select pack_id from pack where id_scheme = 'shared'),
r as (
  select 'proposal' as src_table, period, rec_id as row_id, pack_id, {_ID.format(c="client_employee_id")} as id, loaded_at as t from proposal where pack_id in (from shared)
  union all select 'paycheck', period, rec_id, pack_id, {_ID.format(c="employee_id")}, loaded_at from paycheck where pack_id in (from shared)),
j as (
  select src_table, period, row_id, t, c.rec_id, loaded_at, withdrawn_at from r left join c on r.pack_id = c.pack_id and r.id = c.id where r.id is not null
  union all select 'audit_match', m.period, m.match_id, m.run_at, c.rec_id, c.loaded_at, c.withdrawn_at from audit_match m left join c on m.census_rec_id = c.rec_id where m.found and m.census_rec_id is not null),
a as (
  select src_table, period, row_id, count(rec_id) as n, count(*) filter (loaded_at <= t) as begun,
    count(*) filter (loaded_at <= t and (withdrawn_at is null or withdrawn_at > t)) as valid from j group by all),
o as (select src_table, period, row_id, case when n = 0 then 'missing' when begun = 0 then 'late' else 'deleted' end as reason from a where valid = 0)
"""

_LAST = lambda c: f"nullif(lower(regexp_replace({c}, '[^A-Za-z]', '', 'g')), '')"
_P1M = f"""
with c as (select pack_id, {_ID.format(c="employee_id")} as id, {_LAST("employee_last_name")} as last, loaded_at, withdrawn_at from census where loaded_at is not null),
r as (select rec_id as row_id, period, pack_id, {_ID.format(c="client_employee_id")} as id, {_LAST("last_name")} as last, loaded_at as t from proposal where pack_id in (select pack_id from pack where id_scheme = 'shared')),
j as (
  select row_id, period, r.id, r.last, count(c.loaded_at) as n, count(*) filter (c.loaded_at <= t) as begun, count(*) filter (c.loaded_at <= t and (withdrawn_at is null or withdrawn_at > t)) as valid
  from r left join c on c.pack_id = r.pack_id and (r.id is null or c.id = r.id) and (r.last is null or c.last = r.last) group by all)
select row_id, period, concat_ws('+', 'pack', case when id is not null then 'id' end, case when last is not null then 'name' end) as known, case when n = 0 then 'missing' when begun = 0 then 'late' else 'deleted' end as reason from j where valid = 0
"""

_HEADERS = ", ".join(f"('{slot}', '{h}', '{f}')" for slot, own in SYNONYMS.items() for h, f in own.items())
_P4 = f"""
with syn(slot, plain, field) as (values {_HEADERS}),
f as (select file_id, series_id, slot, row_number() over (partition by series_id order by file_ord, file_id) as seq from upload_file where series_id is not null),
k as (select r.file_id, f.slot, series_id, seq, unnest(json_keys(cells)) as header, cells from upload_row r join f using (file_id)),
t as (select *, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) as plain, json_type(json_extract(cells, '$."' || header || '"')) as type from k),
s as (
  select series_id, seq, field, list_sort(list(distinct plain)) as headers, bool_or(type = 'VARCHAR') as is_text
  from t join syn using (slot, plain) group by all),
o as (
  select coalesce(a.series_id, b.series_id) as series_id, coalesce(a.seq + 1, b.seq) as seq, coalesce(a.field, b.field) as field,
    unnest(list_filter([
      case when a.seq is null then 'added' end, case when b.seq is null then 'removed' end,
      case when a.headers <> b.headers then 'renamed' end, case when a.is_text <> b.is_text then 'retyped' end], lambda x: x is not null)) as change
  from s a full join s b on a.series_id = b.series_id and a.seq + 1 = b.seq and a.field = b.field)
select f.file_id, o.field, o.change from o join f on o.series_id = f.series_id and o.seq = f.seq where o.seq > 1
"""

_FIELDS = list(dict.fromkeys([*CENSUS, *PROPOSAL]))
_UNIFIED = ", ".join(
    f"max(case when field = '{f}' and type = 'VARCHAR' then v end) as {f}__text, max(case when field = '{f}' and type <> 'VARCHAR' then try_cast(v as double) end) as {f}__number, max(case when field = '{f}' then try_cast(regexp_replace(v, '[$,\\s]', '', 'g') as double) end) as {f}"
    if f in NUMBERS
    else f"max(case when field = '{f}' then trim(v, ' ') end) as {f}"
    for f in _FIELDS
)
_P4U = _P4.split("s as (")[0].rstrip().rstrip(",") + f""",
u as (select file_id, row_ord, slot, field, type, json_extract_string(cells, '$."' || header || '"') as v from (
  select r.file_id, r.row_ord, k.slot, k.header, k.field, r.cells, json_type(json_extract(r.cells, '$."' || k.header || '"')) as type
  from upload_row r join (select distinct file_id, slot, header, field from t join syn using (slot, plain)) k using (file_id)) where type is not null and type <> 'NULL')
select file_id, row_ord, slot, {_UNIFIED} from u group by all
"""
_NUM = r"\d+(?:[.,'']\d+|[ \x{00A0}]\d{3}\b)*"
_PERIOD = lambda c: "case " + " ".join(f"when regexp_matches({c}, '{p}') then '{k}'" for k, p in units.PERIODS.items()) + " end"
_FREQ = lambda c: rf"case regexp_extract({c}, '^(?:paid )?(12|24|26|52|4|1)(?:\s+(?:pays?|cheques?|checks?|times?|periods?|pay periods)(?:\s+(?:a|per)\s+year)?)?$', 1) " + " ".join(f"when '{n}' then '{k}'" for k, n in units.PAYS.items()) + f" else nullif({_PERIOD(c)}, 'pay') end"
#: Periods per year and cents per unit of money, written out: what the graph composes.
_YEARLY = ", ".join(f"('{k}', {n})" for k, n in units.PAYS.items())
_P5 = rf"""
with yearly(per, pays) as (values {_YEARLY}), scales(scale, cents) as (values ('cent', 1), ('dollar', 100), ('thousand', 100000)),
r as (select s.*, lower(coalesce(value_text, '')) as v, lower(coalesce(unit_text, '')) as u, lower(coalesce(note, '')) as note from stated_amount s left join reading_source using (source_id)),
a as (select *, regexp_replace(v, '^.*?{_NUM}', '') as after, regexp_replace(regexp_extract(v, '{_NUM}'), '['' \x{{00A0}}]', '', 'g') as digits from r),
w as (select *, after || ' ' || u as words,
    case when contains(digits, ',') and contains(digits, '.') then case when instr(reverse(digits), ',') < instr(reverse(digits), '.') then replace(replace(digits, '.', ''), ',', '.') else replace(digits, ',', '') end
      when contains(digits, ',') then case when regexp_matches(digits, '^\d{{1,3}}(,\d{{3}})+$') or regexp_matches(digits, ',.*,') then replace(digits, ',', '') else replace(digits, ',', '.') end
      when regexp_matches(digits, '\..*\.') then replace(digits, '.', '') else digits end as plain from a),
x as (select *, regexp_matches(words, 'hour|/\s*hr|\bhrs?\b|\bh\b') as hourly, try_cast(regexp_extract(words, '(\d+(?:\.\d+)?)\s*(?:hours|hrs|hr|h)\b', 1) as decimal(10,4)) as hours,
    coalesce({_PERIOD("after")}, {_PERIOD("u")}) as said, {_FREQ("trim(lower(case when field = 'pay_frequency' then value_text else pay_frequency end))")} as pay from w),
y as (select *, case when hourly then case when regexp_matches(words, '(hours|hrs|hr|h)\b\s*(a|per|/)\s*y(ea)?r') then 'year' else 'week' end when said = 'pay' then pay else coalesce(said, case when field = 'gross_annual_taxable_wages' then 'year' else 'month' end) end as per,
    case when regexp_matches(words, '\bcents?\b|¢') then 'cent' when regexp_matches(after, '^\s*k\b|thousand|\$?000s') or regexp_matches(u, 'thousand|\bk\b|\$000') then 'thousand'
      when regexp_matches(v || ' ' || u, '\$|usd|dollar') then 'dollar' when regexp_matches(note, '\bcents\b') then 'cent' when regexp_matches(note, 'thousand|\$?000') then 'thousand' else 'dollar' end as scale,
    (try_cast(plain as decimal(20,4)) * case when hourly then hours else 1 end * case when regexp_matches(v, '^\s*\(.*\d.*\)') or regexp_matches(v, '^[^\d]*-\s*[$]?\s*\d') then -1 else 1 end * 100000000)::hugeint as n from x)
select reading_id, field, ((2::hugeint * n * cents * pays + 100000000::hugeint * d) // (200000000::hugeint * d))::bigint as common_value from (
  select *, case when field = 'gross_annual_taxable_wages' then 1 else 12 end as d from y join yearly using (per) join scales using (scale)
  where field in ('gross_annual_taxable_wages', 'employee_monthly_allotment') and n is not null and not contains(v || u, '#'))
union all select reading_id, field, pays::bigint from y join yearly on pay = yearly.per where field = 'pay_frequency'
"""

_P4A = _P4.split("s as (")[0].rstrip().rstrip(",") + """,
s as (select series_id, seq, field, list_sort(list(distinct case when type = 'VARCHAR' then 'text' when type = 'BOOLEAN' then 'boolean' when type = 'ARRAY' then 'list' when type = 'OBJECT' then 'object' else 'number' end)) as tags
  from t join syn using (slot, plain) where type <> 'NULL' group by all),
n as (select b.series_id, b.seq, b.field, unnest(list_filter(b.tags, lambda x: not list_contains(a.tags, x))) as alternative, array_to_string(a.tags, '|') as before from s a join s b on a.series_id = b.series_id and a.seq + 1 = b.seq and a.field = b.field)
select f.file_id, n.field, n.alternative, n.before from n join f on n.series_id = f.series_id and n.seq = f.seq
"""

SQL: dict[str, str] = columns.SQL | doubt.SQL | full.SQL | pages.SQL | reconcile.SQL | texts.SQL | reports.SQL | scalars.SQL | {
    "p4_found": _P4,
    "p4_unified": _P4U,
    "p4_alternatives": _P4A,
    "p1_partial": _P1M,
    "p5_found": _P5,
    "p1_found": _P1 + "select * from o",
    "p1_report": _P1 + "select src_table, period, reason, count(*) as n_refs from o group by all",
}
