"""Scalars, page tests, filters and tallies over the tables, each with its SQL twin."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions import money as m
from tieout.functions import text as t
from tieout.functions.ids import same_id
from tieout.operators import matching, ordered
from tieout.operators.drift import cell_tags
from tieout.queries.reconcile import _CENSUS, _ID, _MATCHKEY, _NAMEKEY, _R2
from tieout.sources import columns, registers
from tieout.sources.tables import table


#: Figures whose digits are compared between the runs.
DIGITS = ("gross", "federal", "medicare", "net_pay", "taxable_wages")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "client_code", "kind", "text")


def cell_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every different text cell of the uploads, read as a typed, a printed and a scanned amount."""
    cells = cell_tags(table(spark, d, "upload_row").select("cells")).where("tag = 'text'").select(F.col("value").alias("cell")).distinct()
    return cells.select("cell", m.number(F.col("cell")).alias("typed"), m.printed_amount(F.col("cell")).alias("printed"), m.first_cents(F.col("cell")).alias("scanned"))


def money_styles(spark: SparkSession, d: str) -> DataFrame:
    """Net pay in all styles of money, and the texts under which a scan may print gross."""
    p = table(spark, d, "paycheck").select("rec_id", "net_pay", "gross")
    net = F.col("net_pay")
    return p.select("rec_id", m.money(net).alias("dollars"), m.plain_money(net).alias("plain"), m.signed_money(net).alias("signed"), m.bracketed_money(net).alias("bracketed"), F.array_join(m.lost_comma(F.col("gross")), "|").alias("scanned"))


def misread_columns(spark: SparkSession, d: str) -> DataFrame:
    """Fees, premiums and products that repeat another figure of their statement taken out; taxable wages printed or
    derived; net pay by place (gross less deductions) before that in print, with a note where they differ."""
    p = table(spark, d, "paycheck")
    others = lambda c: [F.col(x) for x in ("premium", "reimbursement", "fee", "product", "retirement") if x != c]
    over = m.overridden(m.r2(F.col("gross") - F.col("total_deductions")), F.col("net_pay"))
    return p.select("rec_id", *(m.repeats_another(F.col(c), others(c)).alias(c) for c in ("fee", "premium", "product")), m.taxable_wages(F.col("taxable_wages"), F.col("medicare_gross"), F.col("retirement")).alias("taxable"), over["value"].alias("net"), over["note"].alias("note"))


def repaired_figures(spark: SparkSession, d: str) -> DataFrame:
    """Statements with gross anchored on the census and their figures checked against that gross; gated ones as they are."""
    c = table(spark, d, "census").select("pack_id", same_id("employee_id").alias("id"), "rec_id", t.pay_periods(F.col("pay_frequency")).alias("pp"), "gross_annual_taxable_wages")
    c = matching.last_wins(c, ["pack_id", "id"], ["rec_id"]).where("id is not null and pack_id is not null").select("pack_id", "id", (F.col("gross_annual_taxable_wages") / F.col("pp")).alias("anchor"))
    p = table(spark, d, "paycheck").select("rec_id", "pack_id", same_id("employee_id").alias("id"), F.coalesce("gated", F.lit(False)).alias("gated"), "gross", "federal", "medicare", "net_pay")
    new = m.repaired({k: F.col(k) for k in ("gross", "federal", "medicare", "net_pay")}, "gross", F.col("anchor"))
    return p.join(c, ["pack_id", "id"], "left").select("rec_id", *(F.when(F.col("gated"), F.col(k)).otherwise(v).alias(k) for k, v in new.items()))


def statement_texts(spark: SparkSession, d: str) -> DataFrame:
    """What each document states of person, W-4 and deposits, its kind and layout, and whether it can be read."""
    x = F.col("text")
    w, who = t.w4(x), t.person(x)
    return _docs(spark, d).select(
        "doc_id", who["name"].alias("name"), who["id"].alias("emp_id"), w["status"].alias("status"), w["multijob"].alias("multijob"), w["children"].alias("children"), w["extra"].alias("extra"), F.array_join(F.transform(t.deposits(x), lambda v: F.format_string("%.2f", v)), "|").alias("deposits"),
        registers.looks_like("text").alias("looks"), t.layout_of(F.substring_index(x, "\n", 1)).alias("layout"), t.readable(x).alias("readable"), t.reads_ok(x).alias("reads_ok"), t.compact_amount(x, "netpay").alias("net"),
    )


def line_amounts(spark: SparkSession, d: str) -> DataFrame:
    """The amount that belongs to a label of net pay or gross in every line that has one: behind it, else before it."""
    rows = registers.lines(_docs(spark, d).select("doc_id", "text"), "doc_id", "text").where(F.col("line").rlike("(?i)net pay|gross pay|total gross"))
    return rows.select("doc_id", F.col("line_no").cast("int").alias("line_no"), t.nearest_amount(F.col("line"), "net pay").alias("net"), t.nearest_amount(F.col("line"), "gross pay|total gross").alias("gross"))


def box_words(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document as one wide box cut into its words, each with its share of the width: words counted
    by document with the sums of their places, across and with the axes swapped."""
    rows = registers.lines(_docs(spark, d).select("doc_id", "text"), "doc_id", "text")
    words = rows.select("doc_id", "line_no", F.explode(t.wide_words(F.col("line"), F.lit(0.0), 6.0 * F.length("line"))).alias("w"))
    boxes = words.select("doc_id", F.col("w.x0").alias("x0"), F.col("w.x1").alias("x1"), (12.0 * F.col("line_no")).alias("y0"), (12.0 * F.col("line_no") + 10).alias("y1"))
    turned = boxes.select("doc_id", F.col("y0").alias("tx0"), F.col("x0").alias("ty0"), F.col("x0"), F.col("x1"))
    return turned.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.round("x0").cast("long")).alias("x0"), F.sum(F.round("x1").cast("long")).alias("x1"), F.max("tx0").alias("last_tx0"), F.max(F.round("ty0").cast("long")).alias("last_ty0"))


def event_paths(spark: SparkSession, d: str) -> DataFrame:
    """A value at a path of each event's JSON, from the JSON itself and from a text that has it somewhere."""
    e = table(spark, d, "events").select("event_id", "props")
    return e.select("event_id", t.at_path(F.col("props"), "k").alias("k"), t.json_of(F.concat(F.lit("the model says "), "props", F.lit(" and so on")), "k string")["k"].alias("found"))


def junk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Statements that are no person's: net pay over five times the median of the pack, a net without an id that another
    row of the pack has too, a row with neither name nor id nor net, or a name that is a total's without an id."""
    p = table(spark, d, "paycheck").where("pack_id is not null").select("rec_id", "pack_id", same_id("employee_id").alias("id"), "name", "net_pay")
    middle = p.groupBy("pack_id").agg(F.median("net_pay").alias("middle"))
    often = p.where("net_pay is not null").groupBy("pack_id", F.col("net_pay").alias("_net")).agg(F.count("*").alias("n"))
    at = p.join(middle, "pack_id").join(often.withColumnRenamed("pack_id", "_pack"), (F.col("pack_id") == F.col("_pack")) & (F.col("net_pay") == F.col("_net")), "left")
    blank = F.coalesce(F.trim("name") == "", F.lit(True))
    why = F.when(F.col("net_pay") > 5 * F.col("middle"), "high").when((F.col("n") > 1) & F.col("id").isNull(), "repeated").when(blank & F.col("id").isNull() & F.col("net_pay").isNull(), "empty").when(F.col("id").isNull() & F.lower("name").rlike("total|average|report"), "words")
    return at.select("rec_id", why.alias("why")).where("why is not null")


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of one type of a user, and the blocks that purchases end."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    r = ordered.blocks(ordered.runs(e, F.col("event_type"), ["user_id"], ["ts", "event_id"]).withColumn("at", F.struct("ts", "event_id")), F.col("event_type") == "purchase", ["user_id"], "at")
    return r.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("block").alias("block"))


def digit_confusions(spark: SparkSession, d: str) -> DataFrame:
    """Which digit stands for which where a figure of an employee differs between the runs in one place alone: per digit
    the four most frequent, of equals the smallest."""
    s = table(spark, d, "paycheck").select("pack_id", same_id("employee_id").alias("id"), "run", "rec_id", *DIGITS)
    one = lambda run: matching.first_wins(s.where(F.col("run") == run).drop("run"), ["pack_id", "id"], ["rec_id"]).select("pack_id", "id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.format_string("%.2f", c).alias("v")) for c in DIGITS))).alias("x")).select("pack_id", "id", "x.field", F.col("x.v").alias(run[0]))
    both = one("before").join(one("after"), ["pack_id", "id", "field"]).where("length(b) = length(a) and a <> b and a <> 'null' and b <> 'null'")
    differ = F.filter(F.transform(F.sequence(F.lit(1), F.length("b")), lambda i: F.struct(F.substring(F.col("b"), i, F.lit(1)).alias("was"), F.substring(F.col("a"), i, F.lit(1)).alias("now"))), lambda x: x["was"] != x["now"])
    n = both.select(differ.alias("x")).where("size(x) = 1").select(F.col("x")[0]["was"].alias("was"), F.col("x")[0]["now"].alias("now")).groupBy("was", "now").agg(F.count("*").alias("n"))
    return ordered.top_rows(n, ["was"], [F.col("n").desc(), F.col("now")], 4).select("was", "now", "n")


def roster_union(spark: SparkSession, d: str) -> DataFrame:
    """The people of a pack by all its sources: one row for each name, and in how many sources it stands."""
    c = table(spark, d, "census").select("pack_id", t.name_key(F.col("employee_first_name"), F.col("employee_last_name")).alias("k"), F.lit("c").alias("s"))
    p = table(spark, d, "proposal").select("pack_id", t.name_key(F.col("first_name"), F.col("last_name")).alias("k"), F.lit("p").alias("s"))
    s = table(spark, d, "paycheck").where("name is not null").select("pack_id", t.match_key(F.col("name")).alias("k"), F.lit("s").alias("s"))
    return c.unionByName(p).unionByName(s).where("k <> '' and pack_id is not null").groupBy("pack_id", F.col("k").alias("name")).agg(F.count_distinct("s").alias("n_sources"), F.count("*").alias("n_rows"))


def upload_slots(spark: SparkSession, d: str) -> DataFrame:
    """Uploads by the slot that their name says against the slot that they are in."""
    f = table(spark, d, "upload_file").select("slot", F.coalesce(t.slot_of(F.col("file_name")), F.lit("unknown")).alias("named"))
    return f.groupBy("slot", "named").agg(F.count("*").alias("n"))


def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of every kind of document how many there are, without repeats, and the share that reads like a statement."""
    k = _docs(spark, d).select(F.coalesce("kind", F.lit("")).alias("kind"), F.md5("text").alias("h"), t.reads_ok(F.col("text")).alias("ok")).groupBy("kind", "h").agg(F.max("ok").alias("ok"))
    return k.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok")).withColumn("rate", F.round(F.col("n_ok") / F.col("n"), 6))


def best_angle(spark: SparkSession, d: str) -> DataFrame:
    """The angle of greatest score of each page, of equals the first, accepted from a score of 18 on: users as pages,
    types of events as angles, values as scores."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("score"))
    best = e.groupBy("user_id").agg(F.max("score").alias("top"), F.min(F.struct((-F.col("score")).alias("s"), "event_type")).alias("x"))
    return best.select("user_id", F.col("x.event_type").alias("angle"), "top", F.coalesce(F.col("top") >= 18, F.lit(False)).alias("accepted"))


def employee_codes(spark: SparkSession, d: str) -> DataFrame:
    """Employee codes and names of statements in the forms by which registers join them."""
    p = table(spark, d, "paycheck").select("rec_id", "employee_id", "name")
    code = columns.norm_code(F.col("employee_id"))
    return p.select("rec_id", code["code"].alias("code"), code["seq"].alias("seq"), columns.census_key(F.col("name")).alias("census_key"), t.titled(F.col("name")).alias("titled"), t.filled("Ask {who} about {what}", {"who": F.col("name"), "what": F.col("employee_id")}).alias("asked"))


QUERIES = {
    "cell_amounts": cell_amounts, "money_styles": money_styles, "misread_columns": misread_columns, "repaired_figures": repaired_figures, "statement_texts": statement_texts, "line_amounts": line_amounts, "box_words": box_words, "event_paths": event_paths,
    "junk_rows": junk_rows, "event_runs": event_runs, "digit_confusions": digit_confusions, "roster_union": roster_union, "upload_slots": upload_slots, "pass_rates": pass_rates, "best_angle": best_angle, "employee_codes": employee_codes,
}

_F = lambda x: f"format('{{:,.2f}}', {x})"
_OTHERS = lambda c: [x for x in ("premium", "reimbursement", "fee", "product", "retirement") if x != c]
_UNLESS = lambda c: f"case when abs({c}) <= 0.02 or not (" + " or ".join(f"coalesce(abs(abs({o}) - abs({c})) <= 0.02::double, false)" for o in _OTHERS(c)) + f") then {c} end"
_ANCHORED = "case when anchor is not null and anchor <> 0 and (gross is null or abs(gross - anchor) > greatest(1.0::double, anchor * 0.02::double)) then " + _R2.format(x="anchor") + " else gross end"
_BOUND = lambda k: f"case when g is null or g <= 0 or {k} < 0 or (abs({k}) >= g * {m.PLAUSIBLE[k][0]}::double - 0.01::double and abs({k}) <= g * {m.PLAUSIBLE[k][1]}::double + 0.01::double) then {k} end"
_READS = r"len(regexp_extract_all(text, '[A-Za-z]{3,}')) >= 15 and len(regexp_extract_all(text, '\d[\d,]*\.\d{2}')) >= 3"
_PSEUDO = "lower(trim(coalesce({c}, ''))) not in ('total', 'totals', 'monthly average', 'average')"
SQL = {
    "driving_rows": f"with p as (select pack_id, count(*) as n_proposal, count(distinct {_NAMEKEY('first_name', 'last_name')}) as n_names from proposal where {_PSEUDO.format(c='first_name')} group by all), c as (select pack_id, count(*) as n_census from census where {_PSEUDO.format(c='employee_last_name')} group by all) select coalesce(c.pack_id, p.pack_id) as pack_id, case when coalesce(n_proposal, 0) > 0 then 'proposal' else 'census' end as driving, case when coalesce(n_proposal, 0) > 0 then n_proposal else coalesce(n_census, 0) end as n_rows, coalesce(n_names, 0) as n_names from c full join p on c.pack_id = p.pack_id",
    "money_styles": f"select rec_id, case when net_pay is null then '-' else case when net_pay < 0 then '-$' else '$' end || {_F('abs(net_pay)')} end as dollars, coalesce({_F('net_pay')}, '') as plain, case when net_pay is null then '-' else case when net_pay < 0 then '-$' else '+$' end || {_F('abs(net_pay)')} end as signed, case when net_pay is null then '-' when net_pay < 0 then '($' || {_F('abs(net_pay)')} || ')' else '$' || {_F('abs(net_pay)')} end as bracketed, "
    + f"case when gross is null then null when abs(gross) < 1000 then {_F('gross')} else concat_ws('|', {_F('gross')}, format('{{:.2f}}', gross), replace({_F('gross')}, ',', '.'), replace({_F('gross')}, ',', ' ')) end as scanned from paycheck",
    "misread_columns": f"select rec_id, {_UNLESS('fee')} as fee, {_UNLESS('premium')} as premium, {_UNLESS('product')} as product, coalesce(taxable_wages, {_R2.format(x='(medicare_gross - coalesce(retirement, 0.0))')}) as taxable, coalesce({_R2.format(x='(gross - total_deductions)')}, net_pay) as net, case when abs({_R2.format(x='(gross - total_deductions)')} - net_pay) > 0.02::double then {_F('net_pay')} || ' -> ' || {_F(_R2.format(x='(gross - total_deductions)'))} end as note from paycheck",
    "repaired_figures": f"with {_CENSUS}, j as (select p.rec_id, coalesce(gated, false) as gated, gross, federal, medicare, net_pay, c.g / c.pp as anchor from (select *, {_ID.format(c='employee_id')} as id from paycheck) p left join c on p.pack_id = c.pack_id and p.id = c.id), a as (select *, {_ANCHORED} as g from j) select rec_id, case when gated then gross else g end as gross, "
    + ", ".join(f"case when gated then {k} else {_BOUND(k)} end as {k}" for k in ("federal", "medicare", "net_pay")) + " from a",
    "line_amounts": r"""with l as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) - 1 as line_no from documents where text is not null),
k as (select * from l where regexp_matches(line, '(?i)net pay|gross pay|total gross'))
select doc_id, line_no::int as line_no, """ + ", ".join(rf"case when regexp_matches(line, '(?i){p}') then try_cast(replace(coalesce(nullif(regexp_extract(regexp_extract(line, '(?i)^.*?(?:{p})(.*)$', 1), '(-?\d[\d,]*\.\d{{2}})', 1), ''), nullif(regexp_extract(regexp_extract(line, '(?i)^(.*?)(?:{p})', 1), '^.*?(-?\d[\d,]*\.\d{{2}})[^0-9]*$', 1), '')), ',', '') as double) end as {n}" for p, n in (("net pay", "net"), ("gross pay|total gross", "gross"))) + " from k",
    "event_paths": "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.k') as found from events",
    "junk_rows": f"with p as (select rec_id, pack_id, {_ID.format(c='employee_id')} as id, name, net_pay from paycheck where pack_id is not null), k as (select pack_id, median(net_pay) as middle from p group by all), o as (select pack_id, net_pay, count(*) as n from p where net_pay is not null group by all), a as (select p.*, middle, n from p join k using (pack_id) left join o on o.pack_id = p.pack_id and o.net_pay = p.net_pay), w as (select rec_id, case when net_pay > 5 * middle then 'high' when n > 1 and id is null then 'repeated' when coalesce(trim(name) = '', true) and id is null and net_pay is null then 'empty' when id is null and regexp_matches(lower(name), 'total|average|report') then 'words' end as why from a) from w where why is not null",
    "event_runs": "with a as (select *, row_number() over w as n, lag(event_type) over w as before, coalesce(sum((event_type = 'purchase')::int) over (w rows between unbounded preceding and 1 preceding), 0) as block from events window w as (partition by user_id order by ts, event_id)), r as (select *, sum(case when n = 1 or event_type is distinct from before then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from a) select user_id, run::bigint as run, first(event_type) as event_type, count(*) as n, coalesce(min(block), 0)::bigint as block from r group by user_id, run",
    "digit_confusions": f"with s as (select *, {_ID.format(c='employee_id')} as id from paycheck), f as (select * from (select *, row_number() over (partition by pack_id, id, run order by rec_id) as n from s where id is not null and pack_id is not null) where n = 1), u as (" + " union all ".join(f"select pack_id, id, run, '{c}' as field, format('{{:.2f}}', {c}) as v from f where {c} is not null" for c in DIGITS)
    + "), j as (select row_number() over () as k, b.v as b, a.v as a from u b join u a using (pack_id, id, field) where b.run = 'before' and a.run = 'after' and length(a.v) = length(b.v) and a.v <> b.v), c as (select k, substring(b, i::int, 1) as was, substring(a, i::int, 1) as now from (select *, unnest(range(1, length(b) + 1)) as i from j)), o as (select k, min(was) as was, min(now) as now from c where was <> now group by k having count(*) = 1), n as (select was, now, count(*) as n from o group by all) select was, now, n from (select *, row_number() over (partition by was order by n desc, now) as r from n) where r <= 4",
    "roster_union": f"with u as (select pack_id, {_NAMEKEY('employee_first_name', 'employee_last_name')} as name, 'c' as s from census union all select pack_id, {_NAMEKEY('first_name', 'last_name')}, 'p' from proposal union all select pack_id, {_MATCHKEY}, 's' from paycheck where name is not null) select pack_id, name, count(distinct s) as n_sources, count(*) as n_rows from u where name <> '' and pack_id is not null group by all",
    "upload_slots": "select slot, case when contains(lower(file_name), 'census') then 'census' when contains(lower(file_name), 'proposal') or contains(lower(file_name), 'report') then 'proposal' when contains(lower(file_name), 'before') or contains(lower(file_name), 'previous') then 'before' when contains(lower(file_name), 'after') or contains(lower(file_name), 'mock') then 'after' else 'unknown' end as named, count(*) as n from upload_file group by all",
    "pass_rates": f"with k as (select coalesce(kind, '') as kind, md5(text) as h, bool_or({_READS}) as ok from documents where text is not null group by all) select kind, count(*) as n, count(*) filter (ok) as n_ok, round(count(*) filter (ok) / count(*), 6) as rate from k group by all",
    "best_angle": "with e as (select user_id, event_type, max(value) as score from events group by all), r as (select *, row_number() over (partition by user_id order by score desc nulls first, event_type) as n, max(score) over (partition by user_id) as top from e) select user_id, event_type as angle, top, coalesce(top >= 18, false) as accepted from r where n = 1",
    "employee_codes": r"select rec_id, substring(regexp_extract(regexp_replace(upper(employee_id), '[^A-Z0-9]', '', 'g'), '^([A-Z]*)', 1), 1, 8) as code, regexp_extract(regexp_replace(upper(employee_id), '[^A-Z0-9]', '', 'g'), '(\d*)$', 1) as seq, substring(regexp_replace(upper(string_split(name, ',')[1]), '[^A-Z]', '', 'g'), 1, 5) || substring(case when contains(name, ',') then regexp_replace(upper(regexp_extract(name, '^[^,]*,(.*)$', 1)), '[^A-Z]', '', 'g') else '' end, 1, 3) as census_key, "
    + "array_to_string(list_transform(string_split(name, ' '), lambda w: case when regexp_matches(w, '^[A-Z]{2,3}$') then w else upper(w[1]) || lower(w[2:]) end), ' ') as titled, 'Ask ' || coalesce(name, '') || ' about ' || coalesce(employee_id, '') as asked from paycheck",
}
