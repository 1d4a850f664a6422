"""Queries over texts, events and uploads: registers, labels, windows, hashes, pages, estimates, streams."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions import money as m
from tieout.functions import text as t
from tieout.functions.headers import CENSUS, PROPOSAL
from tieout.functions.ids import same_id
from tieout.operators import controls, estimate, geometry, matching, ordered, roster
from tieout.operators.drift import cell_tags
from tieout.plans.lineage import ensure_checkpoint_dir
from tieout.queries import reconcile
from tieout.sources import registers
from tieout.sources.tables import table
from tieout.streaming import store


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "kind", "source", "n_chars")


def register_parse(spark: SparkSession, d: str) -> DataFrame:
    """Amount lines of printed registers under their owners."""
    return registers.register(_docs(spark, d))


def register_owners(spark: SparkSession, d: str) -> DataFrame:
    """Per owner of a register: lines, the sum, and gross less all else against the printed net."""
    r = register_parse(spark, d)
    out = r.groupBy("doc_id", "emp_ord", "name").agg(F.count("*").alias("n_lines"), controls.exact_sum(F.col("amount")).alias("total"), F.max(F.when(F.col("code") == "NET PAY", F.col("amount"))).alias("net"))
    return out


def code_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums by deduction code over all registers."""
    return register_parse(spark, d).groupBy("code").agg(F.count("*").alias("n"), controls.exact_sum(F.col("amount")).alias("amount"), F.max("to_date").alias("most"))


def page_facts(spark: SparkSession, d: str) -> DataFrame:
    """Period, identity tokens, labelled amounts and kind of every document."""
    x = F.col("text")
    return _docs(spark, d).where("text is not null").select("doc_id", t.period_of(x).alias("period"), F.array_join(t.identity_tokens(x), "|").alias("tokens"), t.label_amount(x, "NET PAY").alias("net"), t.label_amount(x, "GROSS PAY").alias("gross"))


def number_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose stated figures are all among those of the statement pages of their client, and how many aren't."""
    docs = table(spark, d, "documents").where("text is not null and client_code is not null")
    have = docs.where("kind = 'statement_page'").select("client_code", F.explode(t.figures(F.col("text"))).alias("figure")).distinct()
    said = docs.where("kind = 'helpdesk'").select("doc_id", "client_code", F.explode(t.figures(F.col("text"))).alias("figure"))
    known = said.join(have.withColumn("_in", F.lit(True)), ["client_code", "figure"], "left")
    return known.groupBy("doc_id").agg(F.count("*").alias("n_figures"), F.count_if(F.col("_in").isNull()).alias("unknown"))


def tightened(spark: SparkSession, d: str) -> DataFrame:
    """The lines worth a reader's budget, by length and digest."""
    x = t.tightened(F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.length(x).alias("n_kept"), F.md5(x).alias("digest"))


def folded_names(spark: SparkSession, d: str) -> DataFrame:
    """Printed names with letters that scans confuse made one."""
    return table(spark, d, "paycheck").select("rec_id", t.folded(F.col("name")).alias("folded"), t.match_key(F.col("name")).alias("match_key"), m.money(F.col("net_pay")).alias("net"))


def page_keys(spark: SparkSession, d: str) -> DataFrame:
    """Content keys of documents, and how many share one."""
    k = _docs(spark, d).select("doc_id", t.key_of(F.col("text"), F.col("kind")).alias("page_key"))
    return k.groupBy("page_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def near_pages(spark: SparkSession, d: str) -> DataFrame:
    """For each document the nearest of its kind by a hash of its words: at most two of 32 bits apart. Of every different
    word each bit of its digest has a vote; documents without words have no hash."""
    words = _docs(spark, d).where("kind is not null").select("doc_id", "kind", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).where("w <> ''")
    bits = words.withColumn("h", F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"))
    votes = bits.groupBy("doc_id", "kind").agg(*(F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{i}") for i in range(32)))
    whole = sum((F.when(F.col(f"b{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(1, 32)), F.when(F.col("b0") > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return matching.near_hashes(votes.select("doc_id", "kind", whole.alias("h")), ["kind"], "h", "doc_id", most=2, bits=32)


def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of a user that are no more than six hours apart."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("at", F.col("us") / 1e6)
    runs = ordered.island_numbers(e, F.col("at"), 6 * 3600.0, ["user_id"], ["at", "event_id"])
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.min("us").alias("begin_us"), F.max("us").alias("end_us"))


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the value of its user's last purchase up to it, and the types of the next three events."""
    e = table(spark, d, "events")
    out = e.select("event_id", ordered.carried(F.when(F.col("event_type") == "purchase", F.col("value")), ["user_id"], ["ts", "event_id"]).alias("last_purchase"), *(ordered.ahead(F.col("event_type"), n, ["user_id"], ["ts", "event_id"]).alias(f"next{n}") for n in (1, 2, 3)))
    return out


def moving_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean value of an event and five on either side of its user."""
    return table(spark, d, "events").select("event_id", F.round(ordered.smoothed(F.col("value"), 5, ["user_id"], ["ts", "event_id"]), 6).alias("mean"))


def top_gross(spark: SparkSession, d: str) -> DataFrame:
    """The 24 statements of greatest gross of each pack."""
    return ordered.top_rows(table(spark, d, "paycheck").select("pack_id", "rec_id", "gross").where("gross is not null"), ["pack_id"], [F.col("gross").desc(), F.col("rec_id")], 24)


def header_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The header of each file that every wanted field of its slot is taken from, and by which tier."""
    files = table(spark, d, "upload_file").select("file_id", "slot")
    cells = cell_tags(table(spark, d, "upload_row").select("file_id", "cells").join(files, "file_id"))
    heads = cells.select("file_id", "slot", "header").distinct().withColumn("hdr_ord", F.col("header"))
    own = [registers.map_headers(heads.where(F.col("slot") == slot).drop("slot"), ["file_id"], wanted) for slot, wanted in (("census", CENSUS), ("proposal", PROPOSAL))]
    return own[0].unionByName(own[1])


def order_controls(spark: SparkSession, d: str) -> DataFrame:
    """Line sums of each order against the order's own total."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    printed = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("price").alias("control"), F.col("o_totalprice").alias("printed"))
    return controls.control_totals(line, ["l_orderkey"], {"price": controls.exact_sum(F.col("l_extendedprice"))}, printed)


def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many statements of each run have each figure."""
    p = controls.unpivoted(table(spark, d, "paycheck"), ["run"], list(estimate.FIELDS))
    return p.groupBy("run", "field").agg(F.count("*").alias("n"), F.count_if(F.col("value") == 0).alias("zeros"))


def table_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Per pack, statements whose gross less deductions is net."""
    return geometry.coherence(table(spark, d, "paycheck").where("gross is not null and total_deductions is not null and net_pay is not null"), "gross", "total_deductions", "net_pay", ["pack_id"])


def evidence_systems(spark: SparkSession, d: str) -> DataFrame:
    """How often each system of evidence notices each kind of damage done to net pay."""
    p = table(spark, d, "paycheck").where("gross > 0 and total_deductions is not null and net_pay is not null and abs(gross - total_deductions - net_pay) <= 0.02").select("rec_id", "gross", "total_deductions", F.col("net_pay").alias("v"))
    bad = estimate.corrupted(p, "v")
    systems = {"present": F.col("bad").isNull(), "bounds": F.coalesce((F.col("bad") < 0.25 * F.col("gross")) | (F.col("bad") > F.col("gross")), F.lit(False)), "identity": F.coalesce(F.abs(F.col("gross") - F.col("total_deductions") - F.col("bad")) > 0.02, F.lit(False))}
    flags = F.array(*(F.struct(F.lit(k).alias("system"), c.alias("noticed")) for k, c in systems.items()))
    return bad.select("kind", F.explode(flags).alias("f")).groupBy("kind", "f.system").agg(F.count("*").alias("n"), F.count_if(F.col("f.noticed")).alias("noticed"))


def json_payload(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object per employee, as a service would return it."""
    e = reconcile.measures(spark, d)
    return e.select("pack_id", "id", F.to_json(F.struct("verdict", "n_runs", "comparable")).alias("payload"))


def fact_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The three worst gaps of each pack with what they come to in a year."""
    e = reconcile.measures(spark, d).where("gap is not null")
    return ordered.top_rows(e.select("pack_id", "id", "gap"), ["pack_id"], [F.col("gap"), F.col("id")], 3).withColumn("a_year", m.r2(F.col("gap") * 12))


def identity_solve(spark: SparkSession, d: str) -> DataFrame:
    """Weighted fits of all statements to their readings and identities; empty where under three figures were read."""
    return estimate.fits(table(spark, d, "paycheck"), "rec_id")


def monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    """Simulated intervals of the gap, for all employees with both net pays and a promise."""
    e = reconcile.pairs(spark, d, [*estimate.FIELDS, "product"]).where("b_net_pay is not null and a_net_pay is not null and promised is not null and pp > 0")
    e = estimate.doubted(e, ["pack_id", "id", "pp", "promised", "b_net_pay", "a_net_pay", "a_product"], ["b_", "a_"])
    return estimate.intervals(e, ["pack_id", "id"], "b_net_pay", "a_net_pay", "promised", estimate.READ_SD, extra="a_product", periods="pp", before_bad="b_bad", after_bad="a_bad")


def likely_reading(spark: SparkSession, d: str) -> DataFrame:
    """For figures that don't fit their statement or are off from the census, what was likeliest printed."""
    c = reconcile._census(spark, d).select("pack_id", "id", (F.col("gross_annual_taxable_wages") / F.col("pp")).alias("e_gross"), (F.col("retirement_401k_monthly") * 12 / F.col("pp")).alias("e_retirement"))
    p = table(spark, d, "paycheck").select("rec_id", "pack_id", same_id("employee_id").alias("id"), *estimate.FIELDS, *estimate.UNFITTED)
    return estimate.readings(p.join(c, ["pack_id", "id"], "left"), "rec_id", {"gross": ("e_gross", 10.0), "retirement": ("e_retirement", 2.0)})


def roster_adopt(spark: SparkSession, d: str) -> DataFrame:
    """Names on scanned registers taken from the census roster of their pack, each once a run."""
    at = (F.col("pack_id") * 2 + F.when(F.col("run") == "after", 1).otherwise(0)).alias("register")
    slips = table(spark, d, "paycheck").where("source like 'scanned%' and pack_id is not null and run is not null").select(at, F.col("rec_id").alias("ord"), "name")
    names = table(spark, d, "census").where("employee_last_name is not null and pack_id is not null").withColumn("run", F.explode(F.array(F.lit("before"), F.lit("after")))).select(at, F.col("rec_id").alias("ord"), F.concat_ws(" ", "employee_first_name", "employee_last_name").alias("name"))
    found = roster.adopted(slips, names.join(slips.select("register").distinct(), "register", "left_semi"), "register")
    return found.select(F.floor(F.col("register") / 2).cast("long").alias("pack_id"), F.when(F.pmod("register", F.lit(2)) == 1, "after").otherwise("before").alias("run"), "ord", "roster_ord", "score")


#: Labels of the statement pages.
LABELS = {"gross": r"gross pay", "federal": r"fed w/h", "medicare": r"medicare", "net_pay": r"net pay", "retirement": r"retirement", "fee": r"ee fee"}


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return geometry.words_of_text(_docs(spark, d).where("kind = 'statement_page'"))


def page_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of statement pages with their boxes."""
    return _pages(spark, d)


def page_bands(spark: SparkSession, d: str) -> DataFrame:
    """The row band of every word of a statement page."""
    return geometry.page_bands(_pages(spark, d))


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of statement pages, read by place, with the words they come from."""
    return geometry.page_fields(_pages(spark, d), LABELS)


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of statement pages by kind."""
    return geometry.table_rows(_pages(spark, d), ["employee", "gross", "net"])


def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type from a stream that ends with what is there: the windows that the watermark has closed."""
    # A stream reads folders or globs: this one is the table, whether it is a file or a folder of files.
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = store.windowed_totals(stream, "ts", "value", "event_type").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{base}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    "register_parse": register_parse, "register_owners": register_owners, "code_totals": code_totals, "page_facts": page_facts, "number_gate": number_gate, "text_tighten": tightened, "folded_names": folded_names, "page_keys": page_keys,
    "near_page_match": near_pages, "gap_islands": gap_islands, "forward_fill": forward_fill, "moving_mean": moving_mean, "top_rows": top_gross, "header_mapping": header_mapping, "order_controls": order_controls, "field_coverage": field_coverage,
    "table_coherence": table_coherence, "evidence_systems": evidence_systems, "json_payload": json_payload, "fact_sheet": fact_sheet, "identity_solve": identity_solve, "monte_carlo_interval": monte_carlo, "likely_reading": likely_reading,
    "roster_adopt": roster_adopt, "page_words": page_words, "row_bands": page_bands, "page_fields": page_fields, "table_rows": table_rows, "stream_totals": stream_totals,
}

_OWNER = registers.OWNER.replace("'", "''")
_AMT = registers.AMOUNTS
_LINES = "l as (select doc_id, unnest(range(0, len(a))) as line_no, unnest(a) as line from (select doc_id, string_split_regex(text, '\\r?\\n') as a from documents where text is not null))"
_REG = f"""
with {_LINES},
h as (select *, case when regexp_matches(line, '{_OWNER}') then line_no end as own, regexp_extract(line, '{_AMT}', 1) as code from l),
u as (select *, last_value(own ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as emp_ord from h where own is not null or code <> ''),
o as (select doc_id, line_no as emp_ord, regexp_extract(line, '{_OWNER}', 1) as name, regexp_extract(line, '{_OWNER}', 2) as id, regexp_extract(line, '{_OWNER}', 3) as period from h where own is not null),
r as (select doc_id, emp_ord, name, id, period, line_no, code, replace(regexp_extract(line, '{_AMT}', 2), ',', '')::double as amount, replace(regexp_extract(line, '{_AMT}', 3), ',', '')::double as to_date
  from u join o using (doc_id, emp_ord) where code <> '')
"""
_HDR = ", ".join(f"('{slot}', '{f}', {tier}, {i}, '{s}')" for slot, wanted in (("census", CENSUS), ("proposal", PROPOSAL)) for f, own in wanted.items() for tier, i, s in [(1, 0, f.replace("_", " ")), *((2, i, s) for i, s in enumerate(own))])
_SUM = "round(cast({x} as decimal(28,6)), 2)::double"
_LABEL = "try_cast(replace(regexp_extract(text, '(?im)^[^\\n]*?{label}[^\\n0-9]*?(-?\\d[\\d,]*\\.\\d{{2}})', 1), ',', '') as double)"
SQL = {
    "register_parse": _REG + "select * from r",
    "register_owners": _REG + "select doc_id, emp_ord, name, count(*) as n_lines, sum(amount::decimal(18,2))::double as total, max(amount) filter (code = 'NET PAY') as net from r group by all",
    "code_totals": _REG + "select code, count(*) as n, sum(amount::decimal(18,2))::double as amount, max(to_date) as most from r group by all",
    "text_tighten": "with " + _LINES + ", k as (select doc_id, substring(string_agg(line, chr(10) order by line_no), 1, 5000) as x from (select doc_id, unnest(range(0, len(a))) as line_no, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null)) where regexp_matches(line, '[0-9]') and length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3 group by all) select d.doc_id, length(coalesce(x, '')) as n_kept, md5(coalesce(x, '')) as digest from documents d left join k using (doc_id) where d.text is not null",
    "number_gate": "with f as (select doc_id, client_code, kind, unnest(list_distinct(list_transform(regexp_extract_all(text, '(\\d[\\d,]*\\.\\d{2})', 1), lambda x: replace(x, ',', '')))) as figure from documents where text is not null and client_code is not null), h as (select distinct client_code, figure from f where kind = 'statement_page') select doc_id, count(*) as n_figures, count(*) filter (h.figure is null) as unknown from f left join h using (client_code, figure) where kind = 'helpdesk' group by all",
    "page_keys": "select sha256(concat_ws(chr(31), coalesce(text, ''), coalesce(kind, ''))) as page_key, count(*) as n, min(doc_id) as first_doc from documents group by all",
    "page_facts": f"select doc_id, regexp_extract(text, '(?i)\\bperiod\\b[^0-9\\n]{{0,20}}(\\d{{1,2}}/\\d{{1,2}}(?:/\\d{{2,4}})?)', 1) as period, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '\\b(\\d{{4,9}})\\b', 1), regexp_extract_all(text, '\\b(\\d{{1,2}}/\\d{{1,2}}(?:/\\d{{2,4}})?)\\b', 1))))[1:8], '|') as tokens, {_LABEL.format(label='NET PAY')} as net, {_LABEL.format(label='GROSS PAY')} as gross from documents where text is not null",
    "folded_names": f"select rec_id, translate(replace(lower(name), 'rn', 'm'), '1it0d586q', 'llloosbgg') as folded, {reconcile._MATCHKEY} as match_key, case when net_pay is null then '-' else case when net_pay < 0 then '-$' else '$' end || format('{{:,.2f}}', abs(net_pay)) end as net from paycheck",
    "near_page_match": "with w as (select distinct doc_id, kind, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as w from documents where kind is not null and text is not null), g as (select doc_id, kind, ('0x' || substring(md5(w), 1, 8))::bigint as h from w where w <> ''), v as (select doc_id, kind, " + " + ".join(f"case when sum(((h >> {i}) & 1) * 2 - 1) > 0 then {1 << i} else 0 end" for i in range(32)) + " as h from g group by all), p as (select a.doc_id, b.doc_id as near_id, bit_count(xor(a.h::bigint, b.h::bigint))::int as distance from v a join v b on a.kind = b.kind and a.doc_id <> b.doc_id and bit_count(xor(a.h::bigint, b.h::bigint)) <= 2) select doc_id, arg_min(near_id, (distance, near_id)) as near_id, min(distance) as distance from p group by all",
    "gap_islands": "with e as (select *, epoch_us(ts) / 1e6 as sec from events), g as (select *, case when sec - lag(sec) over (partition by user_id order by sec, event_id) > 21600 then 1 else 0 end as new from e), i as (select *, sum(new) over (partition by user_id order by sec, event_id rows between unbounded preceding and current row)::int as island from g) select user_id, island, count(*) as n, min(event_id) as first_event, epoch_us(min(ts)) as begin_us, epoch_us(max(ts)) as end_us from i group by all",
    "forward_fill": "select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (w rows between unbounded preceding and current row) as last_purchase, lead(event_type, 1) over w as next1, lead(event_type, 2) over w as next2, lead(event_type, 3) over w as next3 from events window w as (partition by user_id order by ts, event_id)",
    "moving_mean": "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 5 following), 6) as mean from events",
    "top_rows": "select pack_id, rec_id, gross from (select *, row_number() over (partition by pack_id order by gross desc, rec_id) as n from paycheck where gross is not null) where n <= 24",
    "header_mapping": f"with syn(slot, field, tier, syn_ord, syn) as (values {_HDR}), h as (select distinct file_id, slot, unnest(json_keys(cells)) as header from upload_row join upload_file using (file_id)), n as (select *, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) as p from h), m as (select file_id, header, field, tier, syn_ord from n join syn on p = syn and n.slot = syn.slot union all select file_id, header, field, 3, syn_ord from n join syn on n.slot = syn.slot and p <> syn and tier = 2 and contains(' ' || p || ' ', ' ' || syn || ' ')) select file_id, field, arg_min(header, (tier, syn_ord, header)) as header, min(tier) as tier from m group by all",
    "order_controls": "select o_orderkey as l_orderkey, 'price' as control, sum(l_extendedprice::decimal(18,2))::double as parsed, o_totalprice as printed, coalesce(abs(sum(l_extendedprice::decimal(18,2))::double - o_totalprice) <= 0.01, false) as ok from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_totalprice",
    "field_coverage": "with u as (" + " union all ".join(f"select run, '{f}' as field, {f}::double as v from paycheck where {f} is not null" for f in estimate.FIELDS) + ") select run, field, count(*) as n, count(*) filter (v = 0) as zeros from u group by all",
    "table_coherence": f"with g as (select pack_id, abs(gross - total_deductions - net_pay) as gap from paycheck where gross is not null and total_deductions is not null and net_pay is not null) select pack_id, count(*) as n, count(*) filter (gap <= 0.02) as ties, max({_SUM.format(x='gap')}) as worst, count(*) >= 2 and count(*) filter (gap <= 0.02) >= greatest(2, floor(count(*) * 0.6)) as accepted from g group by all",
    "json_payload": reconcile._MEASURES + "select pack_id, id, '{\"verdict\":\"' || verdict || '\",\"n_runs\":' || n_runs || ',\"comparable\":' || comparable || '}' as payload from e",
    "fact_sheet": reconcile._MEASURES + f"select pack_id, id, gap, {reconcile._R2.format(x='(gap * 12)')} as a_year from (select *, row_number() over (partition by pack_id order by gap, id) as n from e where gap is not null) where n <= 3",
    "evidence_systems": "with p as (select gross, total_deductions as t, net_pay as v from paycheck where gross > 0 and abs(gross - total_deductions - net_pay) <= 0.02), b as (select gross, t, 'lost' as kind, null::double as bad from p union all select gross, t, 'tenfold', v * 10 from p union all select gross, t, 'digit', v + pow(10.0, floor(log10(greatest(abs(v), 0.01)))) from p union all select gross, t, 'sign', -v from p), f as (select kind, 'present' as system, bad is null as x from b union all select kind, 'bounds', coalesce(bad < 0.25 * gross or bad > gross, false) from b union all select kind, 'identity', coalesce(abs(gross - t - bad) > 0.02, false) from b) select kind, system, count(*) as n, count(*) filter (x) as noticed from f group by all",
    "stream_totals": "with w as (select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all) select strftime(start, '%Y-%m-%d') as day, event_type, n, total from w where start + interval '1 day' <= (select max(ts)::timestamp from events) - interval '1 hour'",
}
