"""The measures of a reconciliation in full, what they leave unexplained, and the report rows and tallies over them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions import money as m
from tieout.functions import text as t
from tieout.functions.ids import same_id
from tieout.operators import controls, matching, ordered
from tieout.queries.reconcile import _ID, _PER, _PP, _R2
from tieout.sources.tables import table

RUN = ("gross", "net_pay", "federal", "state", "local", "social_security", "medicare", "product", "fee", "premium", "reimbursement", "taxable_wages", "medicare_gross", "cafeteria", "supplemental")
PROMISE = {"federal_savings": "e_federal", "state_savings": "e_state", "social_security_savings": "e_ss", "medicare_savings": "e_med", "ee_monthly_fee": "e_fee", "ee_gross_monthly_savings": "e_savings", "employee_monthly_allotment": "e_allotment", "taxable_income_before": "e_before", "wellness_program": "e_premium"}
CENSUS = {"employee_last_name": "c_last", "group_health_monthly": "c_health", "other_monthly_pretax": "c_other", "retirement_401k_monthly": "c_retirement", "census_socialsec": "c_ss", "census_medicare": "c_med", "state": "c_state"}
#: The greatest share of a wrongly counted dollar that each tax can explain.
FEDERAL_SHARE, STATE_SHARE, SS_SHARE, MEDICARE_SHARE, FICA_SHARE = 0.37, 0.10, 0.062, 0.0145, 0.0765


def wide(spark: SparkSession, d: str, statements: DataFrame | None = None) -> DataFrame:
    """One row per census employee: the last census row, the first proposal row and the first statement of each run, of
    ``statements`` where they are given (paycheck, corrected)."""
    c = table(spark, d, "census").select("pack_id", same_id("employee_id").alias("id"), "rec_id", t.pay_periods(F.col("pay_frequency")).alias("pp"), *(F.col(k).alias(v) for k, v in CENSUS.items()))
    out = matching.last_wins(c, ["pack_id", "id"], ["rec_id"]).where("id is not null and pack_id is not null").drop("position", "rec_id")
    p = table(spark, d, "proposal").select("pack_id", same_id("client_employee_id").alias("id"), "rec_id", *(F.col(k).alias(v) for k, v in PROMISE.items()))
    out = out.join(matching.first_wins(p, ["pack_id", "id"], ["rec_id"]).withColumnRenamed("rec_id", "e_rec"), ["pack_id", "id"], "left")
    s = (table(spark, d, "paycheck") if statements is None else statements).select("pack_id", same_id("employee_id").alias("id"), "run", "rec_id", *RUN)
    for run in ("before", "after"):
        one = matching.first_wins(s.where(F.col("run") == run).drop("run"), ["pack_id", "id"], ["rec_id"])
        out = out.join(one.select("pack_id", "id", *(F.col(k).alias(f"{run[0]}_{k}") for k in ("rec_id", *RUN))), ["pack_id", "id"], "left")
    return out


def z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def measures_full(spark: SparkSession, d: str, statements: DataFrame | None = None) -> DataFrame:
    """Every measure of an employee, per month: what payroll saved, charged and paid out, what the proposal said, and the
    gaps between. A measure is null where a figure that it needs isn't there."""
    e = wide(spark, d, statements)
    per = lambda x: m.per_month(x, F.col("pp"))
    saved = lambda k: per(F.col(f"b_{k}") - F.col(f"a_{k}"))
    fica = F.when(F.col("b_social_security").isNotNull() | F.col("b_medicare").isNotNull(), per((z("b_social_security") + z("b_medicare")) - (z("a_social_security") + z("a_medicare"))))
    e = e.withColumns(
        {
            "federal_saved": saved("federal"), "state_saved": saved("state"), "local_saved": saved("local"), "fica_saved": fica,
            "fee_paid": F.when(F.col("a_fee").isNotNull(), per(F.col("a_fee"))).otherwise(F.col("e_fee")), "fee_from_statement": F.col("a_fee").isNotNull(),
            "gross_change": per(F.col("a_gross") - F.col("b_gross")), "net_change": per((F.col("a_net_pay") - F.col("b_net_pay")) + z("a_product")),
        }
    )
    parts = ("federal_saved", "state_saved", "fica_saved", "local_saved")
    any_part = F.coalesce(*(F.col(p) for p in parts)).isNotNull()
    expected = F.when(any_part & F.col("fee_paid").isNotNull(), m.r2(z(parts[0]) + z(parts[1]) + z(parts[2]) + z(parts[3]) - F.col("fee_paid")))
    e = e.withColumn("comparable", F.coalesce(F.abs("gross_change") <= 1.0, F.lit(True))).withColumn("expected_change", expected)
    saving = F.when(F.col("e_savings").isNotNull(), F.col("e_savings")).when(F.coalesce("e_federal", "e_state", "e_ss", "e_med").isNotNull(), z("e_federal") + z("e_state") + z("e_ss") + z("e_med"))
    over = m.r2(F.col("e_fee") - saving)
    return e.withColumns(
        {
            "identity_gap": m.r2(F.col("net_change") - F.col("expected_change")), "allotment_gap": m.r2(F.col("net_change") - F.col("e_allotment")),
            "federal_gap": m.r2(F.col("federal_saved") - F.col("e_federal")), "state_gap": m.r2(F.col("state_saved") - F.col("e_state")), "local_gap": F.col("local_saved"),
            "fica_gap": F.when(F.col("e_ss").isNotNull() | F.col("e_med").isNotNull(), m.r2(F.col("fica_saved") - (z("e_ss") + z("e_med")))),
            "census_pretax": m.r2(z("c_other") + z("c_health") + z("c_retirement")), "cafeteria": per(F.col("b_cafeteria")),
            "retirement_missing": m.r2(per(F.col("b_medicare_gross") - F.col("b_taxable_wages")) - z("c_retirement")), "income_gap": m.r2(F.col("e_before") - per(F.col("b_medicare_gross"))),
            "fee_over": F.when((over > 0.02) & (F.col("e_fee") > 0), over),
        }
    )


MEASURES = ["federal_saved", "state_saved", "local_saved", "fica_saved", "fee_paid", "fee_from_statement", "gross_change", "comparable", "net_change", "expected_change", "identity_gap", "allotment_gap", "federal_gap", "state_gap", "local_gap", "fica_gap", "census_pretax", "cafeteria", "retirement_missing", "income_gap", "fee_over"]


def measures_all(spark: SparkSession, d: str) -> DataFrame:
    """``measures_full``, the measures alone."""
    return measures_full(spark, d).select("pack_id", "id", *MEASURES)


_FIRST = lambda src, cols, where="true": f"select * from (select pack_id, rec_id, {cols}, row_number() over (partition by pack_id, {{id}} order by rec_id) as n, {{id}} as id from {src} where {where}) where n = 1 and id is not null and pack_id is not null"
_WIDE = f"""
with c as (select * from (select *, row_number() over (partition by pack_id, id order by rec_id desc) as n from (select pack_id, rec_id, {_ID.format(c="employee_id")} as id, {_PP} as pp, {", ".join(f"{k} as {v}" for k, v in CENSUS.items())} from census) where id is not null and pack_id is not null) where n = 1),
p as ({_FIRST("proposal", ", ".join(f"{k} as {v}" for k, v in PROMISE.items())).format(id=_ID.format(c="client_employee_id"))}),
{", ".join(f"{r[0]} as ({_FIRST('paycheck', ', '.join(f'{k} as {r[0]}_{k}' for k in RUN), f"run = '{r}'").format(id=_ID.format(c='employee_id'))})" for r in ("before", "after"))},
w as (select c.pack_id, c.id, c.pp, {", ".join(CENSUS.values())}, p.rec_id as e_rec, {", ".join(PROMISE.values())}, b.rec_id as b_rec_id, a.rec_id as a_rec_id, {", ".join(f"{r}_{k}" for r in "ba" for k in RUN)}
  from c left join p on p.pack_id = c.pack_id and p.id = c.id left join b on b.pack_id = c.pack_id and b.id = c.id left join a on a.pack_id = c.pack_id and a.id = c.id),
x as (select *, {_PER("b_federal - a_federal")} as federal_saved, {_PER("b_state - a_state")} as state_saved, {_PER("b_local - a_local")} as local_saved,
    case when b_social_security is not null or b_medicare is not null then {_PER("(coalesce(b_social_security, 0.0) + coalesce(b_medicare, 0.0)) - (coalesce(a_social_security, 0.0) + coalesce(a_medicare, 0.0))")} end as fica_saved,
    case when a_fee is not null then {_PER("a_fee")} else e_fee end as fee_paid, a_fee is not null as fee_from_statement,
    {_PER("a_gross - b_gross")} as gross_change, {_PER("(a_net_pay - b_net_pay) + coalesce(a_product, 0.0)")} as net_change from w),
y as (select *, coalesce(abs(gross_change) <= 1.0, true) as comparable,
    case when coalesce(federal_saved, state_saved, fica_saved, local_saved) is not null and fee_paid is not null then {_R2.format(x="(coalesce(federal_saved, 0.0) + coalesce(state_saved, 0.0) + coalesce(fica_saved, 0.0) + coalesce(local_saved, 0.0) - fee_paid)")} end as expected_change,
    {_R2.format(x="(e_fee - case when e_savings is not null then e_savings when coalesce(e_federal, e_state, e_ss, e_med) is not null then coalesce(e_federal, 0.0) + coalesce(e_state, 0.0) + coalesce(e_ss, 0.0) + coalesce(e_med, 0.0) end)")} as over from x),
e as (select *, {_R2.format(x="(net_change - expected_change)")} as identity_gap, {_R2.format(x="(net_change - e_allotment)")} as allotment_gap, {_R2.format(x="(federal_saved - e_federal)")} as federal_gap, {_R2.format(x="(state_saved - e_state)")} as state_gap, local_saved as local_gap,
    case when e_ss is not null or e_med is not null then {_R2.format(x="(fica_saved - (coalesce(e_ss, 0.0) + coalesce(e_med, 0.0)))")} end as fica_gap,
    {_R2.format(x="(coalesce(c_other, 0.0) + coalesce(c_health, 0.0) + coalesce(c_retirement, 0.0))")} as census_pretax, {_PER("b_cafeteria")} as cafeteria,
    {_R2.format(x=f"({_PER('b_medicare_gross - b_taxable_wages')} - coalesce(c_retirement, 0.0))")} as retirement_missing, {_R2.format(x=f"(e_before - {_PER('b_medicare_gross')})")} as income_gap,
    case when over > 0.02 and e_fee > 0 then over end as fee_over from y)
"""


def residuals(spark: SparkSession, d: str) -> DataFrame:
    """What each tax's gap leaves unexplained once the income that the census lacks or has in the wrong column, a saving
    beyond the tax that is there, and settings that the census leaves open are taken off at their greatest share."""
    e = measures_full(spark, d)
    missing = F.greatest(z("retirement_missing"), F.lit(0.0)) + F.greatest(z("income_gap"), F.lit(0.0))
    wrong = F.when((F.col("income_gap") < -1) & (F.col("c_other") >= F.abs("income_gap") - 0.02), F.abs("income_gap")).otherwise(0.0)
    ceiling = F.when((F.col("a_federal") == 0) & (F.col("b_federal") != 0), F.greatest(F.coalesce(F.col("e_federal") - m.per_month(F.col("b_federal"), F.col("pp")), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    open_ = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    fica = F.when(open_("c_ss"), F.lit(SS_SHARE) * z("e_premium")).otherwise(0.0) + F.when(open_("c_med"), F.lit(MEDICARE_SHARE) * z("e_premium")).otherwise(0.0) + F.lit(FICA_SHARE) * F.col("wrong")
    e = e.withColumns({"missing": missing, "wrong": wrong, "ceiling": ceiling})
    left = lambda gap, said: F.greatest(F.lit(0.0), m.r2(F.abs(gap) - said))
    rest = lambda gap, said: F.when(F.col(gap).isNotNull(), left(gap, said))
    return e.select(
        "pack_id", "id", rest("federal_gap", F.lit(FEDERAL_SHARE) * (F.col("missing") + F.col("wrong")) + F.col("ceiling")).alias("federal_rest"),
        rest("state_gap", F.lit(STATE_SHARE) * (F.col("missing") + F.col("wrong"))).alias("state_rest"), rest("fica_gap", fica).alias("fica_rest"), F.coalesce(F.abs("identity_gap") > 2, F.lit(False)).alias("identity_broken"),
    )


_RESIDUALS = _WIDE + f""", k as (select *, greatest(coalesce(retirement_missing, 0.0), 0.0) + greatest(coalesce(income_gap, 0.0), 0.0) as missing,
    case when income_gap < -1 and c_other >= abs(income_gap) - 0.02::double then abs(income_gap) else 0.0 end as wrong,
    case when a_federal = 0 and b_federal <> 0 then greatest(coalesce(e_federal - {_PER("b_federal")}, 0.0), 0.0) else 0.0 end as ceiling from e)
select pack_id, id, case when federal_gap is not null then greatest(0.0, {_R2.format(x="(abs(federal_gap) - (0.37::double * (missing + wrong) + ceiling))")}) end as federal_rest,
  case when state_gap is not null then greatest(0.0, {_R2.format(x="(abs(state_gap) - 0.10::double * (missing + wrong))")}) end as state_rest,
  case when fica_gap is not null then greatest(0.0, {_R2.format(x="(abs(fica_gap) - (case when coalesce(trim(c_ss) = '', true) then 0.062::double * coalesce(e_premium, 0.0) else 0.0 end + case when coalesce(trim(c_med) = '', true) then 0.0145::double * coalesce(e_premium, 0.0) else 0.0 end + 0.0765::double * wrong))")}) end as fica_rest,
  coalesce(abs(identity_gap) > 2, false) as identity_broken from k
"""

#: line, proposal column, payroll column.
LINES = (("federal", "e_federal", "federal_saved"), ("state", "e_state", "state_saved"), ("fica", "e_fica", "fica_saved"), ("local", "e_local", "local_saved"), ("fee", "e_fee", "fee_paid"), ("premium", "e_premium", "a_premium_m"), ("income before", "e_before", "b_income_m"), ("net change", "e_allotment", "net_change"))


def proposal_lines(spark: SparkSession, d: str) -> DataFrame:
    """Proposal against payroll, line by line: lines that neither has are left out, a difference stands where both have
    one; the local line is there only where payroll has one, as proposals have none."""
    per = lambda c: m.per_month(F.col(c), F.col("pp"))
    e = measures_full(spark, d).withColumns({"e_fica": F.when(F.coalesce("e_ss", "e_med").isNotNull(), m.r2(z("e_ss") + z("e_med"))), "e_local": F.lit(None).cast("double"), "a_premium_m": per("a_premium"), "b_income_m": per("b_medicare_gross")})
    lines = F.array(*(F.struct(F.lit(i).alias("line_ord"), F.lit(k).alias("line"), F.col(p).alias("proposed"), F.col(q).alias("payroll")) for i, (k, p, q) in enumerate(LINES)))
    out = e.select("pack_id", "id", F.explode(lines).alias("l")).select("pack_id", "id", "l.*").where("proposed is not null or payroll is not null")
    return out.withColumn("difference", m.r2(F.col("payroll") - F.col("proposed")))


_LINES = _WIDE + f""", k as (select *, case when coalesce(e_ss, e_med) is not null then {_R2.format(x="(coalesce(e_ss, 0.0) + coalesce(e_med, 0.0))")} end as e_fica, null::double as e_local, {_PER("a_premium")} as a_premium_m, {_PER("b_medicare_gross")} as b_income_m from e),
l as ({" union all ".join(f"select pack_id, id, {i} as line_ord, '{k}' as line, {p} as proposed, {q} as payroll from k" for i, (k, p, q) in enumerate(LINES))})
select *, {_R2.format(x="(payroll - proposed)")} as difference from l where proposed is not null or payroll is not null"""


def fee_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per pack, employees whose fee is more than their saving: how many, by how much, the first twelve ids; and what
    payroll saved in local tax that proposals don't count."""
    e = measures_full(spark, d).select("pack_id", "id", "fee_over", "local_gap")
    first = ordered.top_rows(e.where("fee_over is not null"), ["pack_id"], [F.col("id")], 12).groupBy("pack_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    out = e.groupBy("pack_id").agg(F.count("fee_over").alias("n_over"), controls.exact_sum(F.coalesce("fee_over", F.lit(0.0))).alias("over"), F.count_if(F.col("local_gap") > 0.02).alias("n_local"), controls.exact_sum(F.when(F.col("local_gap") > 0.02, F.col("local_gap")).otherwise(0.0)).alias("local"))
    return out.join(first, "pack_id", "left").withColumn("ids", F.coalesce("ids", F.lit("")))


_FEES = _WIDE + "select pack_id, count(fee_over) as n_over, sum(coalesce(fee_over, 0.0)::decimal(18,2))::double as over, count(*) filter (local_gap > 0.02) as n_local, sum(case when local_gap > 0.02 then local_gap else 0.0 end::decimal(18,2))::double as local, coalesce(array_to_string(list_sort(list(id order by id) filter (fee_over is not null)[1:12]), ','), '') as ids from e group by all"


def review(spark: SparkSession, d: str) -> DataFrame:
    """Per pack, over comparable employees whose premium is deducted: how many, for how many the premium lowered taxable
    and Medicare wages in full, how many were short, and the sum of all shortfalls."""
    e = measures_full(spark, d).where("comparable and a_premium > 0")
    fell = lambda k: F.coalesce(F.abs((F.col(f"b_{k}") - F.col(f"a_{k}")) - F.col("a_premium")) <= 1.0, F.lit(False))
    short = F.when(F.col("allotment_gap") < 0, F.col("allotment_gap")).otherwise(0.0)
    return e.groupBy("pack_id").agg(F.count("*").alias("n"), F.count_if(fell("taxable_wages")).alias("pretax_ok"), F.count_if(fell("medicare_gross")).alias("medicare_ok"), F.count_if(F.col("allotment_gap") < -0.02).alias("n_short"), controls.exact_sum(short).alias("total_short"))


_FELL = lambda k: f"coalesce(abs((b_{k} - a_{k}) - a_premium) <= 1.0, false)"
_REVIEW = _WIDE + f"select pack_id, count(*) as n, count(*) filter ({_FELL('taxable_wages')}) as pretax_ok, count(*) filter ({_FELL('medicare_gross')}) as medicare_ok, count(*) filter (allotment_gap < -0.02) as n_short, sum(case when allotment_gap < 0 then allotment_gap else 0.0 end::decimal(18,2))::double as total_short from e where comparable and a_premium > 0 group by all"


def exhibit(spark: SparkSession, d: str) -> DataFrame:
    """Per pack the employee to show: of those whose premium is deducted the first whose figures all fit, else the first;
    and the first document of their client that names them."""
    e = measures_full(spark, d).where("a_premium > 0")
    clean = F.coalesce(F.col("comparable") & (F.abs("identity_gap") <= 2) & (F.abs("allotment_gap") <= 0.02), F.lit(False))
    top = F.min(F.struct((~clean).alias("rough"), F.col("a_rec_id").alias("rec"), "id", "c_last")).alias("t")
    shown = e.groupBy("pack_id").agg(top).select("pack_id", "t.id", F.col("t.rec").alias("slip_id"), (~F.col("t.rough")).alias("clean"), F.upper(F.trim("t.c_last")).alias("_last"))
    code = table(spark, d, "pack").select("pack_id", "client_code")
    # Documents and surnames meet on the words of the text, not by a search of every text for every name.
    words = table(spark, d, "documents").where("text is not null and client_code is not null").select("doc_id", "client_code", F.explode(F.array_distinct(F.split(F.upper("text"), "[^A-Z]+"))).alias("_last")).where("_last <> ''")
    page = shown.join(code, "pack_id").join(words, ["client_code", "_last"]).groupBy("pack_id").agg(F.min("doc_id").alias("doc_id"))
    return shown.join(page, "pack_id", "left").select("pack_id", "id", "slip_id", "clean", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))


_EXHIBIT = _WIDE + """, s as (select pack_id, id, a_rec_id as slip_id, c_last, coalesce(comparable and abs(identity_gap) <= 2 and abs(allotment_gap) <= 0.02, false) as clean from e where a_premium > 0),
t as (select * from (select *, row_number() over (partition by pack_id order by not clean, slip_id, id) as n from s) where n = 1),
g as (select t.pack_id, min(doc_id) as doc_id from t join pack using (pack_id) join documents using (client_code) where text is not null and list_contains(regexp_split_to_array(upper(text), '[^A-Z]+'), upper(trim(c_last))) and trim(c_last) <> '' group by all)
select t.pack_id, id, slip_id, clean, coalesce(doc_id, -1) as doc_id from t left join g using (pack_id)"""


def report_block(spark: SparkSession, d: str) -> DataFrame:
    """The rows of an employee's block in a report, in order: verdict, what to do, money, evidence, census. Sections
    without anything to say are left out."""
    e = measures_full(spark, d)
    verdict = F.when(F.col("b_net_pay").isNull() | F.col("a_net_pay").isNull(), "A statement is missing.").when(~F.col("comparable"), "Gross pay changed, so the two statements can't be compared.").when(F.col("allotment_gap").isNull(), "The proposal promises nothing.").when(F.col("allotment_gap") >= -0.02, "Take home pay rose by what was promised or more.").otherwise(F.concat(F.lit("Take home pay is short of the promise by "), m.money(-F.col("allotment_gap")), F.lit(".")))
    todo = F.when(F.col("comparable") & (F.col("allotment_gap") < -0.02), F.when(F.abs("identity_gap") > 2, "Ask for clean copies of both statements.").otherwise("Compare the census with payroll."))
    money = F.when(F.col("net_change").isNotNull(), F.concat(F.lit("Net change "), m.money(F.col("net_change")), F.coalesce(F.concat(F.lit(", promised "), m.money(F.col("e_allotment"))), F.lit("")), F.coalesce(F.concat(F.lit(", expected "), F.when(F.col("expected_change").isNotNull(), m.money(F.col("expected_change")))), F.lit("")), F.lit(".")))
    gaps = F.array_compact(F.array(*(F.when(F.abs(k) > 1, F.concat(F.lit(f"{w} "), m.money(F.col(k)))) for k, w in (("federal_gap", "federal"), ("state_gap", "state"), ("fica_gap", "payroll taxes"), ("local_gap", "local"), ("income_gap", "income")))))
    evidence = F.when(F.size(gaps) > 0, F.concat(F.lit("Gaps over a dollar: "), F.array_join(gaps, ", "), F.lit(".")))
    said = F.array_compact(F.array(F.when(F.col("c_health") > 0, F.concat(F.lit("health "), m.money(F.col("c_health")))), F.when(F.col("c_other") > 0, F.concat(F.lit("other pre-tax "), m.money(F.col("c_other")))), F.when(F.col("c_retirement") > 0, F.concat(F.lit("retirement "), m.money(F.col("c_retirement"))))))
    census = F.when(F.size(said) > 0, F.concat(F.lit("The census states "), F.array_join(said, ", "), F.lit(" a month."))).otherwise("The census states no pre-tax deduction.")
    rows = F.array(*(F.struct(F.lit(i).alias("section_ord"), F.lit(k).alias("section"), x.alias("said")) for i, (k, x) in enumerate((("verdict", verdict), ("action", todo), ("money", money), ("evidence", evidence), ("census", census)))))
    return e.select("pack_id", "id", F.explode(rows).alias("r")).select("pack_id", "id", "r.*").where("said is not null")


_USD = lambda x: f"(case when {x} is null then '-' else case when {x} < 0 then '-$' else '$' end || format('{{:,.2f}}', abs({x})) end)"
_GAPS = ", ".join(f"case when abs({k}) > 1 then '{w} ' || {_USD(k)} end" for k, w in (("federal_gap", "federal"), ("state_gap", "state"), ("fica_gap", "payroll taxes"), ("local_gap", "local"), ("income_gap", "income")))
_BLOCK = _WIDE + f""", v as (select pack_id, id,
  case when b_net_pay is null or a_net_pay is null then 'A statement is missing.' when not comparable then 'Gross pay changed, so the two statements can''t be compared.' when allotment_gap is null then 'The proposal promises nothing.' when allotment_gap >= -0.02 then 'Take home pay rose by what was promised or more.' else 'Take home pay is short of the promise by ' || {_USD("(-allotment_gap)")} || '.' end as s0,
  case when comparable and allotment_gap < -0.02 then case when abs(identity_gap) > 2 then 'Ask for clean copies of both statements.' else 'Compare the census with payroll.' end end as s1,
  case when net_change is not null then 'Net change ' || {_USD("net_change")} || ', promised ' || {_USD("e_allotment")} || coalesce(', expected ' || case when expected_change is not null then {_USD("expected_change")} end, '') || '.' end as s2,
  nullif(concat_ws(', ', {_GAPS}), '') as g, nullif(concat_ws(', ', case when c_health > 0 then 'health ' || {_USD("c_health")} end, case when c_other > 0 then 'other pre-tax ' || {_USD("c_other")} end, case when c_retirement > 0 then 'retirement ' || {_USD("c_retirement")} end), '') as c from e),
r as (select pack_id, id, 0 as section_ord, 'verdict' as section, s0 as said from v union all select pack_id, id, 1, 'action', s1 from v union all select pack_id, id, 2, 'money', s2 from v
  union all select pack_id, id, 3, 'evidence', 'Gaps over a dollar: ' || g || '.' from v union all select pack_id, id, 4, 'census', coalesce('The census states ' || c || ' a month.', 'The census states no pre-tax deduction.') from v)
select * from r where said is not null"""


def driving_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per pack, the rows that a reconciliation starts from: the proposal's people, or the census where a pack has no
    proposal; totals and averages are no people."""
    pseudo = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("total", "totals", "monthly average", "average")
    p = table(spark, d, "proposal").where(~pseudo("first_name")).groupBy("pack_id").agg(F.count("*").alias("n_proposal"), F.count_distinct(t.name_key(F.col("first_name"), F.col("last_name"))).alias("n_names"))
    c = table(spark, d, "census").where(~pseudo("employee_last_name")).groupBy("pack_id").agg(F.count("*").alias("n_census"))
    both = c.join(p, "pack_id", "full").na.fill(0, ["n_proposal", "n_names", "n_census"])
    return both.select("pack_id", F.when(F.col("n_proposal") > 0, "proposal").otherwise("census").alias("driving"), F.when(F.col("n_proposal") > 0, F.col("n_proposal")).otherwise(F.col("n_census")).alias("n_rows"), "n_names")


QUERIES = {"measures_full": measures_all, "residual_attribution": residuals, "proposal_lines": proposal_lines, "fee_summary": fee_summary, "review_controls": review, "exhibit_choice": exhibit, "report_block": report_block, "driving_rows": driving_rows}
SQL = {
    "measures_full": _WIDE + f"select pack_id, id, {', '.join(MEASURES)} from e",
    "residual_attribution": _RESIDUALS,
    "proposal_lines": _LINES,
    "fee_summary": _FEES,
    "review_controls": _REVIEW,
    "exhibit_choice": _EXHIBIT,
    "report_block": _BLOCK,
}
