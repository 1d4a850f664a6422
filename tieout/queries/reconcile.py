"""Before-and-after reconciliation over the payroll tables: measures, populations, causes, matches, controls."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions import money as m
from tieout.functions import text as t
from tieout.functions.ids import same_id
from tieout.operators import controls, matching, ordered
from tieout.operators.rules import Rule, solve
from tieout.sources.tables import table

#: The deduction columns of a statement.
DEDUCTIONS = ("federal", "state", "social_security", "medicare", "local", "retirement", "cafeteria", "premium", "fee")
CODES = ("premium", "reimbursement", "fee", "product", "retirement", "cafeteria", "other_deductions")


def _census(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "census").select("pack_id", same_id("employee_id").alias("id"), "rec_id", t.pay_periods(F.col("pay_frequency")).alias("pp"), "gross_annual_taxable_wages", "retirement_401k_monthly")
    return matching.last_wins(c, ["pack_id", "id"], ["rec_id"]).where("id is not null").drop("position")


def _run(spark: SparkSession, d: str, run: str, columns: list[str]) -> DataFrame:
    p = table(spark, d, "paycheck").where(F.col("run") == run).select("pack_id", same_id("employee_id").alias("id"), "rec_id", *columns)
    return matching.first_wins(p, ["pack_id", "id"], ["rec_id"]).select("pack_id", "id", *(F.col(c).alias(f"{run[0]}_{c}") for c in ["rec_id", *columns]))


def pairs(spark: SparkSession, d: str, cols: list[str]) -> DataFrame:
    """One row per census employee with the promise and columns of both runs."""
    promise = matching.first_wins(table(spark, d, "proposal").select("pack_id", same_id("client_employee_id").alias("id"), "rec_id", F.col("employee_monthly_allotment").alias("promised")), ["pack_id", "id"], ["rec_id"]).select("pack_id", "id", "promised")
    e = _census(spark, d)
    for run in ("before", "after"):
        e = e.join(_run(spark, d, run, cols), ["pack_id", "id"], "left")
    return e.join(promise, ["pack_id", "id"], "left")


def measures(spark: SparkSession, d: str) -> DataFrame:
    """One row per census employee with both runs, the promise, and what changed per month."""
    e = pairs(spark, d, ["gross", "net_pay", "federal", "state", "social_security", "medicare", "product", "fee"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    saved = lambda k: m.per_month(F.col(f"b_{k}") - F.col(f"a_{k}"), F.col("pp"))
    fica = F.when(F.col("b_social_security").isNotNull() | F.col("b_medicare").isNotNull(), m.per_month((z("b_social_security") + z("b_medicare")) - (z("a_social_security") + z("a_medicare")), F.col("pp")))
    e = e.select(
        "pack_id", "id", "pp", "promised",
        (F.col("b_rec_id").isNotNull().cast("int") + F.col("a_rec_id").isNotNull().cast("int")).alias("n_runs"),
        m.per_month(F.col("a_gross") - F.col("b_gross"), F.col("pp")).alias("gross_change"),
        saved("federal").alias("federal_saved"), saved("state").alias("state_saved"), fica.alias("fica_saved"),
        m.per_month((F.col("a_net_pay") - F.col("b_net_pay")) + z("a_product"), F.col("pp")).alias("net_change"),
    )
    e = e.withColumn("comparable", F.coalesce(F.abs("gross_change") <= 1.0, F.lit(True)))
    e = e.withColumn("gap", m.r2(F.col("net_change") - F.col("promised")))
    verdict = F.when(F.col("n_runs") < 2, "grey").when(~F.col("comparable"), "not_comparable").when(F.col("gap").isNull(), "grey").when(F.col("gap") >= -0.02, "green").when(F.col("gap") >= -25, "yellow").otherwise("red")
    return e.withColumn("verdict", verdict)


_ID = r"nullif(regexp_extract(ltrim(regexp_replace(upper(regexp_replace(trim({c}), '\.0+\s*$', '')), '[^\p{{L}}\p{{N}}]', '', 'g'), '0'), '^.*[1-9].*$'), '')"
_R2 = "(round(cast({x} as decimal(28,6)), 2)::double + 0.0)"
_PP = "case lower(trim(pay_frequency)) " + " ".join(f"when '{k}' then {v}" for k, v in t.FREQUENCIES.items()) + " else 12 end"
_PER = lambda x: f"case when pp > 0 then {_R2.format(x=f'(({x}) * pp / 12.0)')} end"
_MEASURES = f"""
with c as (select pack_id, id, max_by(pp, rec_id) as pp from (select *, {_ID.format(c="employee_id")} as id, {_PP} as pp from census) where id is not null and pack_id is not null group by all),
s as (select *, {_ID.format(c="employee_id")} as id from paycheck),
r as (select * from (select *, row_number() over (partition by pack_id, id, run order by rec_id) as n from s where id is not null and pack_id is not null) where n = 1),
p as (select pack_id, id, promised from (select pack_id, {_ID.format(c="client_employee_id")} as id, employee_monthly_allotment as promised, row_number() over (partition by pack_id, {_ID.format(c="client_employee_id")} order by rec_id) as n from proposal) where n = 1 and id is not null),
j as (
  select c.pack_id, c.id, c.pp::int as pp, p.promised, (b.rec_id is not null)::int + (a.rec_id is not null)::int as n_runs,
    {_PER("a.gross - b.gross")} as gross_change, {_PER("b.federal - a.federal")} as federal_saved, {_PER("b.state - a.state")} as state_saved,
    case when b.social_security is not null or b.medicare is not null then {_PER("(coalesce(b.social_security, 0.0) + coalesce(b.medicare, 0.0)) - (coalesce(a.social_security, 0.0) + coalesce(a.medicare, 0.0))")} end as fica_saved,
    {_PER("(a.net_pay - b.net_pay) + coalesce(a.product, 0.0)")} as net_change
  from c left join r b on b.pack_id = c.pack_id and b.id = c.id and b.run = 'before' left join r a on a.pack_id = c.pack_id and a.id = c.id and a.run = 'after'
  left join p on p.pack_id = c.pack_id and p.id = c.id),
k as (select *, coalesce(abs(gross_change) <= 1.0, true) as comparable, {_R2.format(x="(net_change - promised)")} as gap from j),
e as (select *, case when n_runs < 2 then 'grey' when not comparable then 'not_comparable' when gap is null then 'grey' when gap >= -0.02 then 'green' when gap >= -25 then 'yellow' else 'red' end as verdict from k)
"""


def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Employees, shortfalls and sums by verdict."""
    e = measures(spark, d)
    return e.groupBy("verdict").agg(F.count("*").alias("n"), controls.exact_sum(F.col("gap")).alias("total_gap"), F.count_if(F.col("gap") < -0.02).alias("decreases"), F.max(F.abs("gross_change")).alias("max_gross_change"))


def population_controls(spark: SparkSession, d: str) -> DataFrame:
    """How many employees of a pack have both statements, one or none."""
    e = measures(spark, d)
    return e.groupBy("pack_id").agg(F.count_if(F.col("n_runs") == 2).alias("both"), F.count_if(F.col("n_runs") == 1).alias("one"), F.count_if(F.col("n_runs") == 0).alias("none"))


def not_comparable(spark: SparkSession, d: str) -> DataFrame:
    """Per pack the employees whose gross changed: how many, the first twelve ids, the greatest change."""
    e = measures(spark, d).where(~F.col("comparable"))
    first = ordered.top_rows(e, ["pack_id"], [F.col("id")], 12).groupBy("pack_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return e.groupBy("pack_id").agg(F.count("*").alias("n"), F.max(F.abs("gross_change")).alias("max_change")).join(first, "pack_id")


RULES = [
    Rule("short", [("n_runs", "=", 2), ("comparable", "=", "TRUE"), ("gap", "<", -0.02)], {"label": "The pay rose by less than promised", "amount": "0 - {gap}"}),
    Rule("over", [("n_runs", "=", 2), ("gap", ">", 0.02)], {"label": "The pay rose by more than promised", "amount": "{gap}"}),
    Rule("gross_moved", [("comparable", "!=", "TRUE")], {"label": "Gross pay changed between the runs", "amount": ("ABS", "{gross_change}")}),
    Rule("federal_up", [("federal_saved", "<", 0)], {"label": "Federal tax rose", "amount": ("ROUND", ("TIMES_CHAR", "{federal_saved}", -1), 2)}),
    Rule("rare_pay", [("pp", "NOT IN", [24, 26])], {"label": "Paid monthly or weekly", "amount": ("DIVIDED_CHAR", "{gross_change}", "{pp}")}),
    Rule("one_run", [("n_runs", "between", [0, 1])], {"label": "A statement is missing", "amount": 0.0}),
]
_KINDS = {"label": "string", "amount": "double"}


def rules_all(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that holds for each employee, with its amount."""
    return solve(measures(spark, d), RULES, keep=["pack_id", "id"], kinds=_KINDS).select("pack_id", "id", "rule", "label", m.r2(F.col("amount")).alias("amount"))


def rules_first(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that holds for each employee."""
    return solve(measures(spark, d), RULES, keep=["pack_id", "id"], kinds=_KINDS, strategy="FIRST_MATCH").select("pack_id", "id", "rule", m.r2(F.col("amount")).alias("amount"))


def cause_summary(spark: SparkSession, d: str) -> DataFrame:
    """Findings and their amounts by label."""
    return rules_all(spark, d).groupBy("label").agg(F.count("*").alias("n"), controls.exact_sum(F.coalesce("amount", F.lit(0.0))).alias("amount"))


_FOUND = [
    ("n_runs = 2 and comparable and gap < -0.02", "short", "The pay rose by less than promised", "0 - coalesce(gap, 0)"),
    ("n_runs = 2 and gap > 0.02", "over", "The pay rose by more than promised", "gap"),
    ("not comparable", "gross_moved", "Gross pay changed between the runs", "abs(coalesce(gross_change, 0))"),
    ("federal_saved < 0", "federal_up", "Federal tax rose", "round((coalesce(federal_saved, 0) * -1)::decimal(28,6), 2)::double"),
    ("pp not in (24, 26)", "rare_pay", "Paid monthly or weekly", "coalesce(coalesce(gross_change, 0) / pp, 0)"),
    ("n_runs between 0 and 1", "one_run", "A statement is missing", "0.0::double"),
]
_ALL = _MEASURES + ", f as (" + " union all ".join(f"select pack_id, id, {i} as pos, '{r}' as rule, '{lab}' as label, {_R2.format(x=f'({amt})')} as amount from e where {c}" for i, (c, r, lab, amt) in enumerate(_FOUND)) + ") "


def tiered_match(spark: SparkSession, d: str) -> DataFrame:
    """Each proposal row with the statement before it that its id, name, or last name and first letters find; 0 for none."""
    p = table(spark, d, "proposal").select("rec_id", "pack_id", same_id("client_employee_id").alias("pid"), t.name_key(F.col("first_name"), F.col("last_name")).alias("pname"))
    s = table(spark, d, "paycheck").where("run = 'before'").select(F.col("rec_id").alias("slip_id"), "pack_id", same_id("employee_id").alias("sid"), t.match_key(F.col("name")).alias("sname"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    tiers = [(F.col("pid"), F.col("sid")), (blank("pname"), blank("sname")), (t.short_key(F.col("pname")), t.short_key(F.col("sname")))]
    return matching.tiered(p, s, tiers, left_id="rec_id", right_id="slip_id", within="pack_id", order=["slip_id"]).fillna(0, ["slip_id", "tier"])


_NORM = lambda c: f"trim(regexp_replace(lower(translate({c}, '{t._MARKED}', '{t._PLAIN}')), '[^a-z0-9]+', ' ', 'g'))"
_NAMEKEY = lambda a, b: f"trim(concat_ws(' ', {_NORM(f'coalesce({a}, chr(0)[1:0])')}, {_NORM(f'coalesce({b}, chr(0)[1:0])')}))"
_MATCHKEY = f"case when contains(name, ',') then {_NAMEKEY('regexp_split_to_array(trim(string_split(name, chr(44))[-1]), chr(32) || chr(43))[1]', 'string_split(name, chr(44))[1]')} else case when len(string_split({_NORM('name')}, ' ')) > 1 then concat_ws(' ', string_split({_NORM('name')}, ' ')[1], string_split({_NORM('name')}, ' ')[-1]) else {_NORM('name')} end end"
_SHORT = lambda k: f"case when len(string_split({k}, ' ')) > 1 then concat_ws('|', string_split({k}, ' ')[-1], substring(string_split({k}, ' ')[1], 1, 3)) end"
_TIERED = f"""
with p as (select rec_id, pack_id, {_ID.format(c="client_employee_id")} as pid, nullif({_NAMEKEY("first_name", "last_name")}, '') as pname, {_SHORT(_NAMEKEY("first_name", "last_name"))} as pshort from proposal),
s as (select rec_id as slip_id, pack_id, {_ID.format(c="employee_id")} as sid, nullif({_MATCHKEY}, '') as sname, {_SHORT("(" + _MATCHKEY + ")")} as sshort from paycheck where run = 'before'),
a as (select pack_id, sid, min(slip_id) as i from s where sid is not null group by all), b as (select pack_id, sname, min(slip_id) as i from s where sname is not null group by all), c as (select pack_id, sshort, min(slip_id) as i from s where sshort is not null group by all),
o as (select rec_id, coalesce(a.i, b.i, c.i, 0) as slip_id, case when a.i is not null then 1 when b.i is not null then 2 when c.i is not null then 3 else 0 end as tier from p
  left join a on p.pack_id = a.pack_id and p.pid = a.sid left join b on p.pack_id = b.pack_id and p.pname = b.sname left join c on p.pack_id = c.pack_id and p.pshort = c.sshort)
"""


def orphan_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements before the change that no proposal row finds."""
    found = tiered_match(spark, d).select("slip_id").where("slip_id <> 0").distinct()
    return table(spark, d, "paycheck").where("run = 'before'").select(F.col("rec_id").alias("slip_id"), "pack_id").join(found, "slip_id", "left_anti")


def merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Census files merged: the last row of each employee id, at the place of its first."""
    c = table(spark, d, "census").select("pack_id", same_id("employee_id").alias("id"), "file_ord", "row_ord", "rec_id", "gross_annual_taxable_wages")
    out = matching.last_wins(c, ["pack_id", "id"], ["file_ord", "row_ord", "rec_id"])
    return out.select("pack_id", "id", "rec_id", "gross_annual_taxable_wages", F.col("position.file_ord").alias("first_file"), F.col("position.rec_id").alias("first_rec"))


def index_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first statement of each id and run."""
    p = table(spark, d, "paycheck").select("pack_id", same_id("employee_id").alias("id"), "run", "rec_id", "gross")
    return matching.first_wins(p, ["pack_id", "id", "run"], ["rec_id"])


def census_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each proposal row with its census row by id, 0 for none, and whether it was found."""
    p = table(spark, d, "proposal").select("rec_id", "pack_id", same_id("client_employee_id").alias("id"))
    c = _census(spark, d).select("pack_id", "id", F.col("rec_id").alias("census_rec"))
    return p.join(c, ["pack_id", "id"], "left").select("rec_id", F.coalesce("census_rec", F.lit(0)).alias("census_rec"), F.col("census_rec").isNotNull().alias("found"))


def programme_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes that only the later run of a pack has, by their part in the programme."""
    rows = controls.unpivoted(table(spark, d, "paycheck"), ["pack_id", "run", "rec_id"], CODES, "code", "amount").where("amount <> 0")
    signed = rows.withColumn("amount", F.when(F.col("code") == "reimbursement", -F.abs("amount")).otherwise(F.col("amount")))
    return matching.new_codes(signed.where("run = 'before'"), signed.where("run = 'after'"), "pack_id", "code", "amount")


def same_payers(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of codes of a pack that the same people pay in the same amounts."""
    rows = controls.unpivoted(table(spark, d, "paycheck").where("run = 'after'"), ["pack_id", "name"], CODES, "code", "amount").where("amount <> 0 and name is not null")
    return matching.same_payers(rows, "pack_id", "code", "name", "amount")


def register_controls(spark: SparkSession, d: str) -> DataFrame:
    """Statement totals of a pack and run against totals that its register would print: here rounded to the dollar."""
    p = table(spark, d, "paycheck")
    sums = {k: controls.exact_sum(F.col(k)) for k in ("gross", "federal", "medicare", "net_pay")} | {"employees": F.count("*")}
    printed = p.groupBy("pack_id", "run").agg(*(F.round(F.sum(F.col(k).cast("decimal(18,2)")), 0).cast("double").alias(k) for k in ("gross", "federal", "medicare", "net_pay")), F.count("*").cast("double").alias("employees"))
    printed = controls.unpivoted(printed, ["pack_id", "run"], ["gross", "federal", "medicare", "net_pay", "employees"], "control", "printed")
    return controls.control_totals(p, ["pack_id", "run"], sums, printed)


def plausibility(spark: SparkSession, d: str) -> DataFrame:
    """Statements with figures that can't be right for their gross taken out."""
    p = table(spark, d, "paycheck").select("rec_id", "gross", *m.PLAUSIBLE)
    return p.withColumns(m.validated())


def anchored(spark: SparkSession, d: str) -> DataFrame:
    """The gross of each statement, anchored on the census pay per period where it is off."""
    c = _census(spark, d).select("pack_id", "id", (F.col("gross_annual_taxable_wages") / F.col("pp")).alias("anchor"))
    p = table(spark, d, "paycheck").select("rec_id", "pack_id", same_id("employee_id").alias("id"), "gross")
    return p.join(c, ["pack_id", "id"], "left").select("rec_id", m.anchored_gross(F.col("gross"), F.col("anchor")).alias("gross"))


def federal_rest(spark: SparkSession, d: str) -> DataFrame:
    """Federal tax that isn't printed, as the rest of the deduction total where that is possible."""
    p = table(spark, d, "paycheck").where("federal is null")
    rest = m.by_subtraction(F.col("gross"), F.col("net_pay"), F.col("total_deductions"), [F.col(k) for k in ("state", "social_security", "medicare", "retirement", "local")])
    return p.select("rec_id", rest.alias("federal"))


def net_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Net pay that two of its printings agree on, and the mode of all."""
    cols = [F.col("net_pay"), F.col("gross") - F.col("total_deductions"), F.col("gross") - F.col("federal") - F.coalesce("state", F.lit(0.0)) - F.coalesce("medicare", F.lit(0.0))]
    p = table(spark, d, "paycheck")
    return p.select("rec_id", m.r2(m.consensus(cols, 50.0)).alias("agreed"), m.r2(m.modal(F.filter(F.array(*cols), lambda x: x.isNotNull()), 50.0)).alias("most"))


def fica_base(spark: SparkSession, d: str) -> DataFrame:
    """The wages that both payroll taxes point to: the mean of the estimates that agree."""
    p = table(spark, d, "paycheck")
    votes = [F.col("social_security") / 0.062, F.col("medicare") / 0.0145, F.col("medicare_gross")]
    return p.select("rec_id", m.r2(m.agreeing_mean(votes, 5.0)).alias("base"))


def fuzzy_gap(spark: SparkSession, d: str) -> DataFrame:
    """Net change as a triangular number: each printed figure may be off by two cents, each missing product is 0 to 5."""
    e = measures(spark, d).where("net_change is not null")
    mid = F.col("gap")
    low, high = mid - F.lit(0.04) * F.col("pp") / 12, mid + (F.lit(0.04) + F.lit(5.0)) * F.col("pp") / 12
    return e.where("gap is not null").select("pack_id", "id", m.r2(low).alias("low"), m.r2(mid).alias("mid"), m.r2(high).alias("high"), m.r2(low + 0.5 * (mid - low)).alias("cut_low"), m.r2(high - 0.5 * (high - mid)).alias("cut_high"))


def expectations(spark: SparkSession, d: str) -> DataFrame:
    """Figures of statements that are farther from what the census lets expect than three of its deviations."""
    c = _census(spark, d).select("pack_id", "id", F.explode(F.array(F.struct(F.lit("gross").alias("field"), (F.col("gross_annual_taxable_wages") / F.col("pp")).alias("expected"), F.lit(10.0).alias("sd")), F.struct(F.lit("retirement").alias("field"), (F.col("retirement_401k_monthly") * 12 / F.col("pp")).alias("expected"), F.lit(2.0).alias("sd")))).alias("x")).select("pack_id", "id", "x.*").where("expected is not null")
    p = controls.unpivoted(table(spark, d, "paycheck").withColumn("id", same_id("employee_id")), ["rec_id", "pack_id", "id"], ["gross", "retirement"])
    return p.join(c, ["pack_id", "id", "field"]).where(F.abs(F.col("value") - F.col("expected")) > 3 * F.col("sd")).select("rec_id", "field", "value", m.r2(F.col("expected")).alias("expected"))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """By field, the spread of small differences between the two runs and how often they are large."""
    cols = ["gross", "federal", "medicare"]
    both = _run(spark, d, "before", cols).join(_run(spark, d, "after", cols), ["pack_id", "id"])
    errors = controls.unpivoted(both.select("pack_id", *(m.r2(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in cols)), ["pack_id"], cols, "field", "error")
    return controls.robust_scale(errors, ["field"], "error", near=40.0)


def read_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Per pack and run: statements, those with name and net pay, and whether half of them can be used."""
    p = table(spark, d, "paycheck").groupBy("pack_id", "run").agg(F.count("*").alias("n_read"), F.count_if(F.col("name").isNotNull() & F.col("net_pay").isNotNull()).alias("usable"), F.count_if(F.col("gated")).alias("gated"))
    return p.withColumn("unusable", F.col("usable") < 0.5 * F.col("n_read"))


def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Lines of both statements of an employee: lines missing on both sides dropped, change only where both are there."""
    cols = list(DEDUCTIONS)
    b, a = _run(spark, d, "before", cols), _run(spark, d, "after", cols)
    both = b.join(a, ["pack_id", "id"], "full")
    lines = F.array(*(F.struct(F.lit(i).alias("line_ord"), F.lit(c).alias("line"), F.col(f"b_{c}").alias("before"), F.col(f"a_{c}").alias("after")) for i, c in enumerate(cols)))
    out = both.select("pack_id", "id", F.explode(lines).alias("l")).select("pack_id", "id", "l.*").where("before is not null or after is not null")
    return out.withColumn("change", m.r2(F.col("after") - F.col("before")))


def fill_missing_line(spark: SparkSession, d: str) -> DataFrame:
    """Figures that follow from the others of gross - deductions = net where just one of them isn't printed."""
    g, t_, n = F.col("gross"), F.col("total_deductions"), F.col("net_pay")
    p = table(spark, d, "paycheck")
    missing = F.when(g.isNull() & t_.isNotNull() & n.isNotNull(), F.struct(F.lit("gross").alias("field"), m.r2(t_ + n).alias("value"))).when(t_.isNull() & g.isNotNull() & n.isNotNull(), F.struct(F.lit("total_deductions").alias("field"), m.r2(g - n).alias("value"))).when(n.isNull() & g.isNotNull() & t_.isNotNull(), F.struct(F.lit("net_pay").alias("field"), m.r2(g - t_).alias("value")))
    return p.select("rec_id", missing.alias("x")).where("x is not null").select("rec_id", "x.*").where("value >= -0.01")


def excess_lines(spark: SparkSession, d: str) -> DataFrame:
    """Statements whose read deductions exceed gross less net by over a dollar, and by how much."""
    total = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in DEDUCTIONS), F.lit(0.0))
    p = table(spark, d, "paycheck").where("gross is not null and net_pay is not null")
    return p.select("rec_id", m.r2(total - (F.col("gross") - F.col("net_pay"))).alias("excess")).where("excess > 1.0")


def digit_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What each fee may have been printed as, if one digit was misread."""
    p = table(spark, d, "paycheck").where("fee is not null and fee > 0").select("fee").distinct()
    return p.select("fee", F.explode(m.misreadings(F.col("fee"), 400)).alias("c")).select("fee", "c.value").distinct()


def corrections(spark: SparkSession, d: str) -> DataFrame:
    """Net pay with its latest correction: statements loaded again later correct the first."""
    p = table(spark, d, "paycheck").select("pack_id", same_id("employee_id").alias("id"), "run", "rec_id", "loaded_at", "net_pay").where("id is not null and pack_id is not null")
    first = matching.first_wins(p, ["pack_id", "id", "run"], ["rec_id"])
    later = p.join(first.select("pack_id", "id", "run", F.col("rec_id").alias("first")), ["pack_id", "id", "run"]).where(F.col("rec_id") > F.col("first"))
    return ordered.effective(first, later, ["pack_id", "id", "run"], "net_pay", ["loaded_at", "rec_id"])


QUERIES = {
    "reconcile_before_after": measures, "reconcile_summary": reconcile_summary, "population_controls": population_controls, "not_comparable": not_comparable, "rules_all_match": rules_all, "rules_first_match": rules_first,
    "cause_summary": cause_summary, "tiered_match": tiered_match, "orphan_statements": orphan_statements, "merge_last_wins": merge_last_wins, "index_first_wins": index_first_wins, "census_lookup": census_lookup,
    "programme_codes_diff": programme_codes, "payer_set_equality": same_payers, "control_totals": register_controls, "plausibility_validate": plausibility, "anchor_gross": anchored, "federal_by_subtraction": federal_rest,
    "net_consensus": net_consensus, "fica_base": fica_base, "fuzzy_gap": fuzzy_gap, "expectation_disagreements": expectations, "robust_calibration": calibration, "read_accounting": read_accounting,
    "side_by_side": side_by_side, "fill_derived": fill_missing_line, "excess_deductions": excess_lines, "digit_candidates": digit_candidates, "latest_correction": corrections,
}

_UNPIVOT = lambda fields, keep, src: " union all ".join(f"select {keep}, '{f}' as code, {f}::double as amount from {src} where {f} is not null" for f in fields)
_FIRST = f"s as (select *, {_ID.format(c='employee_id')} as id from paycheck), r as (select * from (select *, row_number() over (partition by pack_id, id, run order by rec_id) as n from s where id is not null and pack_id is not null) where n = 1)"
_CENSUS = f"c as (select pack_id, id, max_by(pp, rec_id) as pp, max(rec_id) as rec_id, arg_max_null(gross_annual_taxable_wages, rec_id) as g, arg_max_null(retirement_401k_monthly, rec_id) as ret from (select *, {_ID.format(c='employee_id')} as id, {_PP} as pp from census) where id is not null and pack_id is not null group by all)"
SQL = {
    "reconcile_before_after": _MEASURES + "select * from e",
    "reconcile_summary": _MEASURES + "select verdict, count(*) as n, sum(gap::decimal(18,2))::double as total_gap, count(*) filter (gap < -0.02) as decreases, max(abs(gross_change)) as max_gross_change from e group by all",
    "population_controls": _MEASURES + "select pack_id, count(*) filter (n_runs = 2) as both, count(*) filter (n_runs = 1) as one, count(*) filter (n_runs = 0) as none from e group by all",
    "not_comparable": _MEASURES + "select pack_id, count(*) as n, max(abs(gross_change)) as max_change, array_to_string(list_sort(list(id order by id)[1:12]), ',') as ids from e where not comparable group by all",
    "rules_all_match": _ALL + "select pack_id, id, rule, label, amount from f",
    "rules_first_match": _ALL + "select pack_id, id, rule, amount from (select *, row_number() over (partition by pack_id, id order by pos) as n from f) where n = 1",
    "cause_summary": _ALL + "select label, count(*) as n, sum(coalesce(amount, 0)::decimal(18,2))::double as amount from f group by all",
    "tiered_match": _TIERED + "select * from o",
    "orphan_statements": _TIERED + "select slip_id, pack_id from s where slip_id not in (select slip_id from o where slip_id is not null)",
    "merge_last_wins": f"with c as (select *, {_ID.format(c='employee_id')} as id from census), k as (select *, row_number() over (partition by pack_id, id order by file_ord desc, row_ord desc, rec_id desc) as n, first_value(file_ord) over (partition by pack_id, id order by file_ord, row_ord, rec_id) as first_file, first_value(rec_id) over (partition by pack_id, id order by file_ord, row_ord, rec_id) as first_rec from c where id is not null) select pack_id, id, rec_id, gross_annual_taxable_wages, first_file, first_rec from k where n = 1 union all select pack_id, id, rec_id, gross_annual_taxable_wages, file_ord, rec_id from c where id is null",
    "index_first_wins": f"with {_FIRST} select pack_id, id, run, rec_id, gross from r",
    "census_lookup": f"with {_CENSUS} select p.rec_id, coalesce(c.rec_id, 0) as census_rec, c.rec_id is not null as found from (select *, {_ID.format(c='client_employee_id')} as id from proposal) p left join c on p.pack_id = c.pack_id and p.id = c.id",
    "programme_codes_diff": f"with u as (select pack_id, run, code, case when code = 'reimbursement' then -abs(amount) else amount end as amount from ({_UNPIVOT(CODES, 'pack_id, run', 'paycheck')}) where amount <> 0), n as (select pack_id, code, sum(amount::decimal(18,2))::double as total from u where run = 'after' and (pack_id, code) not in (select pack_id, code from u where run = 'before') group by all), m as (select *, first_value(code) over (partition by pack_id order by total desc, code desc) as top from n) select pack_id, code, total, case when total < 0 and exists (select 1 from n o where o.pack_id = m.pack_id and round(o.total, 2) = round(-m.total, 2) and o.total > 0) then 'reimbursement' when total > 0 and top = code then 'premium' else 'fee' end as part from m",
    "payer_set_equality": f"with u as (select pack_id, name, code, abs(sum(amount::decimal(18,2))) as s from ({_UNPIVOT(CODES, 'pack_id, name, run', 'paycheck')}) where run = 'after' and amount <> 0 and name is not null group by pack_id, name, code), g as (select pack_id, code, list(name || '|' || s order by name || '|' || s) as l, count(*) as n_payers from u group by all) select a.pack_id, a.code as code_a, b.code as code_b, a.n_payers from g a join g b on a.pack_id = b.pack_id and a.l = b.l and a.code < b.code",
    "control_totals": "with s as (select pack_id, run, sum(gross::decimal(18,2)) as gross, sum(federal::decimal(18,2)) as federal, sum(medicare::decimal(18,2)) as medicare, sum(net_pay::decimal(18,2)) as net_pay, count(*)::decimal(18,2) as employees from paycheck group by all), u as (unpivot s on gross, federal, medicare, net_pay, employees into name control value parsed) select pack_id, run, control, parsed::double as parsed, case when control = 'employees' then parsed::double else round(parsed, 0)::double end as printed, abs(parsed::double - round(parsed, 0)::double) <= 0.01 as ok from u",
    "plausibility_validate": "select rec_id, gross, " + ", ".join(f"case when gross is null or gross <= 0 or {k} < 0 or (abs({k}) >= gross * {lo} - 0.01 and abs({k}) <= gross * {hi} + 0.01) then {k} end as {k}" for k, (lo, hi) in m.PLAUSIBLE.items()) + " from paycheck",
    "anchor_gross": f"with {_CENSUS}, a as (select p.rec_id, p.gross, c.g / c.pp as anchor from (select *, {_ID.format(c='employee_id')} as id from paycheck) p left join c on p.pack_id = c.pack_id and p.id = c.id) select rec_id, case when anchor is not null and anchor <> 0 and (gross is null or abs(gross - anchor) > greatest(1.0, anchor * 0.02)) then {_R2.format(x='anchor')} else gross end as gross from a",
    "federal_by_subtraction": f"with a as (select *, total_deductions - (coalesce(state, 0.0) + coalesce(social_security, 0.0) + coalesce(medicare, 0.0) + coalesce(retirement, 0.0) + coalesce(local, 0.0)) as rest from paycheck where federal is null) select rec_id, case when abs(gross - net_pay - total_deductions) <= 0.02 and rest >= -0.01 and rest <= 0.45 * gross then {_R2.format(x='greatest(rest, 0.0)')} end as federal from a",
    "net_consensus": f"with v as (select rec_id, net_pay as a, gross - total_deductions as b, gross - federal - coalesce(state, 0.0) - coalesce(medicare, 0.0) as c from paycheck), n as (select *, coalesce((abs(a - b) <= 50)::int, 0) as ab, coalesce((abs(a - c) <= 50)::int, 0) as ac, coalesce((abs(b - c) <= 50)::int, 0) as bc from v), k as (select *, case when a is not null then ab + ac else -1 end as na, case when b is not null then ab + bc else -1 end as nb, case when c is not null then ac + bc else -1 end as nc from n) select rec_id, {_R2.format(x='(case when ab + ac > 0 then a when ab + bc > 0 then b when ac + bc > 0 then c end)')} as agreed, {_R2.format(x='(case when greatest(na, nb, nc) < 0 then null when na = greatest(na, nb, nc) then a when nb = greatest(na, nb, nc) then b else c end)')} as most from k",
    "fica_base": f"with v as (select rec_id, social_security / 0.062::double as a, medicare / 0.0145::double as b, medicare_gross as c from paycheck), n as (select *, coalesce((abs(a - b) <= 5)::int, 0) as ab, coalesce((abs(a - c) <= 5)::int, 0) as ac, coalesce((abs(b - c) <= 5)::int, 0) as bc from v), k as (select *, case when a is not null then ab + ac else -1 end as na, case when b is not null then ab + bc else -1 end as nb, case when c is not null then ac + bc else -1 end as nc from n), m as (select *, case when greatest(na, nb, nc) < 0 then null when na = greatest(na, nb, nc) then a when nb = greatest(na, nb, nc) then b else c end as x from k) select rec_id, {_R2.format(x='((0.0::double + case when abs(a - x) <= 5 then a else 0.0 end + case when abs(b - x) <= 5 then b else 0.0 end + case when abs(c - x) <= 5 then c else 0.0 end) / nullif(coalesce((abs(a - x) <= 5)::int, 0) + coalesce((abs(b - x) <= 5)::int, 0) + coalesce((abs(c - x) <= 5)::int, 0), 0))')} as base from m",
    "fuzzy_gap": _MEASURES + f", x as (select pack_id, id, gap as mid, gap - 0.04 * pp / 12 as low, gap + (0.04 + 5.0) * pp / 12 as high from e where net_change is not null and gap is not null) select pack_id, id, {_R2.format(x='low')} as low, {_R2.format(x='mid')} as mid, {_R2.format(x='high')} as high, {_R2.format(x='(low + 0.5::double * (mid - low))')} as cut_low, {_R2.format(x='(high - 0.5::double * (high - mid))')} as cut_high from x",
    "expectation_disagreements": f"with {_CENSUS}, x as (select pack_id, id, 'gross' as field, g / pp as expected, 10.0 as sd from c union all select pack_id, id, 'retirement', ret * 12 / pp, 2.0 from c), s as (select *, {_ID.format(c='employee_id')} as id from paycheck), v as (select rec_id, pack_id, id, 'gross' as field, gross as value from s union all select rec_id, pack_id, id, 'retirement', retirement from s) select rec_id, field, value, {_R2.format(x='expected')} as expected from v join x using (pack_id, id, field) where abs(value - expected) > 3 * sd",
    "robust_calibration": f"with {_FIRST}, b as (select * from r where run = 'before'), a as (select * from r where run = 'after'), x as (" + " union all ".join(f"select '{c}' as field, {_R2.format(x=f'(a.{c} - b.{c})')} as error from a join b using (pack_id, id)" for c in ("gross", "federal", "medicare")) + "), e as (from x where error is not null), k as (select field, median(error) as m from e where abs(error) <= 40 group by all), q as (select field, median(abs(error - m)) as mad from e join k using (field) where abs(error) <= 40 group by all) select field, count(*) as n, round(greatest(0.05, coalesce(any_value(mad) * 1.4826, 0.05)), 6) as sd, round(count(*) filter (abs(error) > 40) / count(*), 6) as outlier_rate, median(abs(error)) filter (abs(error) > 40) as typical_wrong_by from e left join q using (field) group by field",
    "read_accounting": "select pack_id, run, count(*) as n_read, count(*) filter (name is not null and net_pay is not null) as usable, count(*) filter (gated) as gated, count(*) filter (name is not null and net_pay is not null) < 0.5 * count(*) as unusable from paycheck group by all",
    "side_by_side": f"with {_FIRST}, b as (select * from r where run = 'before'), a as (select * from r where run = 'after'), x as (" + " union all ".join(f"select coalesce(a.pack_id, b.pack_id) as pack_id, coalesce(a.id, b.id) as id, {i} as line_ord, '{c}' as line, b.{c} as before, a.{c} as after from b full join a on a.pack_id = b.pack_id and a.id = b.id" for i, c in enumerate(DEDUCTIONS)) + f") select *, {_R2.format(x='(after - before)')} as change from x where before is not null or after is not null",
    "fill_derived": f"with x as (select rec_id, 'gross' as field, {_R2.format(x='(total_deductions + net_pay)')} as value from paycheck where gross is null union all select rec_id, 'total_deductions', {_R2.format(x='(gross - net_pay)')} from paycheck where total_deductions is null union all select rec_id, 'net_pay', {_R2.format(x='(gross - total_deductions)')} from paycheck where net_pay is null) select * from x where value >= -0.01",
    "excess_deductions": "with x as (select rec_id, " + _R2.format(x="(0.0 + " + " + ".join(f"coalesce({k}, 0.0)" for k in DEDUCTIONS) + " - (gross - net_pay))") + " as excess from paycheck where gross is not null and net_pay is not null) select * from x where excess > 1.0",
    "digit_candidates": "with f as (select distinct fee, format('{:.2f}', fee) as s from paycheck where fee > 0), c(a, b) as (values " + ", ".join(f"('{k}', '{x}')" for k, v in m.CONFUSED.items() for x in v) + "), o as (select fee, (substring(s, 1, i - 1) || b || substring(s, i + 1))::double as value from (select *, unnest(range(1, length(s) + 1)) as i from f) join c on a = substring(s, i, 1) union all select fee, (d || s)::double from f, (select unnest(range(1, 10)) as d) union all select fee, fee * 100 from f) select distinct fee, " + _R2.format(x="value") + " as value from o where abs(value - fee) > 0.001",
    "latest_correction": f"with {_FIRST}, l as (select s.* from s join r on s.pack_id = r.pack_id and s.id = r.id and s.run = r.run and s.rec_id > r.rec_id), k as (select pack_id, id, run, arg_max_null(net_pay, (loaded_at, rec_id)) as fix, true as has from l group by all) select r.pack_id, r.id, r.run, case when has then fix else r.net_pay end as net_pay, coalesce(has, false) as corrected from r left join k on r.pack_id = k.pack_id and r.id = k.id and r.run = k.run",
}
