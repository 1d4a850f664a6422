"""Report rows: findings in order, sentences, shares, gates and tallies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions import money as m
from tieout.operators import controls, matching
from tieout.operators.rules import ranked_list, solve
from tieout.queries import reconcile, texts
from tieout.sources.tables import table

#: Ranks of the example findings: what others follow from comes first.
RANKS = {"A statement is missing": 5, "Gross pay changed between the runs": 10, "Federal tax rose": 20}


def findings_list(spark: SparkSession, d: str) -> DataFrame:
    """Each employee's findings in one numbered text, by rank."""
    f = solve(reconcile.measures(spark, d), reconcile.RULES, keep=["pack_id", "id"], kinds={"label": "string", "amount": "double"})
    return ranked_list(f, ["pack_id", "id"], RANKS)


def arithmetic_sentences(spark: SparkSession, d: str) -> DataFrame:
    """What changed and what was promised, in words; parts that are missing are left out."""
    e = reconcile.measures(spark, d).where("net_change is not null or promised is not null")
    said = F.concat_ws("; ", F.concat(F.lit("net pay changed by "), F.when(F.col("net_change").isNotNull(), m.money(F.col("net_change")))), F.concat(F.lit("promised was "), F.when(F.col("promised").isNotNull(), m.money(F.col("promised")))), F.concat(F.lit("the gap is "), F.when(F.col("gap").isNotNull(), m.money(F.col("gap")))))
    return e.select("pack_id", "id", said.alias("sentence"))


def verdict_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each verdict in its pack."""
    e = reconcile.measures(spark, d)
    total = e.groupBy("pack_id").agg(F.count("*").alias("n_all"))
    return e.groupBy("pack_id", "verdict").agg(F.count("*").alias("n")).join(total, "pack_id").select("pack_id", "verdict", "n", F.round(F.col("n") / F.greatest(F.col("n_all"), F.lit(1)), 6).alias("share"))


def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Per pack, how many statements before the change have one after it of equal, near or no gross."""
    p = table(spark, d, "paycheck").select("pack_id", "run", "rec_id", "gross")
    state = matching.accounted(p.where("run = 'before'"), p.where("run = 'after'"), "pack_id", "gross")
    return state.groupBy("pack_id", "state").agg(F.count("*").alias("n"))


def score_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Fields read by place on statement pages against the register reader's: exact, unread or wrong."""
    codes = {"gross": "GROSS PAY", "federal": "FED W/H", "net_pay": "NET PAY", "retirement": "RETIREMENT", "fee": "EE FEE"}
    truth = texts.register_parse(spark, d).groupBy("doc_id", "code").agg(F.min_by("amount", "line_no").alias("truth"), F.count("*").alias("n")).where("n = 1")
    name = F.create_map(*(x for k, v in codes.items() for x in (F.lit(v), F.lit(k))))
    truth = truth.withColumn("field", F.try_element_at(name, F.col("code"))).where("field is not null")
    read = texts.page_fields(spark, d).groupBy(F.col("doc").alias("doc_id"), "field").agg(F.first("value").alias("value"))
    kind = F.when(F.col("value").isNull(), "unread").when(F.abs(F.col("value") - F.col("truth")) <= 0.005, "exact").otherwise("wrong")
    return truth.join(read, ["doc_id", "field"], "left").groupBy("field", kind.alias("outcome")).agg(F.count("*").alias("n"))


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents by kind: how many, how many different, how many repeat another."""
    k = table(spark, d, "documents").select(F.coalesce("kind", F.lit("")).alias("kind"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    one = k.groupBy("kind", "h").agg(F.count("*").alias("n"))
    return one.groupBy("kind").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_distinct"), F.sum(F.col("n") - 1).alias("n_repeats"))


def duplicates_removed(spark: SparkSession, d: str) -> DataFrame:
    """Statements of which one of each copy is kept: equal in all but their ids and load time; the first stands."""
    p = table(spark, d, "paycheck")
    key = [c for c in p.columns if c not in ("rec_id", "row_id", "loaded_at", "net_pay_disputed", "net_pay_unreliable")]
    h = p.select("rec_id", "pack_id", F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in key)), 256).alias("h"))
    return h.groupBy("pack_id", "h").agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("copies")).select("pack_id", "rec_id", "copies")


def union_of_families(spark: SparkSession, d: str) -> DataFrame:
    """Statements of all reader families in one table by family: counts and sums of gross; missing columns are null."""
    p = table(spark, d, "paycheck")
    known = ("page", "sheet", "register", "scanned")
    rest = ~F.coalesce(F.col("source"), F.lit("")).rlike("^(" + "|".join(known) + ")")
    parts = [p.where(F.col("source").startswith(k)).select("rec_id", "gross", F.lit(k).alias("family")) for k in known[:3]] + [p.where(F.col("source").startswith("scanned")).select("rec_id", F.lit("scanned").alias("family")), p.where(rest).select("rec_id", "gross", F.lit("other").alias("family"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.groupBy("family").agg(F.count("*").alias("n"), controls.exact_sum(F.col("gross")).alias("gross"))


QUERIES = {
    "findings_list": findings_list, "arithmetic_sentences": arithmetic_sentences, "verdict_shares": verdict_shares, "completeness_gate": completeness, "score_outcomes": score_outcomes, "store_stats": store_stats,
    "duplicates_removed": duplicates_removed, "union_families": union_of_families,
}

_MONEY = lambda x: f"(case when {x} < 0 then '-$' else '$' end || format('{{:,.2f}}', abs({x})))"
_RANK = "case label " + " ".join(f"when '{k}' then {v}" for k, v in RANKS.items()) + " else 45 end"
SQL = {
    "findings_list": reconcile._ALL + f", o as (select pack_id, id, label, min({_RANK}) as r, min(pos) as p from f group by all), n as (select *, row_number() over (partition by pack_id, id order by r, p, label) as i from o) select pack_id, id, count(*)::int as n, string_agg(i || '. ' || label, ' ' order by i) as findings from n group by all",
    "arithmetic_sentences": reconcile._MEASURES + f"select pack_id, id, concat_ws('; ', 'net pay changed by ' || {_MONEY('net_change')}, 'promised was ' || {_MONEY('promised')}, 'the gap is ' || {_MONEY('gap')}) as sentence from e where net_change is not null or promised is not null",
    "verdict_shares": reconcile._MEASURES + ", g as (select pack_id, verdict, count(*) as n from e group by all) select pack_id, verdict, n, round(n / greatest(sum(n) over (partition by pack_id), 1), 6) as share from g",
    "completeness_gate": "with b as (select rec_id, pack_id, gross::decimal(18,2) as g from paycheck where run = 'before'), a as (select distinct pack_id, gross::decimal(18,2) as g from paycheck where run = 'after' and gross is not null), x as (select b.rec_id, b.pack_id, b.g, min(abs(b.g - a.g)) as d from b left join a on a.pack_id = b.pack_id and abs(a.g - b.g) <= 1 group by all) select pack_id, case when g is null then 'unknown' when d = 0 then 'exact' when d <= 1 then 'near' else 'missing' end as state, count(*) as n from x group by all",
    "store_stats": "with o as (select coalesce(kind, '') as kind, md5(coalesce(text, '')) as h, count(*) as n from documents group by all) select kind, sum(n)::bigint as n_docs, count(*) as n_distinct, sum(n - 1)::bigint as n_repeats from o group by all",
    "union_families": "with u as (select case when starts_with(source, 'scanned') then 'scanned' else coalesce(nullif(regexp_extract(source, '^(page|sheet|register)'), ''), 'other') end as family, case when not coalesce(starts_with(source, 'scanned'), false) then gross end as gross from paycheck) select family, count(*) as n, sum(gross::decimal(18,2))::double as gross from u where family <> '' group by all",
}
SQL["duplicates_removed"] = "select pack_id, min(rec_id) as rec_id, count(*) as copies from paycheck group by " + ", ".join("pack_id client_code period run source gated name employee_id gross federal state state_code social_security medicare local local_code taxable_wages medicare_gross supplemental net_pay premium reimbursement fee product retirement cafeteria other_deductions other_total total_deductions retirement_insurance federal_unreliable w4_status w4_multijob w4_children w4_extra retirement_line".split())
