"""Registers in columns over the statements: printed, read back, gated, with pay assignments; twins read the statements."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.sources import columns as reader
from tieout.sources.tables import table

FIELDS = {"gross": "gross", "stand": "gross", "suppl": "supplemental", "net": "net_pay", "wh_gross": "taxable_wages", "wh_tax": "federal", "cafe": "cafeteria", "other_ded": "other_total", "med_gross": "medicare_gross", "med_tax": "medicare", "fica_tax": "social_security", "trs_dep": "retirement"}
CODES = {"101": "premium", "102": "reimbursement", "103": "fee", "104": "product"}
#: Statements of a printed register: registers are pages, not whole tables, so that no text grows with the data.
PAGE = 200


def _statements(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paycheck").select("rec_id", "name", *dict.fromkeys([*FIELDS.values(), *CODES.values()]))
    letters = F.regexp_replace(F.upper(F.coalesce("name", F.lit(""))), "[^A-Z]", "")
    named = F.concat(F.when(letters == "", "NOBODY").otherwise(letters), F.lit(", X"))
    return p.withColumns({"doc_id": F.floor(F.col("rec_id") / PAGE), "line_key": F.col("rec_id"), "printed_name": named, "number": F.lpad(F.pmod("rec_id", F.lit(100_000_000)).cast("string"), 8, "0")})


def _printed(spark: SparkSession, d: str) -> DataFrame:
    return reader.printed(_statements(spark, d), "doc_id", FIELDS, CODES)


def columns_register(spark: SparkSession, d: str) -> DataFrame:
    """Every statement as it is read from registers in columns: figures by place, deductions by code."""
    e = reader.employees(_printed(spark, d))
    code = lambda k: F.aggregate(F.filter("deductions", lambda x: x["code"] == k), F.lit(0.0), lambda a, x: a + x["amount"])
    return e.select("doc_id", "number", "census_key", "marital", "gross", "net", "wh_tax", "med_tax", "fica_tax", "suppl", F.size("deductions").alias("n_codes"), *(code(k).alias(v) for k, v in CODES.items()))


def columns_gate(spark: SparkSession, d: str) -> DataFrame:
    """The printed totals of registers in columns against their employees, where every seventh register's net total is
    misprinted by three cents and every eleventh lacks its Medicare total."""
    docs = _printed(spark, d)
    net = F.regexp_extract("text", r"Net Pay:\s+(-?[\d,]*\.\d\d)", 1)
    wrong = F.format_number(F.replace(net, F.lit(","), F.lit("")).try_cast("double") + 0.03, 2)
    text = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.replace("text", F.concat(F.lit("Net Pay:   "), net), F.concat(F.lit("Net Pay:   "), wrong))).otherwise(F.col("text"))
    text = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.regexp_replace(text, "Medicare Tax:[^\n]*", "")).otherwise(text)
    return reader.gate(docs.select("doc_id", text.alias("text")))


def columns_tied(spark: SparkSession, d: str) -> DataFrame:
    """How many employees a strict reader takes of each register, all of whose controls tie."""
    return reader.tied(_printed(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """Statements printed with their pay assignments: the regular one, and one for supplemental pay that no tax line has."""
    p = table(spark, d, "paycheck").select("rec_id", F.coalesce("gross", F.lit(0.0)).alias("g"), F.coalesce("federal", F.lit(0.0)).alias("f"), F.coalesce("supplemental", F.lit(0.0)).alias("s"), F.coalesce("taxable_wages", F.lit(0.0)).alias("w"))
    usd = lambda c: F.format_number(c, 2)
    pays = F.when(F.pmod("rec_id", F.lit(3)) == 0, "13").otherwise("12")
    asg = lambda code, gross: F.concat(F.lit(f"  ** R {code} REGULAR PAY  1.0000  1.0  "), usd(gross), F.lit("  199-11  26 "), pays, F.lit(" 05/14/2024 05/15/2024"))
    tax = F.concat(F.lit("    D 1WH FEDERAL  "), usd(F.col("f")), F.lit("  1  base  "), usd(F.col("w")))
    other = F.concat(F.lit("    D 2SS SOCIAL  "), usd(F.col("f")), F.lit("  1  base  "), usd(F.col("w")))
    text = F.concat_ws("\n", F.concat(F.lit("EMPLOYEE X   ID E"), F.col("rec_id").cast("string"), F.lit("   PERIOD 05/14")), asg("101", F.col("g")), tax, other, F.when(F.col("s") != 0, asg("205", F.col("s"))))
    docs = p.select(F.floor(F.col("rec_id") / PAGE).alias("doc_id"), F.struct("rec_id", text.alias("t")).alias("x"))
    return docs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


def pay_assignments(spark: SparkSession, d: str) -> DataFrame:
    """What the pay assignments of each cheque add up to, and whether they tie to the tax that the statement prints."""
    c = reader.cheques(reader.assignments(_assigned(spark, d))).withColumn("rec_id", F.regexp_extract("id", r"E(\d+)", 1).cast("long"))
    p = table(spark, d, "paycheck").select("rec_id", F.coalesce("federal", F.lit(0.0)).alias("printed"))
    return c.join(p, "rec_id").select("rec_id", "gross", "fed", "base", "rate", "pays", "excluded", (F.abs(F.col("fed") - F.col("printed")) < 0.02).alias("fed_ok"))


QUERIES = {"columns_register": columns_register, "columns_gate": columns_gate, "columns_tied": columns_tied, "pay_assignments": pay_assignments}

_Z = lambda c: f"coalesce({c}, 0.0)"
_KEY = "case when regexp_replace(upper(coalesce(name, '')), '[^A-Z]', '', 'g') = '' then 'NOBODY' else regexp_replace(upper(coalesce(name, '')), '[^A-Z]', '', 'g') end"
_CODE = lambda c: f"case when {c} <> 0 then {c} else 0.0 end"
_SUMS = ", ".join(f"sum({_Z(FIELDS.get(c, '0.0'))}::decimal(18,2))::double as {c}" for c in reader.TOTALS)
SQL = {
    "columns_register": f"select rec_id // {PAGE} as doc_id, lpad((rec_id % 100000000)::varchar, 8, '0') as number, substring({_KEY}, 1, 5) || 'X' as census_key, 'S' as marital, {_Z('gross')} as gross, {_Z('net_pay')} as net, {_Z('federal')} as wh_tax, {_Z('medicare')} as med_tax, {_Z('social_security')} as fica_tax, {_Z('supplemental')} as suppl, "
    + " + ".join(f"coalesce(({c} <> 0)::int, 0)" for c in CODES.values()) + " as n_codes, " + ", ".join(f"coalesce({_CODE(c)}, 0.0) as {c}" for c in CODES.values()) + " from paycheck",
    "columns_gate": f"with s as (select rec_id // {PAGE} as doc_id, {_SUMS} from paycheck group by all), u as (" + " union all ".join(f"select doc_id, '{c}' as control, {c} as parsed, {c} + case when '{c}' = 'net' and doc_id % 7 = 0 then 0.03 else 0.0 end as printed from s" + (" where doc_id % 11 <> 0" if c == "med_tax" else "") for c in reader.TOTALS if c in FIELDS) + ") select doc_id, control, parsed, round(printed, 2) as printed, abs(parsed - printed) <= 0.020000001 as ok from u",
    "columns_tied": f"select rec_id // {PAGE} as doc_id, count(*) as n from paycheck group by all",
    "pay_assignments": f"select rec_id, {_Z('gross')} + {_Z('supplemental')} as gross, {_Z('federal')} as fed, {_Z('taxable_wages')} as base, coalesce(round(case when {_Z('taxable_wages')} <> 0 then {_Z('federal')} / {_Z('taxable_wages')} end, 6) + 0.0, 0.0) as rate, case when rec_id % 3 = 0 then 13.0 else 12.0 end::double as pays, case when {_Z('supplemental')} <> 0 then '205' else '' end as excluded, true as fed_ok from paycheck",
}
