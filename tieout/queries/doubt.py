"""What doubtful readings mean for the measures: deviations of readings, suspects and likely readings of statements that
don't tie, and the measures once what is decisive is corrected."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.ids import same_id
from tieout.operators import controls, estimate
from tieout.plans.lineage import cut
from tieout.queries import full, reconcile
from tieout.sources.tables import table

#: Deviations of a calibration, by field: an example of what a calibration gives.
CALIBRATED = {"gross": 0.05, "federal": 0.12, "net_pay": 0.04, "taxable_wages": 0.08}
SD_FIELDS = ("gross", "federal", "medicare", "net_pay", "taxable_wages")
#: Employees whose identity gap is over this are examined; a correction is one of more than this many dollars.
GAP, CORRECTION = 2.0, 0.02


def reading_deviations(spark: SparkSession, d: str) -> DataFrame:
    """The deviation that each reading of a statement is given; taxable wages that aren't printed are derived."""
    p = table(spark, d, "paycheck").withColumns({"_derived": F.col("taxable_wages").isNull() & F.col("medicare_gross").isNotNull(), "_page": F.col("source").startswith("page"), "taxable_wages": F.coalesce("taxable_wages", "medicare_gross")})
    rows = controls.unpivoted(p, ["rec_id", "_derived", "_page"], list(SD_FIELDS))
    return rows.select("rec_id", "field", estimate.observation_sd(F.col("field"), CALIBRATED, F.col("_derived") & (F.col("field") == "taxable_wages"), F.col("_page")).alias("sd"))


def uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """(pack_id, id, run, rec_id, identity_gap, suspect, field, value, p, decisive): for employees whose statements miss
    their identity by over two dollars, each statement with its suspect and the likely reading of every figure in doubt.
    Only these employees' statements are fitted."""
    e = full.measures_full(spark, d).where(F.abs("identity_gap") > GAP).select("pack_id", "id", "identity_gap", F.explode(F.array(F.struct(F.lit("before").alias("run"), F.col("b_rec_id").alias("rec_id")), F.struct(F.lit("after").alias("run"), F.col("a_rec_id").alias("rec_id")))).alias("s"))
    asked = cut(e.select("pack_id", "id", "identity_gap", "s.run", "s.rec_id").where("rec_id is not null"))
    p = table(spark, d, "paycheck").select("rec_id", *estimate.FIELDS, *estimate.UNFITTED).join(asked.select("rec_id", "pack_id", "id"), "rec_id")
    c = reconcile._census(spark, d).select("pack_id", "id", (F.col("gross_annual_taxable_wages") / F.col("pp")).alias("e_gross"), (F.col("retirement_401k_monthly") * 12 / F.col("pp")).alias("e_retirement"))
    p = cut(p.join(c, ["pack_id", "id"], "left"))
    likely = estimate.readings(p, "rec_id", {"gross": ("e_gross", 10.0), "retirement": ("e_retirement", 2.0)})
    suspects = estimate.fits(p, "rec_id").select("rec_id", "suspect")
    return asked.join(suspects, "rec_id", "left").join(likely, "rec_id", "left").select("pack_id", "id", "run", "rec_id", "identity_gap", "suspect", "field", "value", "p", "decisive")


def corrected_measures(spark: SparkSession, d: str) -> DataFrame:
    """The measures once every decisive reading of a statement that doesn't tie stands for what was read: one pass, as a
    correction never begets another; ``n_corrected`` is how many figures of the employee's statements were corrected."""
    figures = [f for f in full.RUN if f in estimate.FIELDS]
    fixes = cut(uncertainty(spark, d).where("decisive").where(F.col("field").isin(*figures)).groupBy("rec_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in figures)))
    p = table(spark, d, "paycheck").select("pack_id", "employee_id", "run", "rec_id", *full.RUN).join(fixes, "rec_id", "left")
    new = {f: F.when(F.abs(F.col(f"_{f}") - F.col(f)) > CORRECTION, F.col(f"_{f}")).otherwise(F.col(f)) for f in figures}
    n = sum((F.coalesce(F.abs(F.col(f"_{f}") - F.col(f)) > CORRECTION, F.lit(False)).cast("int") for f in figures), F.lit(0))
    p = cut(p.withColumn("_n", n).withColumns(new).drop(*(f"_{f}" for f in figures)))
    fixed = p.where("_n > 0").select("rec_id", "_n")
    m = full.measures_full(spark, d, p.drop("_n")).select("pack_id", "id", "b_rec_id", "a_rec_id", *full.MEASURES)
    for run in "ba":
        m = m.join(fixed.select(F.col("rec_id").alias(f"{run}_rec_id"), F.col("_n").alias(f"_{run}")), f"{run}_rec_id", "left")
    return m.select("pack_id", "id", *full.MEASURES, (F.coalesce("_b", F.lit(0)) + F.coalesce("_a", F.lit(0))).alias("n_corrected"))


def suspect_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many statements of each run, of those that an id is known for, each figure is the suspect of."""
    p = table(spark, d, "paycheck").where(same_id("employee_id").isNotNull())
    return estimate.fits(p, "rec_id").where("suspect is not null").join(p.select("rec_id", "run"), "rec_id").groupBy("run", "suspect").agg(F.count("*").alias("n"))


QUERIES = {"reading_deviations": reading_deviations, "uncertainty": uncertainty, "corrected_measures": corrected_measures, "suspect_counts": suspect_counts}
_SD = lambda f: str(CALIBRATED.get(f, estimate.READ_SD))
SQL = {
    "reading_deviations": " union all ".join(
        f"select rec_id, '{f}' as field, case when starts_with(source, 'page') then least({x}, {estimate.READ_SD}) else {x} end::double as sd from paycheck where {v} is not null"
        for f, v, x in ((f, "coalesce(taxable_wages, medicare_gross)" if f == "taxable_wages" else f, f"(case when taxable_wages is null and medicare_gross is not null then 2 else 1 end * {_SD(f)})" if f == "taxable_wages" else _SD(f)) for f in SD_FIELDS)
    )
}
