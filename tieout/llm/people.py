"""Which census rows are one employee: by the client's id, and for rows without one by name and figures."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.ids import same_id
from tieout.llm import names
from tieout.plans.lineage import cut

#: Figures that a repeated row of an employee carries again.
FIGURES = ("group_health_monthly", "other_monthly_pretax", "retirement_401k_monthly")
#: Least likeness of two names of one employee when a figure agrees.
LIKE = 0.85


def _typed(first: str, last: str):
    return F.trim(F.concat_ws(" ", F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(last, F.lit("")))))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """``names.name_likeness`` of typed names; null or empty names are like nothing."""
    return pd.Series([names.name_likeness(names.tokens(x or ""), names.tokens(y or "")) for x, y in zip(a, b)], dtype="float64")


def employee_groups(census: DataFrame) -> DataFrame:
    """(pack_id, rec_id, group_id, id): group_id is the smallest rec_id of the employee's rows in the pack.

    Rows with equal ids are one employee. A row without an id joins the employee of its pack whose name is like its own
    and who has the same pay, or nearly the same and an equal figure; of several the likest, then the smallest group.
    What is left is one employee per equal name and pay. Rows without a pack, name and id are employees of their own.

    Only rows without an id are compared, over equi-joins on (pack, pay) and (pack, sound of the name), so no bucket
    is the square of a group: its other side is distinct spellings."""
    rows = census.select("pack_id", "rec_id", same_id("employee_id").alias("id"), _typed("employee_first_name", "employee_last_name").alias("typed"), F.col("gross_annual_taxable_wages").alias("pay"), *FIGURES)
    sound = F.concat_ws("~", F.array_sort(F.transform(F.split(F.regexp_replace(F.lower("typed"), "[^a-z ]", ""), " +"), lambda t: F.soundex(t))))
    # Ids and sounds are worked out once; all that follows reads them.
    rows = cut(rows.withColumns({"sound": sound, "cents": F.round(F.col("pay") * 100).cast("long")}))
    known = rows.where("id is not null and pack_id is not null")
    label = known.groupBy("pack_id", "id").agg(F.min("rec_id").alias("group_id"))
    grouped = known.select("pack_id", "id", "rec_id").join(label, ["pack_id", "id"]).select("pack_id", "rec_id", "group_id", "id")
    bare = rows.where("id is null and pack_id is not null")
    facts = ["typed", "pay", *FIGURES]
    shapes = known.groupBy("pack_id", "id", *facts).agg(F.first("sound").alias("sound"), F.first("cents").alias("cents"))
    key = lambda df: df.withColumn("key", F.explode(F.array_compact(F.array(F.concat(F.lit("p"), "cents"), F.when(F.col("typed") != "", F.concat(F.lit("s"), "sound"))))))
    mine = bare.groupBy("pack_id", *facts, "sound", "cents").agg(F.min("rec_id").alias("shape"))
    theirs = key(shapes).select("pack_id", "key", "id", *(F.col(c).alias(f"their_{c}") for c in facts))
    pairs = key(mine).join(theirs, ["pack_id", "key"]).drop("key").distinct()
    same = F.coalesce(F.abs(F.col("pay") - F.col("their_pay")) < 0.005, F.lit(False))
    near = F.coalesce(F.abs(F.col("pay") - F.col("their_pay")) < 0.1 * F.col("pay"), F.lit(True))
    figures = sum((F.coalesce((F.col(c) == F.col(f"their_{c}")) & (F.col(c) > 0), F.lit(False)).cast("int") for c in FIGURES), F.lit(0))
    scored = pairs.withColumn("like", likeness("typed", "their_typed")).withColumn("figures", figures)
    fits = scored.where(((F.col("like") >= LIKE) & (same | (near & (figures > 0)))) | ((F.col("like") >= 0.99) & near))
    best = (
        fits.withColumn("score", F.col("like") + F.when(same, 0.3).otherwise(0.0) + 0.1 * F.col("figures"))
        .join(label, ["pack_id", "id"])
        .groupBy("pack_id", "shape")
        .agg(F.max(F.struct("score", (-F.col("group_id")).alias("less"), "id")).alias("top"))
        .select("pack_id", "shape", (-F.col("top.less")).alias("group_id"), F.col("top.id").alias("id"))
    )
    # Every bare row through its shape: nulls are equal here, so the join is on null-safe equality.
    shape = mine.select(F.col("pack_id").alias("_pack"), *(F.col(c).alias(f"_{c}") for c in facts), "shape")
    own = bare.join(shape, (F.col("pack_id") == F.col("_pack")) & F.col("typed").eqNullSafe(F.col("_typed")) & F.col("pay").eqNullSafe(F.col("_pay")) & _all_same(FIGURES)).select("pack_id", "rec_id", "typed", "pay", "shape")
    placed = own.join(best, ["pack_id", "shape"], "left")
    alone = F.when(F.col("typed") == "", F.col("rec_id").cast("string")).otherwise(F.lower("typed"))
    first = placed.where("group_id is null").groupBy("pack_id", alone.alias("name"), "pay").agg(F.min("rec_id").alias("first"))
    rest = placed.where("group_id is null").withColumn("name", alone).alias("r").join(first.alias("f"), (F.col("r.pack_id") == F.col("f.pack_id")) & (F.col("r.name") == F.col("f.name")) & F.col("r.pay").eqNullSafe(F.col("f.pay"))).select("r.pack_id", "r.rec_id", F.col("f.first").alias("group_id"), F.lit(None).cast("string").alias("id"))
    joined = placed.where("group_id is not null").select("pack_id", "rec_id", "group_id", "id").unionByName(rest)
    lost = rows.where("pack_id is null").select("pack_id", "rec_id", F.col("rec_id").alias("group_id"), "id")
    every = grouped.unionByName(joined)
    # A bare row may be the smallest of its group.
    smallest = joined.where("id is not null").groupBy("pack_id", F.col("group_id")).agg(F.min("rec_id").alias("less"))
    return (
        every.join(smallest, ["pack_id", "group_id"], "left")
        .select("pack_id", "rec_id", F.least("group_id", F.coalesce("less", "group_id")).alias("group_id"), "id")
        .unionByName(lost)
    )


def _all_same(columns):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out
