"""Control totals: what was parsed against what was printed."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_sum(c: Column) -> Column:
    """A sum of money that doesn't depend on the order of rows."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def control_totals(rows: DataFrame, source: Sequence[str], controls: Mapping[str, Column], printed: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(source, control, parsed, printed, ok) of each control that ``printed`` (source, control, printed) has. One pass
    computes all controls of a source; they become rows beside it. A source without rows parses to null and fails."""
    one = rows.groupBy(*source).agg(*(c.alias(k) for k, c in controls.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("control"), F.col(k).cast("double").alias("parsed")) for k in controls))
    long = one.select(*source, F.explode(pairs).alias("_c")).select(*source, "_c.*")
    return printed.join(long, [*source, "control"], "left").select(*source, "control", "parsed", "printed", F.coalesce(F.abs(F.col("parsed") - F.col("printed")) <= tolerance, F.lit(False)).alias("ok"))


def gate(checked: DataFrame) -> None:
    """Raises if any control fails, naming up to ten."""
    bad = checked.where(~F.col("ok")).limit(10).collect()
    if bad:
        raise ValueError("controls don't tie: " + "; ".join(str(r.asDict()) for r in bad))


def unpivoted(rows: DataFrame, keep: Sequence[str], fields: Sequence[str], name: str = "field", value: str = "value") -> DataFrame:
    """One row per field that is not null."""
    return rows.select(*keep, F.explode(F.array(*(F.struct(F.lit(f).alias(name), F.col(f).cast("double").alias(value)) for f in fields))).alias("_u")).select(*keep, "_u.*").where(F.col(value).isNotNull())


def robust_scale(errors: DataFrame, within: Sequence[str], error: str, near: float = 1.0, floor: float = 0.05) -> DataFrame:
    """(within, n, sd, outlier_rate, typical_wrong_by): spread of small errors as 1.4826 times the median distance from
    their median, ``floor`` at least; the share of larger ones and their median size."""
    small = errors.where(F.abs(error) <= near)
    centre = small.groupBy(*within).agg(F.median(error).alias("_m"))
    spread = small.join(centre, list(within)).groupBy(*within).agg(F.median(F.abs(F.col(error) - F.col("_m"))).alias("_mad"))
    rest = errors.groupBy(*within).agg(F.count(error).alias("n"), F.count_if(F.abs(error) > near).alias("_big"), F.median(F.when(F.abs(error) > near, F.abs(error))).alias("typical_wrong_by"))
    return rest.join(spread, list(within), "left").select(*within, "n", F.round(F.greatest(F.lit(floor), F.coalesce(F.col("_mad") * 1.4826, F.lit(floor))), 6).alias("sd"), F.round(F.try_divide(F.col("_big"), F.col("n")), 6).alias("outlier_rate"), "typical_wrong_by")
