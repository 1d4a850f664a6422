"""Operators over ordered rows: owners carried forward, neighbours, islands, smoothing, latest values."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carried(value: Column, within: Sequence[str], order: Sequence[str]) -> Column:
    """The last value that is not null up to this row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def ahead(value: Column, n: int, within: Sequence[str], order: Sequence[str]) -> Column:
    """The value ``n`` rows on."""
    return F.lead(value, n).over(W.partitionBy(*within).orderBy(*order))


def islands(value: Column, gap: Column | float, within: Sequence[str], order: Sequence[str]) -> Column:
    """The ordinal of the run that a row is in: a run ends where the value grows by more than ``gap``."""
    w = W.partitionBy(*within).orderBy(*order)
    starts = F.when(value - F.lag(value).over(w) > gap, 1).otherwise(0)
    return starts


def island_numbers(rows: DataFrame, value: Column, gap: float, within: Sequence[str], order: Sequence[str], out: str = "island") -> DataFrame:
    """``rows`` with ``out``, the run of each; one sort serves both windows."""
    w = W.partitionBy(*within).orderBy(*order)
    return rows.withColumn("_new", islands(value, gap, within, order)).withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")


def smoothed(value: Column, reach: int, within: Sequence[str], order: Sequence[str]) -> Column:
    """The mean of a row and ``reach`` rows on either side, as many as there are."""
    return F.avg(value).over(W.partitionBy(*within).orderBy(*order).rowsBetween(-reach, reach))


def effective(machine: DataFrame, corrections: DataFrame, key: Sequence[str], value: str, at: Sequence[str]) -> DataFrame:
    """Machine values with their latest corrections: key, ``value``, ``corrected``. Corrections to what the machine never
    read stand too. Of corrections at one time the greatest value; an append-only log never changes what was read."""
    latest = corrections.groupBy(*key).agg(F.max_by(value, F.struct(*at, value)).alias("_fix"), F.lit(True).alias("_has"))
    joined = machine.select(*key, value).join(latest, list(key), "full")
    return joined.select(*key, F.when(F.col("_has"), F.col("_fix")).otherwise(F.col(value)).alias(value), F.coalesce("_has", F.lit(False)).alias("corrected"))


def top_rows(rows: DataFrame, within: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps only that many per group before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*within).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def runs(rows: DataFrame, kind: Column, by: Sequence[str], order: Sequence[str], name: str = "run") -> DataFrame:
    """``rows`` with ``name``: the number of the run of equal ``kind`` that a row is in, in its order; nulls are equal."""
    w = W.partitionBy(*by).orderBy(*order)
    begins = ~kind.eqNullSafe(F.lag(kind).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("_b", begins.cast("int")).withColumn(name, F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_b")


def blocks(rows: DataFrame, ends: Column, by: Sequence[str], order: str, name: str = "block") -> DataFrame:
    """``rows`` with ``name``: the number of the block that a row is in, blocks ending with the rows for which ``ends``
    holds (as a subtotal ends its lines); rows behind the last end are in a block of their own."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(F.coalesce(ends, F.lit(False)).cast("int")).over(w), F.lit(0)))
