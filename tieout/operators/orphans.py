"""References to records that do not exist, at the time of the reference."""

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Far beyond any load time: an open end.
OPEN_END = "9999-12-31 00:00:00"


def answer_spans(parents: DataFrame, keys: Sequence[str], loaded: str, withdrawn: str) -> DataFrame:
    """One row per key with ``_orphan_spans``, an array of (from, to) in which some parent of that key is valid.

    Aggregated twice, first on (key, load time), with partial aggregation before either shuffle, so that a key with any
    number of parents becomes at most as many spans as it has load times."""
    longest = F.max(F.coalesce(F.col(withdrawn).cast("timestamp"), F.to_timestamp(F.lit(OPEN_END))))
    return (
        parents.where(F.col(loaded).isNotNull())
        .groupBy(*keys, F.col(loaded).cast("timestamp").alias("_from"))
        .agg(longest.alias("_to"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("_from", "_to")).alias("_orphan_spans"))
    )


def _reason(spans: Column, at: Column) -> Column:
    begun = F.exists(spans, lambda s: s["_from"] <= at)
    valid = F.exists(spans, lambda s: (s["_from"] <= at) & (s["_to"] > at))
    return F.when(spans.isNull(), "missing").when(~begun, "late").when(~valid, "deleted")


def orphans(
    refs: DataFrame,
    parents: DataFrame,
    keys: Sequence[tuple[str, str]],
    *,
    at: str,
    loaded: str,
    withdrawn: str,
    match: str = "simple",
) -> DataFrame:
    """The rows of ``refs`` that no parent answers at the time ``at``, with their columns and ``reason``.

    ``keys``: pairs (column of refs, column of parents). The rows are split by null mask, the set of key columns that
    are null, and each mask is joined on its other columns alone, under the declared match:

    - ``simple``: a row with any null key refers to nothing and is no orphan;
    - ``full``: a row with all keys null refers to nothing; one with some null has reason ``partial``;
    - ``partial``: a null key matches anything; a row with all keys null refers to nothing.

    reason: ``missing`` = no parent has the key, ``late`` = all were loaded after ``at``, ``deleted`` = some were loaded
    by then, and all those withdrawn. A parent without a load time is never loaded, hence as if it weren't there. A
    reference without a time is judged at the end of time. Parents with a null key answer no key column that they lack.
    Repeated rows count each. Parent columns never mix with the columns of ``refs``, whatever their names."""
    if match not in ("simple", "full", "partial"):
        raise ValueError(f"match {match!r}")
    parts = []
    for mask in product((False, True), repeat=len(keys)):
        if all(mask) or (match == "simple" and any(mask)):
            continue
        rows = refs.where(reduce(lambda a, b: a & b, (F.col(f"`{r}`").isNull() if m else F.col(f"`{r}`").isNotNull() for (r, _), m in zip(keys, mask))))
        if match == "full" and any(mask):
            parts.append(rows.withColumn("reason", F.lit("partial")))
            continue
        used = [k for k, m in zip(keys, mask) if not m]
        own = [f"_orphan_key{i}" for i in range(len(used))]
        named = parents.select(*(F.col(f"`{p}`").alias(o) for (_, p), o in zip(used, own)), F.col(loaded).alias("_loaded"), F.col(withdrawn).alias("_withdrawn")).dropna(subset=own)
        spans = answer_spans(named, own, "_loaded", "_withdrawn")
        when = F.coalesce(F.col(at).cast("timestamp"), F.to_timestamp(F.lit(OPEN_END)))
        joined = rows.join(spans, reduce(lambda a, b: a & b, (F.col(f"`{r}`") == F.col(o) for (r, _), o in zip(used, own))), "left")
        parts.append(joined.withColumn("reason", _reason(F.col("_orphan_spans"), when)).where("reason is not null").drop("_orphan_spans", *own))
    return reduce(DataFrame.unionByName, parts)
