from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tieout.functions.ids import same_id
from tieout.operators.orphans import orphans

T = datetime


def frames(spark):
    refs = spark.createDataFrame(
        [(1, 1, "A1", T(2024, 1, 5), "x"), (2, 1, "A2", T(2024, 1, 5), "x"), (3, 1, "A3", T(2024, 1, 5), "x"), (4, 1, None, T(2024, 1, 5), "x"), (5, None, None, T(2024, 1, 5), "x"), (6, 1, "A9", None, "x"), (7, 1, "A1", T(2024, 1, 5), "x"), (8, 1, "A4", T(2024, 1, 5), "x")],
        "ref int, pack int, id string, at timestamp, spans string",
    )
    parents = spark.createDataFrame(
        [(1, "A1", T(2024, 1, 1), None), (1, "A2", T(2024, 1, 1), T(2024, 1, 3)), (1, "A2", T(2024, 1, 2), T(2024, 1, 4)), (1, "A3", T(2024, 2, 1), None), (1, None, T(2024, 1, 1), None), (1, "A4", None, None), (1, "A1", T(2024, 1, 1), None)],
        "pack int, id string, loaded timestamp, withdrawn timestamp",
    )
    return refs, parents


def found(df):
    return {r.ref: r.reason for r in df.collect()}


def run(spark, match):
    refs, parents = frames(spark)
    return orphans(refs.withColumn("_loaded", F.lit(1)).withColumn("loaded", F.lit("x")), parents, [("pack", "pack"), ("id", "id")], at="at", loaded="loaded", withdrawn="withdrawn", match=match)


def test_reasons_simple(spark):
    assert found(run(spark, "simple")) == {2: "deleted", 3: "late", 6: "missing", 8: "missing"}


def test_full_and_partial(spark):
    assert found(run(spark, "full"))[4] == "partial" and 5 not in found(run(spark, "full"))
    partial = found(run(spark, "partial"))
    assert 4 not in partial and 5 not in partial and partial[6] == "missing"


def test_withdrawn_at_the_instant(spark):
    refs = spark.createDataFrame([(1, 1, T(2024, 1, 3)), (2, 1, T(2024, 1, 2))], "ref int, k int, at timestamp")
    parents = spark.createDataFrame([(1, T(2024, 1, 2), T(2024, 1, 3))], "k int, loaded timestamp, withdrawn timestamp")
    assert found(orphans(refs, parents, [("k", "k")], at="at", loaded="loaded", withdrawn="withdrawn")) == {1: "deleted"}


def test_empty_tables_and_repeats(spark):
    refs, parents = frames(spark)
    refs = refs.drop("spans")
    args = {"at": "at", "loaded": "loaded", "withdrawn": "withdrawn"}
    assert orphans(refs.limit(0), parents, [("pack", "pack"), ("id", "id")], **args).count() == 0
    none = orphans(refs.unionAll(refs), parents.limit(0), [("pack", "pack"), ("id", "id")], **args)
    assert none.count() == 12 and {r.reason for r in none.collect()} == {"missing"}


def test_unknown_match(spark):
    with pytest.raises(ValueError):
        run(spark, "other")


@pytest.mark.parametrize("a,b", [("001207", "1207"), ("E1257 ", "e1257"), ("1207.0", "1207"), ("HR-20852", "hr20852"), ("0000", None), ("none", None), (None, None), ("", None), ("12.05", "1205")])
def test_same_id(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(same_id("a").alias("a"), same_id("b").alias("b")).first()
    assert row.a == row.b
