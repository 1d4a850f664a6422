from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tieout.operators.units import InconsistentUnits, UnitGraph, amount, common_units, converted, frequency, payroll_units, period


def test_cycles_are_checked():
    with pytest.raises(InconsistentUnits):
        UnitGraph([("a", "b", 2, 0), ("b", "c", 3, 0), ("a", "c", 5, 0)])
    with pytest.raises(InconsistentUnits):
        UnitGraph([("a", "b", 0, 0)])
    g = UnitGraph([("c", "f", Fraction(9, 5), 32), ("k", "c", 1, Fraction(-27315, 100))])
    assert g.convert("k", "f") == (Fraction(9, 5), Fraction(-27315, 100) * Fraction(9, 5) + 32)
    assert g.convert("k", "none") is None


@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("wxyz"), st.integers(1, 9)), min_size=1, max_size=6))
@settings(max_examples=30, deadline=None)
def test_there_and_back(edges):
    seen, kept = set(), []
    for a, b, f in edges:
        if b not in seen:
            seen.add(b)
            kept.append((a, b, f, 1))
    g = UnitGraph(kept)
    for a, b, f, o in kept:
        up, down = g.convert(a, b), g.convert(b, a)
        assert (up[0] * down[0], down[0] * up[1] + down[1]) == (1, 0) and up == (f, o)


def test_payroll_units_are_consistent():
    g = payroll_units()
    assert g.convert("thousand/week", "cent/month") == (Fraction(5200000, 12), 0)
    assert g.convert("dollar/quarter", "cent/year") == (400, 0)


@pytest.mark.parametrize("text,want", [("$1,234.56", 1234.56), ("22.061,30", 22061.30), ("2 460.36", 2460.36), ("4,062,081 cents", 4062081), ("12,5", 12.5), ("58.4 thousand", 58.4), ("(12.50)", -12.5), ("-3", -3), ("TBD", None), ("", None), (None, None), ("1.234.567", 1234567), ("3,744 2x month", 3744), ("1 226.73 each cheque", 1226.73), ("9872 24 cheques", 9872), ("12 345 678", 12345678)])
def test_amount(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(amount(F.col("t"))).first()[0]
    assert got == want if want is None else float(got) == want


@pytest.mark.parametrize("text,want", [("semi-monthly", "half_month"), ("bi-weekly", "fortnight"), ("/2wk", "fortnight"), ("p.m.", "month"), ("p.a.", "year"), ("pp", "pay"), ("/qtr", "quarter"), ("weekly", "week"), ("every payday", "pay"), ("dollars", None), ("same as last year", None), ("each year", "year")])
def test_period(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(period(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text,want", [("26 pays a year", "fortnight"), ("52", "week"), ("paid Semimonthly", "half_month"), ("1st & 16th", "half_month"), ("alternate Thursdays", "fortnight"), ("every Friday", "week"), ("last working day of the month", "month"), ("MTH", "month"), ("", None), (None, None), ("13", None), ("n/a", None), ("same as last year", None), ("once a year", "year")])
def test_frequency(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(frequency(F.col("t"))).first()[0] == want


def test_common_units(spark):
    rows = spark.createDataFrame(
        [
            (1, 1, "employee_monthly_allotment", "1,057.38 $/yr", None, "x"), (2, 2, "gross_annual_taxable_wages", "0.59", "A WEEK", None), (3, 1, "employee_monthly_allotment", "11675", "/check", None),
            (4, 1, "employee_monthly_allotment", "100", "per pay", "BW"), (5, 1, "gross_annual_taxable_wages", "$31.55/hr x 30 h weekly", None, ""), (6, 1, "gross_annual_taxable_wages", "36.50", "/hr, 1560 hours a year", None),
            (7, 1, "pay_frequency", "paid twice a month", None, None), (8, 3, "gross_annual_taxable_wages", "12,345", None, None), (9, 1, "gross_annual_taxable_wages", "#REF!", "/mo", "12"), (10, 99, "gross_annual_taxable_wages", "1", None, None), (11, 1, "other", "1", None, None), (12, None, None, None, None, None),
        ],
        "reading_id long, source_id int, field string, value_text string, unit_text string, pay_frequency string",
    )
    sources = spark.createDataFrame([(1, ""), (2, "salaries in $000"), (3, "all money in whole cents"), (4, None)], "source_id int, note string")
    got = {r.reading_id: r.common_value for r in common_units(rows, sources).collect()}
    assert got == {1: 8812, 2: 3068000, 4: 21667, 5: 4921800, 6: 5694000, 7: 24, 8: 12345, 10: 100}


@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 999)), min_size=1, max_size=20))
@settings(max_examples=10, deadline=None)
def test_half_up_is_exact(spark, cases):
    rows = spark.createDataFrame([(i, f"u{d}", "t", v) for i, (v, d) in enumerate(cases)], "i long, unit string, target string, v long").withColumn("v", (F.col("v") / 100).cast("decimal(20,2)"))
    table = spark.createDataFrame([(f"u{d}", "t", 7, d, 0) for d in {d for _, d in cases}], "unit string, target string, num long, den long, shift_num long")
    got = {r.i: r.common_value for r in converted(rows, table, value="v", unit="unit", target="target").collect()}
    for i, (v, d) in enumerate(cases):
        x = Fraction(v, 100) * 7 / d
        assert got[i] == (2 * x + 1).__floor__() // 2
