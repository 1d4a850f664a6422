import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tieout.functions import money as m
from tieout.functions import text as t


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("text,want", [("$1,234.50", 1234.5), ("(12)", -12), ("-3.5", -3.5), ("abc", None), ("", None), (None, None), ("1e3", 1000)])
def test_number(spark, text, want):
    assert one(spark, text, m.number) == want


@pytest.mark.parametrize("text,want", [("12.34-", -12.34), ("(5.00)", -5), (".00", 0), ("1.234", None), ("$ 7", 7), ("x", None), (None, None)])
def test_printed_amount(spark, text, want):
    assert one(spark, text, m.printed_amount) == want


def test_first_cents(spark):
    assert one(spark, "NET —12.50 99.10", m.first_cents) == -12.5 and one(spark, "none", m.first_cents) is None


def test_rounding_and_months(spark):
    assert one(spark, 2.675, m.r2, "double") == 2.68 and one(spark, None, m.r2, "double") is None
    assert one(spark, -0.0, m.r2, "double") == 0.0
    assert one(spark, 100.0, lambda x: m.per_month(x, F.lit(26)), "double") == 216.67 and one(spark, 100.0, lambda x: m.per_month(x, F.lit(0)), "double") is None


def test_plausible(spark):
    assert one(spark, 50.0, lambda x: m.plausible(x, F.lit(100.0), 0, 0.45), "double") is None
    assert one(spark, -50.0, lambda x: m.plausible(x, F.lit(100.0), 0, 0.45), "double") == -50 and one(spark, 50.0, lambda x: m.plausible(x, F.lit(0.0), 0, 0.45), "double") == 50


def test_consensus_and_mode(spark):
    c = lambda *v: spark.range(1).select(m.consensus([F.lit(x).cast("double") for x in v])).first()[0]
    assert c(1.0, 2.0, 2.01) == 2.0 and c(1.0, 2.0, 3.0) is None and c(None, None, 1.0) is None and c(5.0, None, 5.02) == 5.0
    mode = lambda *v: spark.range(1).select(m.modal(F.array(*(F.lit(x).cast("double") for x in v)))).first()[0]
    assert mode(1.0, 2.0, 2.0) == 2.0 and mode(3.0, 1.0) == 3.0
    assert spark.range(1).select(m.agreeing_mean([F.lit(10.0), F.lit(11.0), F.lit(50.0), F.lit(None).cast("double")], 2.0)).first()[0] == 10.5


def test_subtraction_and_anchor(spark):
    f = lambda g, n, td, o: spark.range(1).select(m.by_subtraction(F.lit(g), F.lit(n), F.lit(td), [F.lit(o)])).first()[0]
    assert f(100.0, 80.0, 20.0, 5.0) == 15.0 and f(100.0, 80.0, 30.0, 5.0) is None and f(100.0, 40.0, 60.0, 5.0) is None
    a = lambda g, x: spark.range(1).select(m.anchored_gross(F.lit(g).cast("double"), F.lit(x).cast("double"))).first()[0]
    assert a(1200.0, 100.0) == 100 and a(101.0, 100.0) == 101 and a(None, 100.0) == 100 and a(5.0, None) == 5


def test_misreadings(spark):
    got = {x.value for x in one(spark, 15.20, lambda x: m.misreadings(x, 400), "double")}
    assert {45.2, 75.2, 16.2, 18.2, 13.2, 115.2, 915.2, 1520.0} <= got and 15.2 not in got


def test_texts(spark):
    assert one(spark, "Zolé  O'Neil-Smith", t.norm) == "zole o neil smith"
    assert one(spark, "Smith, Anna B", t.match_key) == "anna smith" and one(spark, "Anna B Smith", t.match_key) == "anna smith" and one(spark, "Anna", t.match_key) == "anna"
    assert one(spark, "anna smith", t.short_key) == "smith|ann" and one(spark, "anna", t.short_key) is None
    assert [one(spark, x, t.pay_periods) for x in ("Bi-Weekly", " monthly ", "13", None)] == [26, 12, 12, 12]
    assert one(spark, "GROSS PAY   1,234.50  2.00\nNET PAY 9.10", lambda x: t.label_amount(x, "NET PAY")) == 9.1 and one(spark, "none", lambda x: t.label_amount(x, "NET PAY")) is None
    assert one(spark, "a 1.00 and 1.00, 2,000.50", t.figures) == ["1.00", "2000.50"]
    assert one(spark, "KEIR AB ltd", t.titled) == "Keir AB Ltd"
    assert one(spark, "x", lambda x: t.filled("{a} owes {b}", {"a": x})) == "x owes {b}"
    assert one(spark, 12, lambda x: t.hamming(x, F.lit(9)), "int") == 2 and one(spark, None, lambda x: t.hamming(x, F.lit(9)), "int") == 999
    assert one(spark, None, m.money, "double") == "-" and one(spark, -1234.5, m.money, "double") == "-$1,234.50"


@given(st.decimals(min_value=-10**7, max_value=10**7, places=2))
@settings(max_examples=25, deadline=None)
def test_number_round_trip(spark, d):
    v = float(d)
    text = f"${abs(v):,.2f}"
    assert one(spark, f"({text})" if v < 0 else text, m.number) == v


def test_statement_texts(spark):
    w = one(spark, "Filing status: Married  Multiple jobs: N children: 2 extra withholding: $1,050.00", t.w4)
    assert tuple(w) == ("M", "N", 2, 1050.0) and tuple(one(spark, "nothing", t.w4)) == (None, None, None, None)
    assert one(spark, "Direct Deposit\nBank A 12 1,000.00\nBank B 5.50\nDeposit total 1,005.50\nBank C 9.00", t.deposits) == [1000.0, 5.5] and one(spark, "none", t.deposits) == []
    assert tuple(one(spark, "Employee name: Anna Lee\nEmployee ID: E1207", t.person)) == ("Anna Lee", "E1207")
    assert one(spark, 'said {"a": 1} so', lambda x: t.json_of(x, "a int")).a == 1 and one(spark, "none", lambda x: t.json_of(x, "a int")) is None
