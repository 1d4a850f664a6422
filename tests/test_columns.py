from pyspark.sql import functions as F

from tieout.functions import money as m
from tieout.functions import text as t
from tieout.operators import ordered
from tieout.sources import columns

NINE = "1,000.00  0.00  0.00  0.00  0.00  0.00  0.00  1,000.00  800.25"
PAGE = f"""  CNTY 001
DOE, ANNA MAE   {NINE}
  004711  22 {NINE.replace("800.25", "0.00")}
  M  1.00 2.00 3.00
  7 {NINE}
     101  25.00  0.00  Y  N   102  -5.50  1.00  N  Y
ROE, B   1.00 2.00 .75 4.00 5.00 6.00 7.00 8.00 -9.00
no number here
DISTRICT TOTALS, ALL  {NINE}
     101  99.00  0.00  Y  N
District Totals:
Total Gross:   1,008.00
Net Pay:   791.28
"""


def test_employees(spark):
    docs = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "nothing")], "doc_id long, text string")
    a, b = columns.employees(docs).orderBy("line_no").collect()
    assert (a.name, a.census_key, a.number, a.marital, a.gross, a.net, a.med_gross, a.fica_gross) == ("DOE, ANNA MAE", "DOEANN", "004711", "M", 1000.0, 800.25, None, 1000.0)
    assert [tuple(x) for x in a.deductions] == [("101", 25.0, 0.0, "Y", "N"), ("102", -5.5, 1.0, "N", "Y")]
    assert (b.name, b.number, b.ntax_bus, b.net, b.deductions) == ("ROE, B", "ROE, B", 0.75, -9.0, [])
    gate = {r.control: (r.parsed, r.printed, r.ok) for r in columns.gate(docs).collect()}
    assert gate == {"gross": (1008.0, 1008.0, True), "net": (791.25, 791.28, False)}
    assert columns.tied(docs).count() == 0 and columns.tied(docs.withColumn("text", F.replace("text", F.lit("791.28"), F.lit("791.27")))).count() == 2
    assert columns.employees(docs.limit(0)).count() == columns.gate(docs.limit(0)).count() == 0


def test_assignments(spark):
    text = (
        "    D 1WH FEDERAL  1.00  1  base  9.00\nDOE ANNA   ID E1   PERIOD 05/14\n  ** R 101 MAIN PAY  1.0000  1.0  100.00  199  26 12 05/14/2024 05/15/2024\n    D 1WH FEDERAL  10.00  1  base  80.00\n    D 2SS X  5.00  1  base  70.00\n"
        "  ** R 205 EXTRA  1.0000  1.0  50.00  199  26 13 05/14/2024 05/15/2024\n    D 1WH FEDERAL  2.00  1  base  20.00\n  ** R 300 GIFT  1.0000  1.0  7.00  199 \nROE B   ID E2   PERIOD 05/14\n    D 1WH FEDERAL  4.00  1  base  3.00"
    )
    asg = columns.assignments(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    assert [(r.id, r.pay, r.fed, r.fed_base, r.n_fed) for r in asg.orderBy("line_no").collect()] == [("E1", "101", 10.0, 80.0, 1), ("E1", "205", 2.0, 20.0, 1), ("E1", "300", 0.0, 0.0, 0)]
    c = columns.cheques(asg).first()
    assert (c.gross, c.fed, c.base, c.rate, c.pays, c.excluded) == (157.0, 12.0, 100.0, 0.12, 12.2, "300")


def test_codes(spark):
    row = spark.createDataFrame([("  doe j-012 ", None)], "a string, b string").select(columns.norm_code(F.col("a")).alias("x"), columns.norm_code(F.col("b")).alias("y"), columns.census_key(F.lit("O'Brien-Smythe, Jo Ann")).alias("k")).first()
    assert tuple(row.x) == ("DOEJ", "012") and tuple(row.y) == (None, None) and row.k == "OBRIEJOA"


def test_scalars(spark):
    df = spark.createDataFrame([(1,)], "i int")
    say = lambda c: df.select(c.alias("v")).first().v
    assert say(t.nearest_amount(F.lit("Net Pay 1,234.50 9.00"), "net pay")) == 1234.5 and say(t.nearest_amount(F.lit("7.00 12.25 Net Pay"), "net pay")) == 12.25 and say(t.nearest_amount(F.lit("Net 1.00"), "net pay")) is None
    assert say(t.compact_amount(F.lit("x\nN et P a y: -\nNetPay... 8.10"), "netpay")) == 8.1 and say(t.compact_amount(F.lit(None).cast("string"), "netpay")) is None
    assert [tuple(w) for w in say(t.wide_words(F.lit("ab  c"), F.lit(0.0), F.lit(50.0)))] == [("ab", 0.0, 20.0), ("c", 40.0, 50.0)] and say(t.wide_words(F.lit(""), F.lit(0.0), F.lit(1.0))) == []
    assert say(t.layout_of(F.lit("Pre-Process Register"))) == "preprocess" and say(t.slot_of(F.lit("A Census.xlsx"))) == "census" and say(t.slot_of(F.lit("x"))) is None
    assert say(m.bracketed_money(F.lit(-1234.5))) == "($1,234.50)" and say(m.signed_money(F.lit(2.0))) == "+$2.00" and say(m.plain_money(F.lit(None).cast("double"))) == ""
    assert say(m.repeats_another(F.lit(5.0), [F.lit(-5.0)])) is None and say(m.repeats_another(F.lit(5.0), [F.lit(None).cast("double")])) == 5.0
    assert tuple(say(m.overridden(F.lit(2.0), F.lit(1.0)))) == (2.0, "1.00 -> 2.00") and tuple(say(m.overridden(F.lit(None).cast("double"), F.lit(1.0)))) == (1.0, None)
    assert say(t.readable(F.lit(None).cast("string"))) is False and say(t.reads_ok(F.lit("a"))) is False and say(t.at_path(F.lit('{"a": {"b": 3}}'), "a.b")) == "3"


def test_runs_and_blocks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a"), (6, "end"), (7, "a")], "i int, k string")
    assert [r.run for r in ordered.runs(df.withColumn("g", F.lit(1)), F.col("k"), ["g"], ["i"]).orderBy("i").collect()] == [1, 1, 2, 2, 3, 4, 5]
    assert [r.block for r in ordered.blocks(df.withColumn("g", F.lit(1)), F.col("k") == "end", ["g"], "i").orderBy("i").collect()] == [0, 0, 0, 0, 0, 0, 1]
