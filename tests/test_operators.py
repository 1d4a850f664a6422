import random
from datetime import datetime

from pyspark.sql import functions as F

from tieout.operators import controls, estimate, geometry, matching, ordered, roster
from tieout.sources import registers


def rowset(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 3, "z"), (None, 4, "n"), (" ", 5, "m")], "k string, o int, v string")
    assert rowset(matching.first_wins(df, ["k"], ["o"])) == [(" ", 5, "m"), ("a", 1, None), ("b", 3, "z")]
    last = matching.last_wins(df, ["k"], ["o"]).select("k", "o", "v", F.col("position.o").alias("p"))
    assert rowset(last) == sorted([("a", 2, "x", 1), ("b", 3, "z", 3), (None, 4, "n", 4), (" ", 5, "m", 5)], key=str)
    assert matching.first_wins(df.limit(0), ["k"], ["o"]).count() == 0
    shuffled = matching.last_wins(df.repartition(3, "v"), ["k"], ["o"]).select("k", "o", "v", F.col("position.o").alias("p"))
    assert rowset(shuffled) == rowset(last)


def test_tiers(spark):
    left = spark.createDataFrame([(1, 1, "7", "ann lee"), (2, 1, None, "bob ray"), (3, 1, "9", "cy"), (4, 2, "7", "ann lee")], "l int, w int, i string, n string")
    right = spark.createDataFrame([(10, 1, "7", "x"), (11, 1, "7", "bob ray"), (12, 1, None, "bob ray")], "r int, w int, i2 string, n2 string")
    got = matching.tiered(left, right, [(F.col("i"), F.col("i2")), (F.col("n"), F.col("n2"))], left_id="l", right_id="r", within="w", order=["r"])
    assert rowset(got) == sorted([(1, 10, 1), (2, 11, 2), (3, None, None), (4, None, None)], key=str)


def test_near_hashes_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    data = [(i, "ab"[i % 2], rng.getrandbits(12)) for i in range(60)] + [(99, "a", None), (100, "a", 5), (101, "a", 5)]
    df = spark.createDataFrame(data, "id int, k string, h long")
    got = {r.id: (r.near_id, r.distance) for r in matching.near_hashes(df, ["k"], "h", "id", most=2, bits=12).collect()}
    want = {}
    for i, k, h in data:
        near = [(bin(h ^ g).count("1"), j) for j, q, g in data if h is not None and g is not None and j != i and q == k and bin(h ^ g).count("1") <= 2]
        if near:
            want[i] = (min(near)[1], min(near)[0])
    assert got == want


def test_codes(spark):
    b = spark.createDataFrame([(1, "a", 1.0)], "w int, code string, amount double")
    a = spark.createDataFrame([(1, "a", 1.0), (1, "p", 50.0), (1, "p", 50.0), (1, "r", -100.0), (1, "f", 9.0)], "w int, code string, amount double")
    assert rowset(matching.new_codes(b, a, "w", "code", "amount")) == [(1, "f", 9.0, "fee"), (1, "p", 100.0, "premium"), (1, "r", -100.0, "reimbursement")]
    pay = spark.createDataFrame([(1, "x", "ann", 5.0), (1, "x", "bob", 6.0), (1, "y", "bob", -6.0), (1, "y", "ann", 5.0), (1, "z", "ann", 5.0)], "w int, c string, n string, v double")
    assert rowset(matching.same_payers(pay, "w", "c", "n", "v")) == [(1, "x", "y", 2)]


def test_ordered(spark):
    df = spark.createDataFrame([("a", 1, 10.0, None), ("a", 2, 11.0, "x"), ("a", 3, 30.0, None), ("b", 1, 5.0, None)], "g string, o int, v double, s string")
    out = ordered.island_numbers(df, F.col("v"), 5.0, ["g"], ["o"]).withColumn("c", ordered.carried(F.col("s"), ["g"], ["o"])).withColumn("n", ordered.ahead(F.col("v"), 1, ["g"], ["o"]))
    assert [(r.g, r.o, r.island, r.c, r.n) for r in out.orderBy("g", "o").collect()] == [("a", 1, 0, None, 11.0), ("a", 2, 0, "x", 30.0), ("a", 3, 1, "x", None), ("b", 1, 0, None, None)]
    assert ordered.top_rows(df, ["g"], [F.col("v").desc()], 1).count() == 2


def test_effective(spark):
    m = spark.createDataFrame([("p", "f", 1.0), ("p", "g", None)], "k string, f string, v double")
    c = spark.createDataFrame([("p", "f", 2.0, 1), ("p", "f", 3.0, 2), ("p", "h", None, 1)], "k string, f string, v double, at int")
    assert rowset(ordered.effective(m, c, ["k", "f"], "v", ["at"])) == [("p", "f", 3.0, True), ("p", "g", None, False), ("p", "h", None, True)]
    assert ordered.effective(m, c.limit(0), ["k", "f"], "v", ["at"]).count() == 2


def test_controls(spark):
    import pytest

    df = spark.createDataFrame([("r", 10.0), ("r", 5.005), ("r", None)], "s string, v double")
    printed = spark.createDataFrame([("r", "v", 15.01), ("r", "n", 4.0), ("q", "v", 1.0)], "s string, control string, printed double")
    got = controls.control_totals(df, ["s"], {"v": controls.exact_sum(F.col("v")), "n": F.count("*")}, printed)
    assert {(r.s, r.control): r.ok for r in got.collect()} == {("r", "v"): True, ("r", "n"): False, ("q", "v"): False}
    with pytest.raises(ValueError):
        controls.gate(got)
    controls.gate(got.where("ok"))


def test_fit():
    seen = {"gross": 1000.0, "total_deductions": 200.0, "net_pay": 800.0, "federal": 100.0, "state": 0.0, "social_security": 62.0, "medicare": 14.5, "retirement": 23.5, "other_total": 0.0}
    fitted, sd, gaps = estimate.fit_one(seen)
    assert abs(fitted["federal"] - 100) < 0.05 and all(abs(g) < 0.01 for g in gaps) and sd["gross"] > 0
    bad, _, gaps = estimate.fit_one(seen | {"net_pay": 300.0})
    assert abs(bad["net_pay"] - 300) > 100 and max(map(abs, gaps)) == 500
    assert estimate.fit_one({"gross": 1.0}) == ({}, {}, [])


def test_fits_and_intervals(spark):
    p = spark.createDataFrame([(1, *([100.0] * 12)), (2, *([None] * 12))], "k long, " + ", ".join(f"{f} double" for f in estimate.FIELDS))
    got = {r.k: r for r in estimate.fits(p, "k").collect()}
    assert got[1].suspect and got[2].fitted == {} and got[2].suspect is None
    e = spark.createDataFrame([(1, 0.0, 100.0, 100.0), (2, 0.0, None, 1.0), (3, 0.0, 0.0, 500.0)], "k long, b double, a double, p double")
    out = {r.k: r for r in estimate.intervals(e, ["k"], "b", "a", "p").collect()}
    assert set(out) == {1, 3} and out[1].low < 0 < out[1].high and out[3].material == 1.0 and out[1].material == 0.0


def test_triangles(spark):
    a = estimate.triangle(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    row = spark.range(1).select(estimate.membership(a, F.lit(0.5)), estimate.membership(a, F.lit(3.0)), estimate.support_below(a, 0.5), estimate.add(a, a), estimate.subtract(a, a), estimate.scale(a, -2.0)).first()
    assert row[0] == 0.5 and row[1] == 0 and abs(row[2] - 0.49) < 1e-9 and tuple(row[3]) == (0, 2, 4) and tuple(row[4]) == (-2, 0, 2) and tuple(row[5]) == (-4, -2, 0)


def test_likely_reading(spark):
    c = spark.createDataFrame([(1, 100.0, 1.0, 100.0), (1, 200.0, 1.0, 100.0), (2, 5.0, 0.5, 9.0), (2, 13.0, 0.5, 9.0)], "k int, v double, w double, e double")
    got = {r.k: (r.v, r.decisive) for r in estimate.likely_reading(c, ["k"], "v", "w", "e", 10.0).collect()}
    assert got[1] == (100.0, True) and got[2][1] is False


TEXT = "ANNA LEE   ID 80860   PERIOD 05/14\n  GROSS PAY            2,155.16      14690.11\n  NET PAY               819.32       4762.06\nplain\nBO RAY   ID 1   PERIOD 05/14\n  GROSS PAY   1.00   2.00"


def test_register(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "  GROSS PAY   1.00   2.00")], "doc_id long, text string")
    assert rowset(registers.register(df).select("doc_id", "name", "id", "code", "amount")) == [(1, "ANNA LEE", "80860", "GROSS PAY", 2155.16), (1, "ANNA LEE", "80860", "NET PAY", 819.32), (1, "BO RAY", "1", "GROSS PAY", 1.0)]
    assert spark.createDataFrame([(TEXT,), ("x",), ("District Totals: 1",)], "t string").select(registers.looks_like("t")).collect() == [("headings",), ("unknown",), ("columns",)]
    assert spark.createDataFrame([("a 1.00 2.00- 3,000.00",)], "t string").select(registers.tail_numbers("t", 2)).first()[0] == [2.0, 3000.0]
    assert spark.createDataFrame([("a 1.00 -2.50 .75",)], "t string").select(registers.tail_numbers("t", 4), registers.tail_numbers("t", 3)).first() == (None, [1.0, -2.5, 0.75])


def test_pages(spark):
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")
    words = geometry.words_of_text(df)
    first = words.where("text = '2,155.16'").first()
    assert (first.x0, first.y0) == (TEXT.split("\n")[1].index("2,155") * 6.0, 12.0)
    got = {(r.field): r.value for r in geometry.page_fields(words, {"gross": "gross pay", "net": "net pay", "fee": "ee fee"}).collect()}
    assert got == {"gross": 2155.16, "net": 819.32}
    kinds = [r.kind for r in geometry.table_rows(words, ["x", "y"]).orderBy("band").collect()]
    assert kinds == ["section", "employee", "employee", "section", "section", "employee"]
    assert geometry.page_bands(words).select("band").distinct().count() == 6


def test_geometry_parts():
    import numpy as np

    assert geometry.bands(np.array([0, 1, 20.0]), np.array([10, 11, 30.0])).tolist() == [0, 0, 1]
    left, right = np.linspace(0, 30, 20), np.linspace(70, 95, 20)
    assert len(geometry.gutters(np.r_[left, right], np.r_[left + 5, right + 5], 0, 100)) == 1
    assert geometry.columns(np.array([10, 10.5, 50]), 2.0) == [(10.25, 2)]
    assert geometry.value_of("(1,234.50)") == -1234.5 and geometry.value_of("abc") is None


def test_roster(spark):
    read = spark.createDataFrame([(1, 1, "Keir MORL0W"), (1, 2, "Keir Morlow"), (1, 3, None), (1, 4, "zzz")], "w long, ord long, name string")
    names = spark.createDataFrame([(1, 10, "Keir Morlow"), (1, 11, "Anna Lee"), (1, 12, None)], "w long, ord long, name string")
    got = {r.ord: r.roster_ord for r in roster.adopted(read, names, "w").collect()}
    assert got == {1: 10}
    assert roster.name_score("", "x") == 0


def test_roster_against_all_pairs(spark, monkeypatch):
    """Names without a common start meet too, and squares of a register find what the whole does."""
    rng = random.Random(4)
    roll = [f"{''.join(rng.choice('kmrnet') + rng.choice('aio') for _ in range(2))} {''.join(rng.choice('lstrnd') + rng.choice('ae') for _ in range(3))}" for _ in range(40)]
    dirt = lambda n: n[: (i := rng.randrange(len(n)))] + rng.choice("xq1rn0") + n[i + 1 :]
    slips = ["Xeir Qorlow", *(dirt(dirt(rng.choice(roll))) for _ in range(60))]
    roll = ["Keir Morlow", "Élan " + "rn" * 40, *roll, *roll[:5]]
    fits = [(i, 1000 + k, s) for i, n in enumerate(slips) for k, c in enumerate(roll) if (s := roster.name_score(n, c)) >= 0.7]
    want = {(1, *x) for x in roster.adopt(fits)}
    read, names = ([(1, at + i, n) for i, n in enumerate(ns)] for at, ns in ((0, slips), (1000, roll)))
    monkeypatch.setattr(roster, "SIDE", 17, raising=False)
    got = roster.adopted(*(spark.createDataFrame(x, "w long, ord long, name string") for x in (read, names)), "w")
    assert {tuple(r) for r in got.collect()} == want and (1, 0, 1000) in {x[:3] for x in want}


def test_roster_bound_is_no_less(monkeypatch):
    """What the bound lets through is all that scores enough, whatever is read at once, long names and "rn" among them."""
    rng = random.Random(5)
    name = lambda: " ".join("".join(rng.choice("rnmit0o5slad") for _ in range(rng.choice([1, 3, 6, 9, 70]))) for _ in range(rng.randint(1, 3)))
    for cells in (1, 20, 1000):
        monkeypatch.setattr(roster, "CELLS", cells)
        for _ in range(20):
            a = [name() for _ in range(6)]
            b = [name() for _ in range(4)] + [rng.choice(a)[1:].strip() + "rn" for _ in range(5)]
            want = {(i, k, s) for i, x in enumerate(a) for k, y in enumerate(b) if (s := roster.name_score(x, y)) >= 0.7}
            assert set(roster.fits(a, b, 0.7)) == want


def test_header_rows_and_mapping(spark):
    cells = spark.createDataFrame([("f", 0, ["Title", None, None, None]), ("f", 1, ["A", "B", "C", "D"]), ("g", 0, ["1", "2", "3", "4"])], "f string, row_ord int, cells array<string>")
    assert rowset(registers.header_row(cells, ["f"])) == [("f", 1), ("g", 0)]
    heads = spark.createDataFrame([("f", "My Surname Here", 1), ("f", "FIRST-NAME", 2), ("f", "wages", 3)], "f string, header string, hdr_ord int")
    got = registers.map_headers(heads, ["f"], {"last_name": ["surname"], "first_name": ["forename"], "pay": ["salary"]})
    assert rowset(got) == [("f", "first_name", "FIRST-NAME", 1), ("f", "last_name", "My Surname Here", 3)]


def test_uploads(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    got = registers.uploads(spark, str(tmp_path)).collect()
    cells = {(r.path.rsplit("/", 1)[1], r.row_ord): r.cells for r in got}
    assert cells["a.xlsx", 0] == ["Name", None, "2.5"] and cells["b.csv", 1] == ["1", "2"] and cells["c.xlsx", None] is None


def test_store(spark, tmp_path):
    from tieout.streaming import store

    pages = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1))], "page_key string, saved timestamp")
    pages.write.parquet(str(tmp_path / "in"))
    store.append_readings(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 2 and store.new_pages(pages, done).count() == 0
    fix = spark.createDataFrame([("a", "f", 2.0, 1, 1)], "page_key string, field string, value double, at int, seq int")
    store.append_corrections(spark, fix, str(tmp_path / "fix"))
    spark.createDataFrame([("a", "f", 1.0)], "page_key string, field string, value double").write.parquet(str(tmp_path / "read"))
    assert store.effective_values(spark, str(tmp_path / "read"), str(tmp_path / "fix")).first().value == 2.0


def test_accounted(spark):
    e = spark.createDataFrame([(1, 10.0), (1, 10.9), (1, 50.0), (1, None), (2, 10.0), (1, 10.0)], "w int, v double")
    f = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, None), (1, 51.5)], "w int, v double")
    assert rowset(matching.accounted(e, f, "w", "v")) == sorted([(1, 10.0, "exact"), (1, 10.0, "exact"), (1, 10.9, "near"), (1, 50.0, "missing"), (1, None, "unknown"), (2, 10.0, "missing")], key=str)
    assert matching.accounted(e, f.limit(0), "w", "v").where("state = 'missing'").count() == 5
