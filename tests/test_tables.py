import pandas as pd

from tieout.operators import tables


def words(lines, doc=1):
    out = []
    for n, line in enumerate(lines):
        at = 0
        for part in line.split(" "):
            if part:
                out.append((doc, 0, len(out), part, at * 6.0, n * 12.0, (at + len(part)) * 6.0, n * 12.0 + 10.0, 1.0))
            at += len(part) + 1
    return pd.DataFrame(out, columns=["doc", "page", "word_id", "text", "x0", "y0", "x1", "y1", "conf"])


ALIASES = {"gross": r"\bgross\b", "federal": r"fed(eral)?\b", "net": r"\bnet\b", "fee": r"\bfee\b"}
ROW = lambda name, *cells: name.ljust(14) + "".join(c.rjust(18) for c in cells)
PAGE = [
    "Example School District",
    ROW("Employee", "Gross", "Federal", "Net", "Fee"),
    ROW("", "", "Tax", "Pay"),
    ROW("ANNA LEE", "1,000.00", "100.00", "900.00", "5.00"),
    ROW("BO RAY", "2,000.00", "", "1,700.00", ""),
    ROW("", "", "300.00", "", "7.00"),
    ROW("Employee", "Gross", "Federal", "Net", "Fee"),
    ROW("CY DAY", "500.00", "50.00", "450.00", "1.00"),
    ROW("Totals", "3,500.00", "450.00", "3,050.00", "13.00"),
    "nobody here",
]


def test_read_table():
    got = tables.read_table(words(PAGE), ALIASES)
    cells = {(person, field): value for _, kind, person, field, value in got if field}
    assert cells == {("ANNA LEE", "gross"): 1000.0, ("ANNA LEE", "federal"): 100.0, ("ANNA LEE", "net"): 900.0, ("ANNA LEE", "fee"): 5.0, ("BO RAY", "gross"): 2000.0, ("BO RAY", "net"): 1700.0, ("BO RAY", "federal"): 300.0, ("BO RAY", "fee"): 7.0, ("CY DAY", "gross"): 500.0, ("CY DAY", "federal"): 50.0, ("CY DAY", "net"): 450.0, ("CY DAY", "fee"): 1.0}
    assert [kind for _, kind, _, field, _ in got if not field] == ["unread", "header", "sums", "unread"]
    assert tables.read_table(words(["no table here", "1.00 2.00"]), ALIASES) == [] and tables.read_table(words([]), ALIASES) == []


def test_tables_and_lines(spark):
    df = spark.createDataFrame(pd.concat([words(PAGE), words(["Net Pay", "  12.50"], 2)]))
    df = df.withColumn("page", df["page"].cast("int")).withColumn("word_id", df["word_id"].cast("int"))
    rows = tables.read_tables(df, ALIASES)
    assert {r.doc for r in rows.collect()} == {1}
    a = tables.accounted(rows).first()
    assert (a.n_employees, a.n_continued, a.n_other) == (3, 1, 4)
    text = {(r.doc, r.line): r.text for r in tables.grid_lines(df).collect()}
    assert text[1, 5] == "ANNA LEE | 1,000.00 | 100.00 | 900.00 | 5.00" and text[2, 0] == "Net Pay"
    s = {r.doc: r for r in tables.page_scores(df).collect()}
    assert s[2].lines == 2.0 - 1.0 + 1.0 and abs(s[2].plausible - (1.0 + 0.001 * 10)) < 1e-6 and s[1].lines > s[2].lines
    assert tables.grid_lines(df.limit(0)).count() == tables.page_scores(df.limit(0)).count() == 0


def test_blocks(spark):
    rows = [
        ("LEE", 0.1, 0.9), ("ANNA", 0.2, 0.9), ("Net", 0.1, 0.85), ("1,200.50", 0.5, 0.85), ("Net", 0.1, 0.82), ("1,200.50", 0.5, 0.82), ("Net", 0.1, 0.81), ("9.99", 0.5, 0.81), ("Totals", 0.1, 0.8), ("Totals", 0.6, 0.797),
        ("Totals", 0.1, 0.7), ("for", 0.2, 0.72), ("Employees", 0.1, 0.72), ("12", 0.2, 0.72), ("RAY", 0.1, 0.6), ("Female", 0.3, 0.6), ("Net", 0.1, 0.55), ("-", 0.5, 0.55), ("Totals", 0.1, 0.5), ("footer", 0.1, 0.1),
    ]
    df = spark.createDataFrame([(1, 0, *r) for r in rows] + [(2, 0, "Net", 0.1, 0.5)], "doc long, page int, t string, x double, y double")
    b = tables.blocks(df)
    assert {r.block for r in b.collect()} == {0.8, 0.5} and b.where("t = 'footer'").count() == 0
    got = {r.block: (r.name, r.net) for r in tables.block_people(b).collect()}
    assert got == {0.8: ("LEE ANNA", 1200.5), 0.5: ("RAY Female", None)}
