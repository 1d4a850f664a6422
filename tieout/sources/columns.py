"""Registers in columns and their pay assignments: figures counted from the end of a line, totals printed at the end."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.operators.ordered import carried
from tieout.sources.registers import OWNER, lines, tail_numbers

_NUM = r"-?[\d,]*\.\d\d"
#: An employee's line, the employee number and marital letter under it, a deduction row.
NAME = rf"^\s*([A-Z][A-Z'\-. ]*,[A-Z'\-. ]+?)\s{{2,}}{_NUM}(?:\s+{_NUM}){{8}}\s*$"
DEDUCTION = rf"(\d{{3}})\s+({_NUM})\s+({_NUM})\s+([YN])\s+([YN])"
#: The nine columns of an employee's four lines.
COLUMNS = (
    "stand suppl ntax_bus abs_ded abs_ref units hrly gross net".split(),
    "wh_gross wh_tax eic cafe annuity dep_care emplr_cont other_ded net_adj".split(),
    "med_gross med_tax trs_gross trs_dep trs_ins trs_sal_red wc_tax emp457 emplr457".split(),
    "fica_gross fica_tax trsfd_gross trsfd_dp trsfd_car unemp_gross unemp_tax ovtm_gross ovtm_units".split(),
)
#: The labels of the totals at the end of a register, and the columns that they must equal.
TOTALS = {
    "gross": "Total Gross", "stand": "Standard Gross", "suppl": "Supplemental Pay", "net": "Net Pay", "wh_gross": "Withholding Gross", "wh_tax": "Withholding Tax",
    "med_gross": "Medicare Gross", "med_tax": "Medicare Tax", "fica_gross": "FICA Gross", "cafe": "Cafeteria 125", "other_ded": "Other Deductions", "trs_gross": "TRS Gross",
}
LAST = "District Totals:"


def plain(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def census_key(name: Column) -> Column:
    """Five letters of the last and three of the first name of "LAST, FIRST"."""
    letters = lambda x: F.regexp_replace(F.upper(x), "[^A-Z]", "")
    first = F.when(name.contains(","), F.regexp_extract(name, r"^[^,]*,(.*)$", 1)).otherwise("")
    return F.concat(F.substring(letters(F.substring_index(name, ",", 1)), 1, 5), F.substring(letters(first), 1, 3))


def norm_code(text: Column) -> Column:
    """(code, seq) of a printed employee code: its letters in capitals without blanks, and the figures behind them."""
    packed = F.regexp_replace(F.upper(text), r"[^A-Z0-9]", "")
    return F.struct(F.substring(F.regexp_extract(packed, "^([A-Z]*)", 1), 1, 8).alias("code"), F.regexp_extract(packed, r"(\d*)$", 1).alias("seq"))


def employees(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, name, census_key, number, marital, the COLUMNS, deductions): every employee of registers in
    columns; ``deductions`` is an array of (code, amount, employer, caf, ref).

    The figures of a line are its last nine, as fields to the left of them may be blank; a line with fewer gives nulls.
    The number opens the next line, else the name stands for it; the marital letter opens the one after. Deductions are
    read up to the next name, a total's name being no employee's. All within a text's row: nothing is shuffled, and null
    texts, texts without employees and empty tables give no rows."""
    split = docs.where(F.col(text).isNotNull()).select(key, F.split(text, "\r?\n").alias("_l"))
    named = F.filter(F.transform("_l", lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, NAME, 1).alias("name"))), lambda h: h["name"] != "")
    heads = split.withColumn("_h", named).where(F.size("_h") > 0)
    # Each head with where the next begins.
    spans = F.transform("_h", lambda h, k: F.struct(h["i"].alias("i"), F.regexp_replace(h["name"], r"\s+", " ").alias("name"), F.coalesce(F.get(F.col("_h"), k + 1)["i"], F.size("_l")).alias("end")))
    rows = heads.select(key, "_l", F.explode(spans).alias("_s")).where(~F.col("_s.name").startswith("DISTRICT") & ~F.col("_s.name").contains("TOTALS"))
    line = lambda n: F.coalesce(F.get(F.col("_l"), F.col("_s.i") + n), F.lit(""))
    body = F.array_join(F.slice("_l", F.col("_s.i") + 2, F.col("_s.end") - F.col("_s.i") - 1), "\n")
    out = rows.select(key, F.col("_s.i").alias("line_no"), F.trim("_s.name").alias("name"), *(line(n).alias(f"_{n}") for n in range(4)), body.alias("_body"))
    out = out.withColumns({f"_t{n}": tail_numbers(F.col(f"_{n}")) for n in range(4)})
    group = lambda g: F.regexp_extract_all("_body", F.lit(DEDUCTION), g)
    deductions = F.zip_with(F.arrays_zip(group(1).alias("code"), group(2).alias("a"), group(3).alias("b")), F.arrays_zip(group(4).alias("caf"), group(5).alias("ref")), lambda x, y: F.struct(x["code"].alias("code"), plain(x["a"]).alias("amount"), plain(x["b"]).alias("employer"), y["caf"].alias("caf"), y["ref"].alias("ref")))
    figures = [F.get(F.col(f"_t{n}"), k).alias(c) for n, own in enumerate(COLUMNS) for k, c in enumerate(own)]
    number = F.coalesce(F.nullif(F.regexp_extract("_1", r"^\s*(\d{4,8})\b", 1), F.lit("")), F.col("name"))
    return out.select(key, "line_no", "name", census_key(F.col("name")).alias("census_key"), number.alias("number"), F.regexp_extract("_2", r"^\s*([MSH])\b", 1).alias("marital"), *figures, deductions.alias("deductions"))


def printed_totals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, control, printed): the totals behind the last ``District Totals:`` of a register; none without one."""
    tail = docs.where(F.col(text).contains(LAST)).select(key, F.substring_index(text, LAST, -1).alias("_t"))
    every = F.array(*(F.struct(F.lit(c).alias("control"), plain(F.regexp_extract("_t", rf"{label}:\s+({_NUM})", 1)).alias("printed")) for c, label in TOTALS.items()))
    return tail.select(key, F.explode(every).alias("x")).select(key, "x.*").where("printed is not null")


def gate(docs: DataFrame, key: str = "doc_id", text: str = "text", tolerance: float = 0.02) -> DataFrame:
    """(key, control, parsed, printed, ok): each printed total against the sum of its column; totals that aren't printed
    aren't compared. A register whose employees can't be read has sums of zero, so it fails."""
    cents = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")), F.lit(0)).cast("double")
    sums = employees(docs, key, text).groupBy(key).agg(*(cents(c).alias(c) for c in TOTALS))
    parsed = sums.select(F.col(key).alias("_k"), F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).alias("parsed")) for c in TOTALS))).alias("x")).select("_k", "x.*")
    both = printed_totals(docs, key, text).join(parsed, (F.col(key) == F.col("_k")) & (F.col("control") == F.col("_c")), "left")
    parsed = F.coalesce("parsed", F.lit(0.0))
    return both.select(key, "control", parsed.alias("parsed"), "printed", (F.abs(parsed - F.col("printed")) <= tolerance + 1e-9).alias("ok"))


def tied(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The employees of the registers all of whose controls tie; strict readers take these alone. A register without a
    printed gross is none of them."""
    good = gate(docs, key, text).groupBy(key).agg(F.min("ok").alias("_all"), F.max(F.col("control") == "gross").alias("_gross")).where("_all and _gross").select(key)
    return employees(docs, key, text).join(good, key, "left_semi")


#: An assignment's line (pay code, factor, gross), its frequency and pays before a date, a tax line.
ASSIGNMENT = r"^\s*\*\*\s+\w\s+(\S+)\s+.*?\s(?:-?[\d,]+\.\d{2}|[\d,]+\.\d{4})\s+([\d.]+)\s+(-?[\d,]+\.\d{2})\s"
PAYS = r"\s(\d{1,2})\s+(\d{1,2})\s+\d\d/\d\d/\d{4}"
TAX = r"^\s+[DF]\s+(\w+)\s+\S+.*?\s(-?[\d,]+\.\d{2})\s+\d.*?\s(-?[\d,]+\.\d{2})\s*$"


def assignments(docs: DataFrame, key: str = "doc_id", text: str = "text", tax: str = "1WH") -> DataFrame:
    """(key, owner_line, id, line_no, pay, gross, frq, pays, fed, fed_base, n_fed): every pay assignment under its owner,
    with the sums of the tax lines under it. Assignments before any owner and tax lines before any assignment of their
    owner are left out. Owner and assignment are carried down the lines of one text."""
    rows = lines(docs, key, text).select(key, "line_no", "line", F.regexp_extract("line", OWNER, 2).alias("_id"), F.regexp_extract("line", ASSIGNMENT, 1).alias("_pay"), F.regexp_extract("line", TAX, 1).alias("_tax"))
    useful = rows.where(F.greatest("_id", "_pay", "_tax") != "")
    owner = carried(F.when(F.col("_id") != "", F.struct(F.col("line_no").alias("owner_line"), F.col("_id").alias("id"))), [key], ["line_no"])
    found = F.struct(F.col("line_no").alias("asg_line"), F.col("_pay").alias("pay"), plain(F.regexp_extract("line", ASSIGNMENT, 3)).alias("gross"), F.regexp_extract("line", PAYS, 1).try_cast("int").alias("frq"), F.regexp_extract("line", PAYS, 2).try_cast("int").alias("pays"))
    at = useful.withColumn("_o", owner).withColumn("_a", carried(F.when(F.col("_pay") != "", found), [key], ["line_no"]))
    own = at.where("_o is not null and _a is not null and _a.asg_line > _o.owner_line and _id = ''")
    paid = F.col("_tax") == tax
    amount = lambda g: F.sum(F.when(paid, plain(F.regexp_extract("line", TAX, g)).cast("decimal(18,2)"))).cast("double")
    sums = own.groupBy(key, F.col("_o.owner_line").alias("owner_line"), F.col("_o.id").alias("id"), F.col("_a").alias("_a")).agg(amount(2).alias("fed"), amount(3).alias("fed_base"), F.count_if(paid).alias("n_fed"))
    return sums.select(key, "owner_line", "id", F.col("_a.asg_line").alias("line_no"), "_a.pay", "_a.gross", "_a.frq", "_a.pays", F.coalesce("fed", F.lit(0.0)).alias("fed"), F.coalesce("fed_base", F.lit(0.0)).alias("fed_base"), "n_fed")


def cheques(asg: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, owner_line, id, gross, fed, base, rate, pays, excluded): what an owner's assignments add up to: the base that
    tax was withheld on, its effective rate, the pays a year weighted by base (without a base the first assignment's, 12
    where none states any), and the pay codes with gross that no tax line stands under."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    weighed = F.col("pays").isNotNull() & (F.col("pays") > 0) & (F.col("fed_base") != 0)
    out = asg.groupBy(key, "owner_line", "id").agg(
        money("gross").alias("gross"), money("fed").alias("fed"), money("fed_base").alias("base"),
        F.try_divide(F.sum(F.when(weighed, F.col("pays") * F.col("fed_base").cast("decimal(18,2)"))).cast("double"), F.sum(F.when(weighed, F.col("fed_base").cast("decimal(18,2)"))).cast("double")).alias("_mean"),
        F.min_by(F.when(F.col("pays") > 0, F.col("pays")), F.when(F.col("pays") > 0, F.col("line_no"))).alias("_first"),
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("gross") != 0) & (F.col("n_fed") == 0), F.col("pay")))), ",").alias("excluded"),
    )
    return out.select(key, "owner_line", "id", "gross", "fed", "base", F.coalesce(F.round(F.try_divide("fed", "base"), 6), F.lit(0.0)).alias("rate"), F.round(F.coalesce("_mean", F.col("_first").cast("double"), F.lit(12.0)), 6).alias("pays"), "excluded")


def printed(statements: DataFrame, key: str, fields: dict[str, str], codes: dict[str, str]) -> DataFrame:
    """(key, text): statements printed as a register in columns, as a fixture for the reader and for those who need to
    hand one on. ``fields``: column of COLUMNS -> column of ``statements``, null as 0.00; ``codes``: three digits -> column;
    ``statements`` has key, line_key (order), printed_name and number."""
    usd = lambda c: F.format_number(F.coalesce(F.col(c), F.lit(0.0)), 2)
    nine = lambda own: F.concat_ws("  ", *(usd(fields[c]) if c in fields else F.lit("0.00") for c in own))
    rows = F.concat_ws("\n", *(F.when(F.col(c) != 0, F.concat(F.lit(f"      {k}  "), usd(c), F.lit("  0.00  Y  N"))) for k, c in codes.items()))
    one = F.concat_ws("\n", F.concat(F.col("printed_name"), F.lit("    "), nine(COLUMNS[0])), F.concat(F.lit("  "), F.col("number"), F.lit("    "), nine(COLUMNS[1])), F.concat(F.lit("  S    "), nine(COLUMNS[2])), F.concat(F.lit("        "), nine(COLUMNS[3])), F.nullif(rows, F.lit("")))
    total = lambda c: F.sum(F.coalesce(F.col(fields[c]), F.lit(0.0)).cast("decimal(18,2)"))
    folded = statements.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_key", one.alias("t")))), lambda x: x["t"]), "\n").alias("_body"), *(total(c).alias(f"_{c}") for c in TOTALS if c in fields))
    ends = F.concat_ws("\n", *(F.concat(F.lit(f"{TOTALS[c]}:   "), F.format_number(F.col(f"_{c}"), 2)) for c in TOTALS if c in fields))
    return folded.select(key, F.concat_ws("\n", "_body", F.lit(LAST), ends).alias("text"))

