"""Units as a graph: conversions are edges, compositions are found once, rows are converted by an equi-join."""

from collections import deque
from collections.abc import Iterable, Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (source unit, target unit, factor, offset): target = source * factor + offset.
Edge = tuple[str, str, Fraction | int, Fraction | int]


class InconsistentUnits(ValueError):
    """Two ways between the same units give different results."""


class UnitGraph:
    """Units joined by affine conversions, each usable both ways. Building it checks every cycle: from one
    unit of each component every edge must lead where the shortest composition leads, so that any two paths agree.
    Repeated and self edges are edges too."""

    def __init__(self, edges: Iterable[Edge]):
        self.edges = [(a, b, Fraction(f), Fraction(o)) for a, b, f, o in edges]
        self.near: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
        for a, b, f, o in self.edges:
            if f == 0:
                raise InconsistentUnits(f"{a} to {b}: factor 0 can't be reversed")
            self.near.setdefault(a, []).append((b, f, o))
            self.near.setdefault(b, []).append((a, 1 / f, -o / f))
        self._from = {a: self._reach(a) for a in self.near}
        root: dict[str, str] = {}
        for a in self.near:
            for b in self._from[a]:
                root.setdefault(b, a)
        for a, b, f, o in self.edges:
            base = self._from[root[a]]
            if (base[a][0] * f, base[a][1] * f + o) != base[b]:
                raise InconsistentUnits(f"{a} to {b}: {f}, {o} disagrees with the way over {root[a]}")

    def _reach(self, start: str) -> dict[str, tuple[Fraction, Fraction]]:
        found, queue = {start: (Fraction(1), Fraction(0))}, deque([start])
        while queue:
            a = queue.popleft()
            for b, f, o in self.near[a]:
                if b not in found:
                    found[b] = (found[a][0] * f, found[a][1] * f + o)
                    queue.append(b)
        return found

    def convert(self, source: str, target: str) -> tuple[Fraction, Fraction] | None:
        """Factor and offset of the shortest composition; None if there is none."""
        return self._from.get(source, {}).get(target)

    def table(self, spark: SparkSession, targets: Sequence[str]) -> DataFrame:
        """(unit, target, num, den, shift_num): every composition that ends in ``targets`` with a common denominator, so
        that target = (source * num + shift_num) / den. As many rows as units times targets, whatever the data."""
        rows = []
        for unit in sorted(self.near):
            for target in targets:
                if found := self.convert(unit, target):
                    den = found[0].denominator * found[1].denominator
                    rows.append((unit, target, int(found[0] * den), int(den), int(found[1] * den)))
        return spark.createDataFrame(rows, "unit string, target string, num long, den long, shift_num long")


def converted(rows: DataFrame, table: DataFrame, *, value: str, unit: str, target: str, scale: int = 1_000_000, out: str = "common_value") -> DataFrame:
    """``rows`` whose ``unit`` converts to their ``target``, with ``out``: the exact value, rounded half up (away from
    minus infinity) once, as BIGINT. ``value`` is decimal with at most six places. Rows with a null value or unit, or a
    unit that doesn't reach the target, are left out; repeated rows count each."""
    small = table.select(F.col("unit").alias("_conv_unit"), F.col("target").alias("_conv_target"), "num", "den", "shift_num")
    at = rows.join(F.broadcast(small), (F.col(unit) == F.col("_conv_unit")) & (F.col(target) == F.col("_conv_target")))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    at = at.withColumn("_n", (F.col(value) * scale).cast("decimal(38,0)")).where("_n is not null")
    at = at.withColumn("_up", F.col("_n") * F.col("num") * 2 + F.lit(scale) * F.col("shift_num") * 2 + F.lit(scale) * F.col("den")).withColumn("_by", F.lit(2 * scale) * big("den"))
    floor = F.expr("cast(_up as decimal(38,0)) div cast(_by as decimal(38,0))") - F.expr("case when _up < 0 and cast(_up as decimal(38,0)) % cast(_by as decimal(38,0)) <> 0 then 1 else 0 end")
    return at.withColumn(out, floor.cast("long")).drop("_conv_unit", "_conv_target", "num", "den", "shift_num", "_n", "_up", "_by")


def payroll_units() -> UnitGraph:
    """Money per period and pay periods per year. A year has 12 months, 52 weeks, 26 two-week and 24
    half-month periods, 4 quarters; a dollar has 100 cents, a thousand 1000 dollars."""
    periods = {"month": 12, "week": 52, "fortnight": 26, "half_month": 24, "quarter": 4}
    edges: list[Edge] = []
    for money in ("cent", "dollar", "thousand"):
        edges += [(f"{money}/{p}", f"{money}/year", n, 0) for p, n in periods.items()]
        edges.append((f"{money}/fortnight", f"{money}/week", Fraction(1, 2), 0))
        edges.append((f"{money}/quarter", f"{money}/month", Fraction(1, 3), 0))
        edges.append((f"{money}/half_month", f"{money}/month", 2, 0))
    for p in (*periods, "year"):
        edges += [(f"dollar/{p}", f"cent/{p}", 100, 0), (f"thousand/{p}", f"dollar/{p}", 1000, 0)]
    return UnitGraph(edges)


#: Patterns for a stated period, the first that matches holds; tried on lower-case text without the number.
PERIODS: Mapping[str, str] = {
    "half_month": r"semi-?\s*month|half[ -]month|twice (a|per) month|2\s*x\s*(a |per )?month|15th and last|1st (&|and) 1[56]th|\bsm\b",
    "fortnight": r"bi-?\s*week|fortnight|/\s*2\s*wk|(every|each|per) (two|2|other|second) w(ee)?k|every other|alternate|\bbw\b",
    "pay": r"per pay|each (pay|cheque|check)|every pay|/\s*(check|cheque|pay)|per (check|cheque)|\bpp\b|payday|pay period",
    "quarter": r"quarter|qtr",
    "month": r"month|mth|/\s*mo\b|\bp\.?\s?m\b|\bmo\b",
    "week": r"week|wkly|\bwk\b|every (mon|tues|wednes|thurs|fri)day",
    "year": r"annual|annum|yearly|(?:\ba|per|each|every|one|/)\s*year|^\W*year\b|\bp\.?\s?a\b|/\s*yr|\byr\b",
}
#: The number of pay periods that a frequency stands for.
PAYS = {"half_month": 24, "fortnight": 26, "month": 12, "week": 52, "quarter": 4, "year": 1}
#: Digits in groups. After a blank three digits alone belong to the number: "3,744 2x month" states 3744.
_NUMBER = r"\d+(?:[.,']\d+|[ \x{00A0}]\d{3}\b)*"


def amount(text: Column) -> Column:
    """The first number in a text as decimal(20,4), null if there is none. Of two kinds of separator the last is the
    decimal one; a single kind splits thousands if it is no point and all its groups have three digits, or if it
    repeats; else it is the decimal one. A minus right before the number or its sign, or brackets around, negate it."""
    digits = F.regexp_replace(F.regexp_extract(text, _NUMBER, 0), r"[' \x{00A0}]", "")
    comma, point = F.instr(digits, ","), F.instr(digits, ".")
    last_comma = F.length(digits) - F.instr(F.reverse(digits), ",")
    last_point = F.length(digits) - F.instr(F.reverse(digits), ".")
    european = F.translate(F.regexp_replace(digits, r"\.", ""), ",", ".")
    american = F.regexp_replace(digits, ",", "")
    plain = (
        F.when((comma > 0) & (point > 0), F.when(last_comma > last_point, european).otherwise(american))
        .when(comma > 0, F.when(digits.rlike(r"^\d{1,3}(,\d{3})+$") | digits.rlike(r",.*,"), american).otherwise(european))
        .when(digits.rlike(r"\..*\."), F.regexp_replace(digits, r"\.", ""))
        .otherwise(digits)
    )
    sign = F.when(text.rlike(r"^\s*\(.*\d.*\)") | text.rlike(r"^[^\d]*-\s*[$]?\s*\d"), -1).otherwise(1)
    return (plain.try_cast("decimal(20,4)") * sign).cast("decimal(20,4)")


def period(text: Column) -> Column:
    """The period that a text states, null if it states none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in PERIODS.items():
        out = out.when(text.rlike(pattern), name)
    return out


def frequency(text: Column) -> Column:
    """The period of a stated pay frequency, written in words or as the number of pays a year; null if it is unclear."""
    low = F.trim(F.lower(text))
    count = F.regexp_extract(low, r"^(?:paid )?(12|24|26|52|4|1)(?:\s+(?:pays?|cheques?|checks?|times?|periods?|pay periods)(?:\s+(?:a|per)\s+year)?)?$", 1)
    by = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, n in PAYS.items():
        by = by.when(count == str(n), name)
    worded = period(low)
    return F.coalesce(by, F.when(worded != "pay", worded))


def stated(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Readings as exact numbers with a source unit and the canonical target: adds ``field``'s ``_value``, ``_unit``,
    ``_target``. The unit is sought in the value, then in the unit text, for its scale then in the source's note, last
    in the field's own name. Nothing that can't be told gets a unit."""
    noted = sources.select(F.col("source_id").alias("_source"), F.lower(F.coalesce("note", F.lit(""))).alias("_note"))
    is_frequency = F.col("field") == "pay_frequency"
    after, own, words, value = F.col("_after"), F.col("_own"), F.col("_words"), F.col("_low")
    # Each step is a projection of its own, so that no regular expression is evaluated twice.
    at = (
        rows.join(F.broadcast(noted), rows["source_id"] == noted["_source"], "left")
        .withColumns({"_low": F.lower(F.coalesce("value_text", F.lit(""))), "_own": F.lower(F.coalesce("unit_text", F.lit("")))})
        .withColumn("_after", F.regexp_replace("_low", r"^.*?" + _NUMBER, ""))
        .withColumn("_words", F.concat_ws(" ", "_after", "_own"))
        .withColumns(
            {
                "_hourly": words.rlike(r"hour|/\s*hr|\bhrs?\b|\bh\b"),
                "_hours": F.regexp_extract(words, r"(\d+(?:\.\d+)?)\s*(?:hours|hrs|hr|h)\b", 1).try_cast("decimal(10,4)"),
                "_said": F.coalesce(period(after), period(own)),
                "_pay": frequency(F.when(is_frequency, F.col("value_text")).otherwise(F.col("pay_frequency"))),
                "_amount": F.when(~own.contains("#") & ~value.contains("#"), amount(value)),
            }
        )
        .withColumns(
            {
                "_per": F.when(F.col("_hourly"), F.when(words.rlike(r"(hours|hrs|hr|h)\b\s*(a|per|/)\s*y(ea)?r"), "year").otherwise("week"))
                .when(F.col("_said") == "pay", F.col("_pay"))
                .otherwise(F.coalesce("_said", F.when(F.col("field") == "gross_annual_taxable_wages", "year").otherwise("month"))),
                "_scale": F.when(words.rlike(r"\bcents?\b|¢"), "cent")
                .when(after.rlike(r"^\s*k\b|thousand|\$?000s") | own.rlike(r"thousand|\bk\b|\$000"), "thousand")
                .when(value.rlike(r"\$|usd|dollar") | own.rlike(r"\$|usd|dollar"), "dollar")
                .when(F.col("_note").rlike(r"\bcents\b"), "cent")
                .when(F.col("_note").rlike(r"thousand|\$?000"), "thousand")
                .otherwise("dollar"),
            }
        )
    )
    money = (F.col("_amount") * F.when(F.col("_hourly"), F.col("_hours")).otherwise(F.lit(1))).cast("decimal(28,6)")
    return (
        at.withColumn("_value", F.when(is_frequency, F.lit(1).cast("decimal(28,6)")).otherwise(money))
        .withColumn("_unit", F.when(is_frequency, F.concat(F.lit("pays@"), "_pay")).otherwise(F.concat("_scale", F.lit("/"), "_per")))
        .withColumn("_target", F.when(is_frequency, "pays/year").when(F.col("field") == "gross_annual_taxable_wages", "cent/year").when(F.col("field") == "employee_monthly_allotment", "cent/month"))
        .drop("_source", "_note", "_low", "_own", "_after", "_words", "_hourly", "_hours", "_said", "_pay", "_amount", "_per", "_scale")
    )


def common_units(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every reading whose value and unit can be told, with ``common_value`` BIGINT in the field's common unit. Readings
    with null, empty or unreadable values, unknown fields, or per-pay amounts without a pay frequency are left out.
    Sources of unknown id set no scale; a source id that repeats must not, as rows would repeat."""
    spark = rows.sparkSession
    graph = payroll_units()
    frequencies = UnitGraph([(f"pays@{p}", "pays/year", n, 0) for p, n in PAYS.items()])
    table = graph.table(spark, ["cent/year", "cent/month"]).unionByName(frequencies.table(spark, ["pays/year"]))
    return converted(stated(rows, sources), table, value="_value", unit="_unit", target="_target").drop("_value", "_unit", "_target")
