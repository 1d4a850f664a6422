"""Amounts: rounding, reading, plausibility, consensus. All are Column expressions; nulls mean "not printed"."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of equal printed amounts.
CENT = 0.02
#: Bounds of each figure as a share of gross.
PLAUSIBLE = {
    "federal": (0, 0.45), "state": (0, 0.20), "social_security": (0, 0.07), "medicare": (0, 0.03), "taxable_wages": (0.10, 1.05), "medicare_gross": (0.20, 1.05),
    "net_pay": (0.25, 1.00), "retirement": (0, 0.30), "cafeteria": (0, 0.40), "premium": (0, 0.60), "fee": (0, 0.20),
}


def r2(x: Column) -> Column:
    """``x`` to the cent: half up on six decimals, so that every engine agrees; never minus zero."""
    return F.round(x.cast("decimal(28,6)"), 2).cast("double") + F.lit(0.0)


def per_month(amount: Column, periods: Column) -> Column:
    """An amount per pay as an amount per month; null without periods."""
    return F.when(periods > 0, r2(amount * periods / F.lit(12.0)))


def number(text: Column) -> Column:
    """A typed amount: signs and separators of money dropped, brackets negate; null if it is no number."""
    t = F.trim(F.regexp_replace(text, r"[$,]", ""))
    inner = F.regexp_replace(t, r"^\((.*)\)$", "$1")
    value = F.when(inner.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), inner).try_cast("double")
    return F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)


def printed_amount(text: Column) -> Column:
    """An amount as it is printed: at most two decimals, a minus before or after or brackets; else null."""
    t = F.trim(F.regexp_replace(text, r"[$,\s]", ""))
    core = F.regexp_replace(t, r"^[-(]+|[-)]+$", "")
    value = F.when(core.rlike(r"^\d*\.?\d{0,2}$") & core.rlike(r"\d"), core).try_cast("double")
    return F.when(t.rlike(r"^[-(]|-$"), -value).otherwise(value)


def first_cents(text: Column) -> Column:
    """The first amount with two decimals in scanned text, whatever its dashes; null if there is none."""
    t = F.translate(text, "—–−,", "---")
    return F.regexp_extract(t, r"(-?\d+\.\d{2})", 1).try_cast("double")


def plausible(value: Column, gross: Column, low: float, high: float) -> Column:
    """``value`` if it may be right for this gross: within the shares, to the cent; negative values pass; without a
    positive gross everything does."""
    fits = (F.abs(value) >= gross * low - 0.01) & (F.abs(value) <= gross * high + 0.01)
    return F.when(gross.isNull() | (gross <= 0) | (value < 0) | fits, value)


def validated(bounds: Mapping[str, tuple[float, float]] = PLAUSIBLE, gross: str = "gross") -> dict[str, Column]:
    """Each bounded column with implausible values taken out."""
    return {k: plausible(F.col(k), F.col(gross), lo, hi) for k, (lo, hi) in bounds.items()}


def consensus(ranked: Sequence[Column], tolerance: float = CENT) -> Column:
    """The first of several printings of a figure, in order of preference, that another agrees with; null if none."""
    given = F.array(*(F.struct(F.lit(i).alias("rank"), c.cast("double").alias("v")) for i, c in enumerate(ranked)))
    some = F.filter(given, lambda x: x["v"].isNotNull())
    agreed = F.filter(some, lambda x: F.exists(some, lambda y: (x["rank"] != y["rank"]) & (F.abs(x["v"] - y["v"]) <= tolerance)))
    return F.try_element_at(agreed, F.lit(1))["v"]


def modal(candidates: Column, tolerance: float = CENT) -> Column:
    """The value of an array that most of its values agree with; of equals the first."""
    votes = F.transform(candidates, lambda x, i: F.struct(F.size(F.filter(candidates, lambda y: F.abs(x - y) <= tolerance)).alias("n"), (-i).alias("i"), x.alias("v")))
    return F.array_max(F.filter(votes, lambda v: v["v"].isNotNull()))["v"]


def agreeing_mean(votes: Sequence[Column], tolerance: float) -> Column:
    """Several estimates of one figure: the mean of those that agree with the estimate that most agree with."""
    some = F.filter(F.array(*votes), lambda x: x.isNotNull())
    centre = modal(some, tolerance)
    near = F.filter(some, lambda x: F.abs(x - centre) <= tolerance)
    return F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(near), F.lit(0))


def by_subtraction(gross: Column, net: Column, total: Column, others: Sequence[Column], share: float = 0.45) -> Column:
    """One deduction as the total less all others, only if the total is gross less net and the rest is possible."""
    rest = total - reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in others))
    return F.when((F.abs(gross - net - total) <= CENT) & (rest >= -0.01) & (rest <= share * gross), r2(F.greatest(rest, F.lit(0.0))))


def anchored_gross(gross: Column, anchor: Column) -> Column:
    """The printed gross, or the expected one where nothing is printed or it is off by more than a dollar and two per
    cent, as a column of totals to date would be."""
    off = F.abs(gross - anchor) > F.greatest(F.lit(1.0), anchor * 0.02)
    return F.when(anchor.isNotNull() & (anchor != 0) & (gross.isNull() | off), r2(anchor)).otherwise(gross)


def shares_value(value: Column, others: Sequence[Column]) -> Column:
    """Whether a figure repeats another of its record, as a column misread does."""
    return F.exists(F.filter(F.array(*others), lambda x: x.isNotNull()), lambda x: F.abs(F.abs(x) - F.abs(value)) <= CENT)


#: Digits that scans take for others.
CONFUSED = {"5": "683", "6": "58", "1": "47", "4": "19", "7": "1", "8": "360", "3": "89", "9": "43", "0": "86", "2": "7"}


def misreadings(value: Column, limit: int = 40) -> Column:
    """Array of (value, weight): what a figure may have been, one misread digit at a time, a lost leading digit, or a
    lost point; heaviest first, ``limit`` at most."""
    s = F.format_string("%.2f", value)
    at = F.sequence(F.lit(1), F.length(s))
    swaps = F.create_map(*(x for k, v in CONFUSED.items() for x in (F.lit(k), F.split(F.lit(v), ""))))
    one = F.flatten(
        F.transform(
            at,
            lambda i: F.transform(
                F.coalesce(F.try_element_at(swaps, F.substring(s, i, F.lit(1))), F.array().cast("array<string>")),
                lambda c: F.struct(
                    F.concat(F.substring(s, F.lit(1), i - 1), c, F.substring(s, i + 1, F.length(s))).try_cast("double").alias("value"),
                    (1.0 / F.size(F.try_element_at(swaps, F.substring(s, i, F.lit(1))))).alias("weight"),
                ),
            ),
        )
    )
    lost = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda d: F.struct(F.concat(d.cast("string"), s).try_cast("double").alias("value"), F.lit(0.02).alias("weight")))
    point = F.array(F.struct((value * 100).alias("value"), F.lit(0.01).alias("weight")))
    every = F.filter(F.concat(one, lost, point), lambda x: x["value"].isNotNull() & (F.abs(x["value"] - value) > 0.001))
    ranked = F.array_sort(F.transform(every, lambda x: F.struct((-x["weight"]).alias("w"), x["value"].alias("value"))))
    return F.transform(F.slice(ranked, 1, limit), lambda x: F.struct(r2(x["value"]).alias("value"), (-x["w"]).alias("weight")))


def lost_comma(value: Column) -> Column:
    """The texts under which a scan prints an amount: with its comma, without, with a point or blank for it; null for null."""
    plain, full = F.format_string("%.2f", value), F.format_number(value, 2)
    return F.when(value.isNotNull(), F.array_distinct(F.array(full, plain, F.replace(full, F.lit(","), F.lit(".")), F.replace(full, F.lit(","), F.lit(" ")))))


def money(value: Column) -> Column:
    """Dollars with sign first and cents; null prints as a dash."""
    return F.when(value.isNull(), "-").otherwise(F.concat(F.when(value < 0, "-$").otherwise("$"), F.format_number(F.abs(value), 2)))


def plain_money(value: Column) -> Column:
    """Figures with separators and cents, no sign of money; empty for null."""
    return F.coalesce(F.format_number(value, 2), F.lit(""))


def signed_money(value: Column) -> Column:
    """Dollars with plus or minus before them, as changes are printed; a dash for null."""
    return F.when(value.isNull(), "-").otherwise(F.concat(F.when(value < 0, "-").otherwise("+"), F.lit("$"), F.format_number(F.abs(value), 2)))


def bracketed_money(value: Column) -> Column:
    """Dollars with brackets around what is negative, as ledgers print it; a dash for null."""
    figures = F.concat(F.lit("$"), F.format_number(F.abs(value), 2))
    return F.when(value.isNull(), "-").when(value < 0, F.concat(F.lit("("), figures, F.lit(")"))).otherwise(figures)


def repeats_another(value: Column, others: Sequence[Column]) -> Column:
    """``value`` unless it repeats another figure of its record to the cent, as a misread column does; zeros may repeat."""
    return F.when((F.abs(value) <= CENT) | ~F.coalesce(shares_value(value, others), F.lit(False)), value)


def taxable_wages(printed: Column, medicare_gross: Column, retirement: Column) -> Column:
    """Taxable wages as printed, else Medicare wages less retirement."""
    return F.coalesce(printed, r2(medicare_gross - F.coalesce(retirement, F.lit(0.0))))


def overridden(by_place: Column, by_text: Column) -> Column:
    """A figure read by its place on the page before one read from text, with a note where both are there and differ."""
    differ = F.coalesce(F.abs(by_place - by_text) > CENT, F.lit(False))
    return F.struct(F.coalesce(by_place, by_text).alias("value"), F.when(differ, F.concat(plain_money(by_text), F.lit(" -> "), plain_money(by_place))).alias("note"))


def repaired(columns: dict[str, Column], gross: str, anchor: Column) -> dict[str, Column]:
    """Gross anchored, then every bounded figure taken out that can't be right for it: the order matters, as bounds of an
    unanchored gross would take out what is right. ``columns``: names -> printed figures, ``gross`` among them."""
    base = anchored_gross(columns[gross], anchor)
    return {gross: base} | {k: plausible(columns[k], base, low, high) for k, (low, high) in PLAUSIBLE.items() if k in columns}
