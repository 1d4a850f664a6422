"""Names, codes, labels and periods in text. All are Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How pay frequencies are written.
FREQUENCIES = {"12": 12, "24": 24, "26": 26, "52": 52, "monthly": 12, "semi-monthly": 24, "semimonthly": 24, "bi-weekly": 26, "biweekly": 26, "weekly": 52}
#: Letters with marks and their plain forms.
_MARKED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ", "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def norm(text: Column) -> Column:
    """Lower case letters and digits, all else one blank. Marks are dropped from letters, so that an accent doesn't split
    a word."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, _MARKED, _PLAIN)), "[^a-z0-9]+", " "))


def name_key(first: Column, last: Column) -> Column:
    """First and last name as one key; null parts as empty."""
    return F.trim(F.concat_ws(" ", norm(F.coalesce(first, F.lit(""))), norm(F.coalesce(last, F.lit("")))))


def match_key(name: Column) -> Column:
    """The key of a printed name: "Last, First Middle" and "First Middle Last" both give first and last part."""
    n = norm(name)
    parts = F.split(n, " ")
    turned = name_key(F.element_at(F.split(F.trim(F.substring_index(name, ",", -1)), " +"), 1), F.substring_index(name, ",", 1))
    plain = F.when(F.size(parts) > 1, F.concat_ws(" ", parts[0], F.element_at(parts, -1))).otherwise(n)
    return F.when(name.contains(","), turned).otherwise(plain)


def short_key(key: Column) -> Column:
    """Last part and first three letters of a key of two or more parts; null else."""
    parts = F.split(key, " ")
    return F.when(F.size(parts) > 1, F.concat_ws("|", F.element_at(parts, -1), F.substring(parts[0], 1, 3)))


def pay_periods(text: Column) -> Column:
    """Pay periods per year of a written frequency; 12 where it is unreadable or missing."""
    table = F.create_map(*(x for k, v in FREQUENCIES.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(text))), F.lit(12))


def folded(text: Column) -> Column:
    """Text with letters and digits that scans confuse made one."""
    return F.translate(F.replace(F.lower(text), F.lit("rn"), F.lit("m")), "1it0d586q", "llloosbgg")


def identity_tokens(text: Column, most: int = 8) -> Column:
    """The ids and dates of a page: distinct, sorted, the first ``most``."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\b(\d{4,9})\b"), 1), F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}/\d{1,2}(?:/\d{2,4})?)\b"), 1))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def figures(text: Column) -> Column:
    """The distinct amounts with cents that a text states, without separators, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*\.\d{2})"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")))))


def tightened(text: Column, most: int = 5000) -> Column:
    """The lines with a digit and three letters, cut at ``most`` characters, as a reader with a budget is given them."""
    keep = F.filter(F.split(text, "\n"), lambda x: x.rlike("[0-9]") & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 3))
    return F.substring(F.array_join(keep, "\n"), 1, most)


def period_of(text: Column) -> Column:
    """The pay period or cheque date that a page states, as it is written; empty if none."""
    return F.regexp_extract(text, r"(?i)\bperiod\b[^0-9\n]{0,20}(\d{1,2}/\d{1,2}(?:/\d{2,4})?)", 1)


def label_amount(text: Column, label: str) -> Column:
    """The first amount after a label, on the first line that has both; null if there is none."""
    return F.replace(F.regexp_extract(text, rf"(?im)^[^\n]*?{label}[^\n0-9]*?(-?\d[\d,]*\.\d{{2}})", 1), F.lit(","), F.lit("")).try_cast("double")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ; 999 if either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


def key_of(*parts: Column) -> Column:
    """A content key: the digest of the parts with a separator that no text has."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with its {keys} replaced; unknown keys stay, null values print as empty."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def titled(text: Column) -> Column:
    """Each word with a capital; words of two or three capitals stay as they are."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(w.rlike("^[A-Z]{2,3}$"), w).otherwise(F.initcap(w))), " ")


def w4(text: Column) -> Column:
    """Status, several jobs, children and extra withholding of a W-4 line on a statement; nulls where it says nothing."""
    pick = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(
        F.upper(F.substring(pick(r"(?i)(?:filing|marital) status\s*:?\s*(single|married|head|[smh])\b"), 1, 1)).alias("status"),
        F.upper(F.substring(pick(r"(?i)(?:multiple jobs|step 2\(?c\)?)\s*:?\s*(y|n|yes|no)\b"), 1, 1)).alias("multijob"),
        pick(r"(?i)(?:children|dependents)\s*:?\s*(\d+)").try_cast("int").alias("children"),
        F.replace(pick(r"(?i)extra(?: withholding)?\s*:?\s*\$?([\d,]+\.\d{2})"), F.lit(","), F.lit("")).try_cast("double").alias("extra"),
    )


def deposits(text: Column) -> Column:
    """The last amount of each line between a heading of deposits and its total; empty without one."""
    part = F.regexp_extract(text, r"(?is)direct deposit[^\n]*\n(.*?)(?:\n[^\n]*total|\z)", 1)
    rows = F.transform(F.split(part, "\n"), lambda x: F.replace(F.regexp_extract(x, r"([\d,]+\.\d{2})\D*$", 1), F.lit(","), F.lit("")).try_cast("double"))
    return F.filter(rows, lambda x: x.isNotNull())


def person(text: Column) -> Column:
    """The name and id that a statement is for."""
    pick = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.struct(pick(r"(?im)^\s*(?:employee(?: name)?|name)\s*:\s*([^\n]+?)\s*$").alias("name"), pick(r"(?i)(?:employee|emp)\s*(?:id|no|number)\s*:?\s*([A-Z]?-?\d{2,})").alias("id"))


def json_of(text: Column, schema: str) -> Column:
    """The outermost JSON object in a text, read by a schema; null if there is none or it is broken."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def nearest_amount(line: Column, label: str) -> Column:
    """The first amount behind a label in a line, else the last one before it; null without label or amount."""
    amount = r"(-?\d[\d,]*\.\d{2})"
    behind = F.regexp_extract(line, rf"(?i)^.*?(?:{label})(.*)$", 1)
    before = F.regexp_extract(line, rf"(?i)^(.*?)(?:{label})", 1)
    first, last = F.regexp_extract(behind, amount, 1), F.regexp_extract(before, rf"^.*?{amount}[^0-9]*$", 1)
    found = F.when(line.rlike(rf"(?i){label}"), F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))))
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def compact_amount(text: Column, label: str) -> Column:
    """The first amount of the first line that has a label once all but letters and digits are taken away, as scans print
    labels with their blanks lost; null if no such line has an amount."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.contains(F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), F.lit(label)) & x.rlike(r"\d[\d,]*\.\d{2}"))
    return F.replace(F.regexp_extract(F.get(rows, 0), r"(-?\d[\d,]*\.\d{2})", 1), F.lit(","), F.lit("")).try_cast("double")


def layout_of(title: Column) -> Column:
    """The layout of a scanned register by its title: before processing, or final."""
    return F.when(title.rlike(r"(?i)pre\s*-?\s*process"), "preprocess").otherwise("final")


def slot_of(file_name: Column) -> Column:
    """Which slot a file of a folder goes into, by its name; null where the name says nothing."""
    n = F.lower(file_name)
    return F.when(n.contains("census"), "census").when(n.contains("proposal") | n.contains("report"), "proposal").when(n.contains("before") | n.contains("previous"), "before").when(n.contains("after") | n.contains("mock"), "after")


def readable(text: Column, words: int = 40, share: float = 0.8) -> Column:
    """Whether a text layer can be used: enough words, of which enough of all characters but blanks are letters and digits."""
    packed = F.regexp_replace(text, r"\s", "")
    count = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    good = F.length(F.regexp_replace(packed, "[^A-Za-z0-9]", ""))
    return F.coalesce((count >= words) & (F.length(packed) > 0) & (good >= share * F.length(packed)), F.lit(False))


def reads_ok(text: Column, words: int = 15, amounts: int = 3) -> Column:
    """Whether a page reads like a statement: words of three letters and amounts enough."""
    long = F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z]{3,})"), 1))
    return F.coalesce((long >= words) & (F.size(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*\.\d{2})"), 1)) >= amounts), F.lit(False))


def at_path(json: Column, path: str) -> Column:
    """The value at a dotted path of JSON text, as text; null where the path leads nowhere or the JSON is broken."""
    return F.get_json_object(json, "$." + path)


def wide_words(box: Column, x0: Column, x1: Column) -> Column:
    """The words of a box that a reader took for one, as an array of (word, x0, x1): each gets its share of the box's
    width by where its letters stand in the text."""
    step = (x1 - x0) / F.greatest(F.length(box), F.lit(1))
    parts = F.split(box, " ")
    begins = F.slice(F.aggregate(parts, F.array(F.lit(0)).cast("array<int>"), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w) + 1))), F.lit(1), F.size(parts))
    cut = F.zip_with(parts, begins, lambda w, b: F.struct(w.alias("word"), (x0 + b * step).alias("x0"), (x0 + (b + F.length(w)) * step).alias("x1")))
    return F.filter(cut, lambda w: w["word"] != "")
