"""Registers and uploads as text or cells: line grammars with owners carried down, header rows, header mapping."""

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.operators.ordered import carried


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): every line of every text, whole; null texts have none."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


#: An owner's heading and a line of code, amount and amount to date in a printed register.
OWNER = r"^\s*([A-Z][A-Z .'\-]+?)\s{2,}ID\s+(\S+)\s+PERIOD\s+(\S+)"
AMOUNTS = r"^\s*([A-Z][A-Z0-9 /&.\-]*?)\s{2,}(-?[\d,]+\.\d{2})\s+(-?[\d,]+\.\d{2})\s*$"


def register(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, emp_ord, name, id, period, line_no, code, amount, to_date): each amount line of a printed register under the
    owner whose heading stands above it. Lines before the first heading have no owner and are left out."""
    rows = lines(docs, key, text)
    head = rows.withColumn("_name", F.regexp_extract("line", OWNER, 1)).withColumns({"_owner": F.when(F.col("_name") != "", F.struct(F.col("line_no").alias("emp_ord"), F.col("_name").alias("name"), F.regexp_extract("line", OWNER, 2).alias("id"), F.regexp_extract("line", OWNER, 3).alias("period"))), "_code": F.regexp_extract("line", AMOUNTS, 1)})
    useful = head.where("_owner is not null or _code <> ''")
    owned = useful.withColumn("_at", carried(F.col("_owner"), [key], ["line_no"])).where("_code <> '' and _at is not null")
    amount = lambda g: F.replace(F.regexp_extract("line", AMOUNTS, g), F.lit(","), F.lit("")).try_cast("double")
    return owned.select(key, "_at.emp_ord", "_at.name", "_at.id", "_at.period", "line_no", F.col("_code").alias("code"), amount(2).alias("amount"), amount(3).alias("to_date"))


def tail_numbers(line, n: int = 9):
    """The last ``n`` numbers of a line, as registers in columns print them; null if it has fewer. A minus counts before a
    number alone, not behind it."""
    found = F.transform(F.regexp_extract_all(line, F.lit(r"(-?[\d,]*\.\d\d)"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.when(F.size(found) >= n, F.slice(found, -n, n))


def looks_like(text: str):
    """The kind of a payroll text: a register in columns, one with headings, statements, or unknown."""
    t = F.col(text)
    return F.when(t.rlike(r"(?i)district totals"), "columns").when(t.rlike(OWNER.replace("^", "(?m)^")), "headings").when(t.rlike(r"(?i)net pay"), "statement").otherwise("unknown")


def header_row(cells: DataFrame, sheet: Sequence[str], row: str = "row_ord", values: str = "cells", most: int = 12, least: int = 4) -> DataFrame:
    """(sheet, header): the first of the first ``most`` rows with ``least`` filled cells, one a word; 0 if none."""
    filled = F.size(F.filter(values, lambda c: c.isNotNull() & (F.trim(c) != "")))
    worded = F.exists(values, lambda c: c.rlike("[A-Za-z]"))
    return cells.where(F.col(row) < most).groupBy(*sheet).agg(F.coalesce(F.min(F.when((filled >= least) & worded, F.col(row))), F.lit(0)).alias("header"))


def map_headers(headers: DataFrame, key: Sequence[str], wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, field, header, tier): per field the header that fits it best: 1 the field's own name, 2 a synonym, 3 a header
    that contains one. Of equals the first synonym, then the first header. ``headers`` has key, header, hdr_ord."""
    spark = headers.sparkSession
    plain = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    known = [(f, 1, 0, plain(f)) for f in wanted] + [(f, 2, i, plain(s)) for f, own in wanted.items() for i, s in enumerate(own)]
    syn = spark.createDataFrame(known, "field string, tier int, syn_ord int, syn string")
    mine = headers.withColumn("_h", F.trim(F.regexp_replace(F.lower("header"), "[^a-z0-9]+", " ")))
    exact = mine.join(F.broadcast(syn), F.col("_h") == F.col("syn")).select(*key, "header", "hdr_ord", "field", "tier", "syn_ord")
    # A header that contains a synonym has it among its runs of words, so that too is an equi-join.
    words = F.split("_h", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    within = mine.where("_h <> ''").withColumn("_run", F.explode(F.array_distinct(runs))).join(F.broadcast(syn.where("tier = 2")), F.col("_run") == F.col("syn")).where("_run <> _h").select(*key, "header", "hdr_ord", "field", F.lit(3).alias("tier"), "syn_ord")
    best = exact.unionByName(within).groupBy(*key, "field").agg(F.min(F.struct("tier", "syn_ord", "hdr_ord", "header")).alias("_b"))
    return best.select(*key, "field", "_b.header", "_b.tier")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row_ord, cells) of a spreadsheet file: values as text, shared strings looked up, gaps as null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        for i, title in enumerate(titles, 1):
            part = f"xl/worksheets/sheet{i}.xml"
            if part not in names:
                continue
            for n, row in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{_NS}row")):
                cells: list[str | None] = []
                for c in row.iter(f"{_NS}c"):
                    col = 0
                    for ch in re.match("[A-Z]*", c.get("r") or "").group():
                        col = col * 26 + ord(ch) - 64
                    while len(cells) < (col or len(cells) + 1) - 1:
                        cells.append(None)
                    v, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{_NS}t")) if inline is not None else v.text if v is not None else None
                    cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
                yield title, n, cells


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_ord, cells) of the spreadsheet and CSV files under a folder; a file that can't be read gives one
    row with a null sheet. Files are read where they are worked on, one task a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for df in batches:
            out = []
            for name, data in zip(df["path"], df["content"]):
                try:
                    if name.lower().endswith((".xlsx", ".xlsm")):
                        out += [(name, s, n, c) for s, n, c in workbook_rows(data)]
                    else:
                        out += [(name, "csv", n, c) for n, c in enumerate(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    out.append((name, None, None, None))
            yield pd.DataFrame(out, columns=["path", "sheet", "row_ord", "cells"])

    return files.mapInPandas(run, "path string, sheet string, row_ord int, cells array<string>")


def best_sheet(scored: DataFrame, file: Sequence[str], score: str, title: str, hint: str, order: str) -> DataFrame:
    """The sheet of each file that most wanted fields map to, five more for a hint in its title; of equals the first."""
    worth = F.col(score) + F.when(F.lower(title).contains(hint.lower()), 5).otherwise(0)
    return scored.withColumn("_n", F.row_number().over(W.partitionBy(*file).orderBy(worth.desc(), order))).where("_n = 1").drop("_n")
