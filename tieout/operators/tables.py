"""Tables of people on pages, pages as plain lines, and blocks of scanned registers."""

import re
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.operators.geometry import bands, value_of

#: Words that open a line of sums; least fields of a header; lines below it that teach its columns; least
#: score and rows of a table.
SUMS = re.compile(r"^\s*(grand |sub ?|page )?(total|average|count)s?\b", re.IGNORECASE)
FIELDS, TAUGHT, SCORE, ROWS = 3, 40, 0.5, 2


class _Page:
    """Words of a page in lines, each with its amounts."""

    def __init__(self, words: pd.DataFrame):
        w = words.sort_values("word_id").reset_index(drop=True)
        self.text, self.id = w["text"].tolist(), w["word_id"].tolist()
        self.x0, self.x1 = w["x0"].to_numpy(float), w["x1"].to_numpy(float)
        self.value = np.array([np.nan if (v := value_of(t)) is None else v for t in self.text], float)
        self.height = float(np.median(w["y1"] - w["y0"])) if len(w) else 0.0
        band = bands(w["y0"].to_numpy(float), w["y1"].to_numpy(float))
        self.lines = [np.flatnonzero(band == b)[np.argsort(self.x0[band == b], kind="stable")] for b in range(int(band.max()) + 1 if len(band) else 0)]

    def amounts(self, line: np.ndarray) -> np.ndarray:
        return line[~np.isnan(self.value[line])]

    def named(self, line: np.ndarray, aliases: Mapping[str, str]) -> dict[str, tuple[float, float]]:
        """The fields that runs of words close together name, with the x range of the run."""
        out: dict[str, tuple[float, float]] = {}
        words = line[np.isnan(self.value[line])]
        ends = np.flatnonzero(self.x0[words][1:] - self.x1[words][:-1] > 1.5 * self.height) + 1
        for run in np.split(words, ends):
            said = " ".join(self.text[i] for i in run).lower()
            field = next((f for f, pattern in aliases.items() if re.search(pattern, said)), None)
            if field and len(run):
                a, b = out.get(field, (np.inf, -np.inf))
                out[field] = (min(a, self.x0[run].min()), max(b, self.x1[run].max()))
        return out


def _columns(page: _Page, named: Mapping[str, tuple[float, float]], below: list[np.ndarray]) -> dict[str, tuple[float, float]]:
    """Each named field with the right edge of the amounts under its heading and how far from it they may end."""
    taught = [page.x1[page.amounts(line)] for line in below[:TAUGHT]]
    edges = np.concatenate(taught) if taught else np.zeros(0)
    out = {}
    for f, (a, b) in named.items():
        own = edges[(edges >= a - 2 * page.height) & (edges <= b + 4 * page.height)]
        if len(own) >= 2:
            middle = float(np.median(own))
            out[f] = (middle, max(1.5 * page.height, 4 * float(np.median(np.abs(own - middle))), 10.0))
    return out


def _cells(page: _Page, line: np.ndarray, columns: Mapping[str, tuple[float, float]]) -> dict[str, int]:
    """The word of a line that stands in each column: the nearest to its edge within reach."""
    some = page.amounts(line)
    out = {}
    for f, (edge, reach) in columns.items():
        off = np.abs(page.x1[some] - edge)
        if len(off) and off.min() <= reach:
            out[f] = int(some[off.argmin()])
    return out


def _header(page: _Page, aliases: Mapping[str, str]) -> tuple[int, dict[str, tuple[float, float]]] | None:
    """The line that ends the page's best header, and its columns: a line, or two read as one, that names enough fields,
    whose columns many of the lines below fill. Of equals the first."""
    best: tuple[float, int, dict[str, tuple[float, float]]] | None = None
    for n, line in enumerate(page.lines):
        one = page.named(line, aliases)
        tries = [(n, one)]
        if n + 1 < len(page.lines):
            two = dict(one)
            for f, (a, b) in page.named(page.lines[n + 1], aliases).items():
                two[f] = (min(a, two[f][0]), max(b, two[f][1])) if f in two else (a, b)
            if len(two) > len(one):
                tries.append((n + 1, two))
        for last, named in tries:
            if len(named) < FIELDS:
                continue
            below = page.lines[last + 1 :]
            columns = _columns(page, named, below)
            rows = sum(len(_cells(page, x, columns)) >= FIELDS for x in below[:TAUGHT])
            score = 0.4 * min(1.0, len(columns) / 5) + 0.6 * min(1.0, rows / 5)
            if len(columns) >= FIELDS and score >= SCORE and rows >= ROWS and (best is None or score > best[0]):
                best = (score, last, columns)
    return best and (best[1], best[2])


def read_table(words: pd.DataFrame, aliases: Mapping[str, str]) -> list[tuple]:
    """(row, kind, person, field, value) of a page read as a table of people; nothing if it is none. Lines under the
    header are employees (a name and two filled columns), continuations (columns without a name, which fill what the
    employee above lacks), repeats of the header, sums, unread (a name without figures) or sections. One row for each
    filled column of an employee, and one with null field for every other line."""
    page = _Page(words)
    found = _header(page, aliases)
    if not found:
        return []
    last, columns = found
    out: list[tuple] = []
    filled: dict[str, int] = {}
    owner = None
    for n, line in enumerate(page.lines[last + 1 :], last + 1):
        plain = [page.text[i] for i in line if np.isnan(page.value[i])]
        name = " ".join(plain[:4]).strip()
        cells = _cells(page, line, columns)
        letters = len(re.sub("[^A-Za-z]", "", name)) >= 3
        if len(page.named(line, aliases)) >= FIELDS and len(cells) <= 1:
            kind = "header"
        elif SUMS.search(name):
            kind = "sums"
        elif letters and len(cells) >= 2:
            kind, owner, filled = "employee", (n, name), {}
        elif not letters and cells and owner:
            kind = "continuation"
        else:
            kind = "unread" if letters else "section"
        if kind in ("employee", "continuation"):
            new = {f: i for f, i in cells.items() if f not in filled}
            filled |= new
            out += [(owner[0], kind, owner[1], f, float(page.value[i])) for f, i in new.items()]
        else:
            out.append((n, kind, name, None, None))
    return out


def read_tables(words: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """(doc, page, row, kind, person, field, value): ``read_table`` of every page; ``aliases``: field -> pattern of its
    heading in lower case. A page is one task's work."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame([(*key, *r) for r in read_table(df, aliases)], columns=["doc", "page", "row", "kind", "person", "field", "value"])
        return made.astype({"value": "float64"})

    return words.groupBy("doc", "page").applyInPandas(run, "doc long, page int, row int, kind string, person string, field string, value double")


def accounted(rows: DataFrame) -> DataFrame:
    """(doc, page, n_employees, n_continued, n_other): the lines of each page read as a table, by what became of them."""
    one = rows.groupBy("doc", "page", "row", "kind").agg(F.lit(1).alias("_one"))
    return one.groupBy("doc", "page").agg(F.count_if(F.col("kind") == "employee").alias("n_employees"), F.count_if(F.col("kind") == "continuation").alias("n_continued"), F.count_if(~F.col("kind").isin("employee", "continuation")).alias("n_other"))


def grid_lines(words: DataFrame) -> DataFrame:
    """(doc, page, line, text): words by rows of a fixed grid, in order of their left edges, a bar where the gap to the
    word before is over 1.6 of the usual height, so that a label keeps the amount beside it."""
    usual = words.groupBy("doc", "page").agg(F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).alias("_h"))
    at = words.join(usual, ["doc", "page"]).withColumn("line", F.floor((F.col("y0") + F.col("y1")) / 2 / F.greatest(F.lit(4.0), 0.7 * F.col("_h"))).cast("int"))
    rows = at.groupBy("doc", "page", "line").agg(F.max("_h").alias("_h"), F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("w"))
    gap = lambda i: F.get(F.col("w"), i)["x0"] - F.get(F.col("w"), i - 1)["x1"] > F.greatest(F.lit(10.0), 1.6 * F.col("_h"))
    parts = F.transform("w", lambda w, i: F.when((i > 0) & gap(i), F.concat(F.lit("| "), w["text"])).otherwise(w["text"]))
    return rows.select("doc", "page", "line", F.array_join(parts, " ").alias("text"))


def page_scores(words: DataFrame) -> DataFrame:
    """(doc, page, lines, plausible): how much a reading looks like lines of text (the upper median of words in a line, and
    four times the share of lines with four or more), and like language and money (the share of words that are whole
    words or amounts, and a thousandth of letters and digits). Lines are the rows of ``grid_lines``."""
    row = words.groupBy("doc", "page", F.floor((F.col("y0") + F.col("y1")) / 2 / 7).alias("_line")).agg(F.count("*").alias("n"))
    n = row.groupBy("doc", "page").agg(F.array_sort(F.collect_list("n")).alias("_n"), F.count_if(F.col("n") >= 4).alias("_many"), F.count("*").alias("_rows"))
    lines = F.get("_n", F.floor(F.size("_n") / 2).cast("int")) + 4.0 * F.col("_many") / F.col("_rows")
    good = F.col("text").rlike(r"^([A-Za-z][A-Za-z'\-.]{2,}|[\d,]+\.\d{2})$")
    signs = F.length(F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    said = words.groupBy("doc", "page").agg((F.count_if(good) / F.count("*") + 0.001 * F.sum(signs)).alias("plausible"))
    return n.select("doc", "page", F.round(lines, 6).alias("lines")).join(said.withColumn("plausible", F.round("plausible", 6)), ["doc", "page"])


def blocks(tokens: DataFrame, end: str = "Totals", keep: str = "Net", sums: str = r"Totals for|Employees\s|Female|Male", near: float = 0.008, reach: float = 0.004) -> DataFrame:
    """``tokens`` (doc, page, t, x, y from the bottom) with ``block``: the height of the row of ``end`` that closes the
    employee's block a token is in, the nearest at or under it; rows of ``end`` nearer than ``near`` are one. Blocks of
    sums, which have their words and no ``keep``, are left out, as are tokens under the last such row and pages without
    one. Heights of ``end`` are few on a page: they travel as an array, and tokens meet no other page's."""
    w = W.partitionBy("doc", "page").orderBy(F.desc("y"))
    ends = tokens.where(F.col("t") == end).select("doc", "page", "y").distinct().withColumn("_up", F.lag("y").over(w))
    ends = ends.where(F.col("_up").isNull() | (F.col("_up") - F.col("y") > near)).groupBy("doc", "page").agg(F.collect_list("y").alias("_ends"))
    at = tokens.join(ends, ["doc", "page"]).withColumn("block", F.array_max(F.filter("_ends", lambda e: e - reach <= F.col("y")))).where("block is not null").drop("_ends")
    said = at.groupBy("doc", "page", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("a"), "x", "t"))), lambda s: s["t"]), " ").alias("_said"), F.max(F.col("t") == keep).alias("_keep"))
    return at.join(said.where(F.col("_keep") | ~F.col("_said").rlike(sums)).select("doc", "page", "block"), ["doc", "page", "block"])


def block_people(block_tokens: DataFrame, net: str = "Net") -> DataFrame:
    """(doc, page, block, name, net) of the tokens of ``blocks``: the words of the topmost row that has some, and the first
    amount right of ``net`` in its row; of several such rows the figure most of them print, of equals the greatest."""
    word = F.col("t").rlike(r"^[A-Za-z][A-Za-z'\-.,]*$")
    named = block_tokens.where(word).groupBy("doc", "page", "block", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "t"))), lambda s: s["t"]), " ").alias("name"))
    name = named.groupBy("doc", "page", "block").agg(F.max_by("name", "y").alias("name"))
    amount = F.when(F.col("t").rlike(r"^-?[\d,]*\.\d\d$"), F.replace("t", F.lit(","), F.lit("")).try_cast("double"))
    label = block_tokens.where(F.col("t") == net).groupBy("doc", "page", "block", "y").agg(F.min("x").alias("_x"))
    right = block_tokens.withColumn("v", amount).where("v is not null").join(label, ["doc", "page", "block", "y"]).where("x > _x").groupBy("doc", "page", "block", "y").agg(F.min_by("v", "x").alias("v"))
    votes = right.groupBy("doc", "page", "block", "v").agg(F.count("*").alias("n"))
    nets = votes.groupBy("doc", "page", "block").agg(F.max(F.struct("n", "v")).alias("_t")).select("doc", "page", "block", F.col("_t.v").alias("net"))
    return name.join(nets, ["doc", "page", "block"], "left")
