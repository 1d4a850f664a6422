"""Words on pages to fields and tables. A page is one task's work: its words are few, and its rules depend on order."""

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AMOUNT = re.compile(r"^\(?-?\$?\d[\d,]*\.\d{2}-?\)?$")


def words_of_text(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: float = 6.0, height: float = 12.0) -> DataFrame:
    """(doc, page, word_id, text, x0, y0, x1, y1, conf) of typewritten pages: each character a box of fixed width, each
    line a band. Pages end at form feeds."""
    pages = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\f")).alias("page", "_t"))
    rows = pages.select("doc", "page", F.posexplode(F.split("_t", "\r?\n")).alias("_l", "_line"))
    # A word's place is the length of all before it: blanks are kept as their own pieces, lengths summed once a line.
    pieces = rows.select("doc", "page", "_l", F.regexp_extract_all("_line", F.lit(r"(\s+|\S+)"), 1).alias("_all"))
    starts = F.aggregate("_all", F.array(F.lit(0)).cast("array<int>"), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w))))
    placed = F.filter(F.zip_with("_all", starts, lambda w, s: F.struct(w.alias("w"), s.alias("s"))), lambda x: x["w"].rlike(r"\S"))
    parts = pieces.select("doc", "page", "_l", F.explode(placed).alias("_p"))
    start, word = F.col("_p.s"), F.col("_p.w")
    boxed = parts.select("doc", "page", "_l", word.alias("text"), (start * width).alias("x0"), (F.col("_l") * height).alias("y0"), ((start + F.length(word)) * width).alias("x1"), (F.col("_l") * height + height * 0.8).alias("y1"))
    return boxed.select("doc", "page", (F.col("_l") * 10_000 + (F.col("x0") / width).cast("int")).cast("int").alias("word_id"), "text", "x0", "y0", "x1", "y1", F.lit(1.0).alias("conf"))


def bands(y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """The row band of each word, from the top: a word joins the nearest band whose running median centre is within 0.45
    of the usual height, 3 at least, else it opens one."""
    if not len(y0):
        return np.zeros(0, int)
    centre, reach = (y0 + y1) / 2, max(3.0, 0.45 * float(np.median(y1 - y0)))
    order = np.argsort(centre, kind="stable")
    members: list[list[float]] = []
    out = np.zeros(len(y0), int)
    for i in order:
        # Centres come in rising order, so a band's are sorted and its median is its middle.
        near = [(abs((m[len(m) // 2] + m[(len(m) - 1) // 2]) / 2 - centre[i]), k) for k, m in enumerate(members[-3:], max(0, len(members) - 3))]
        best = min(near, default=(np.inf, 0))
        if best[0] <= reach:
            members[best[1]].append(float(centre[i]))
            out[i] = best[1]
        else:
            members.append([float(centre[i])])
            out[i] = len(members) - 1
    return out


def occupancy(x0: np.ndarray, x1: np.ndarray, low: float, high: float, bins: int = 400) -> np.ndarray:
    """How many words stand over each of ``bins`` strips between ``low`` and ``high``."""
    scale = bins / max(high - low, 1e-9)
    a = np.clip(((x0 - low) * scale).astype(int), 0, bins - 1)
    b = np.clip(((x1 - low) * scale).astype(int), 0, bins - 1)
    edge = np.zeros(bins + 1)
    np.add.at(edge, a, 1)
    np.add.at(edge, b + 1, -1)
    return np.cumsum(edge)[:bins]


def gutters(x0: np.ndarray, x1: np.ndarray, low: float, high: float, most: int = 3) -> list[tuple[float, float]]:
    """Up to ``most`` empty strips that part a page into blocks, widest first: at most 6 per cent of the peak after
    smoothing, at least 2 per cent wide, ten words on either side."""
    profile = occupancy(x0, x1, low, high)
    n = len(profile)
    smooth = np.array([profile[max(0, i - 5) : i + 6].mean() for i in range(n)])
    empty = smooth <= 0.06 * smooth.max() if n and smooth.max() > 0 else np.zeros(n, bool)
    out, start = [], None
    for i in range(n + 1):
        if i < n and empty[i]:
            start = i if start is None else start
        elif start is not None:
            a, b = low + start * (high - low) / n, low + i * (high - low) / n
            if b - a >= 0.02 * (high - low) and (x1 <= a).sum() >= 10 and (x0 >= b).sum() >= 10:
                out.append((a, b))
            start = None
    return sorted(sorted(out, key=lambda g: g[0] - g[1])[:most])


def columns(right: np.ndarray, gap: float) -> list[tuple[float, int]]:
    """(right edge, members) of clusters of at least two amounts whose right edges lie within ``gap`` of each other."""
    out, group = [], []
    for x in sorted(right.tolist()):
        if group and x - group[-1] > gap:
            out.append(group)
            group = []
        group.append(x)
    out += [group] if group else []
    return [(float(np.median(g)), len(g)) for g in out if len(g) >= 2]


def value_of(text: str) -> float | None:
    """A printed amount; null if the word is none."""
    if not AMOUNT.match(text):
        return None
    v = float(re.sub(r"[^\d.]", "", text))
    return -v if text[0] in "(-" or text.endswith("-") else v


def read_page(words: pd.DataFrame, labels: Mapping[str, str]) -> list[tuple[str, float, int, int]]:
    """(field, value, label word, amount word) of one page. Words are put in bands; a gutter between blocks ends a line;
    each label's amounts lie right of it in its line and block; the column that at least three quarters of the labels
    have an amount in is preferred, leftmost first. A label without an amount there is not read."""
    w = words.sort_values("word_id").reset_index(drop=True)
    if w.empty:
        return []
    x0, x1 = w["x0"].to_numpy(float), w["x1"].to_numpy(float)
    band = bands(w["y0"].to_numpy(float), w["y1"].to_numpy(float))
    cuts = [sum(g) / 2 for g in gutters(x0, x1, float(x0.min()), float(x1.max()))]
    block = np.searchsorted(cuts, (x0 + x1) / 2)
    height = float(np.median(w["y1"] - w["y0"]))
    found: dict[str, list[tuple[int, int]]] = {}
    for b, k in sorted(set(zip(band.tolist(), block.tolist()))):
        line = sorted(np.flatnonzero((band == b) & (block == k)).tolist(), key=lambda i: x0[i])
        said, at = "", []
        for i in line:
            at.append((len(said), i))
            said += w["text"][i].lower() + " "
        for f, pattern in labels.items():
            m = None if f in found else re.search(pattern, said)
            if m:
                first = next(i for pos, i in reversed(at) if pos <= m.start())
                amounts = [i for pos, i in at if pos >= m.end() - 1 and value_of(w["text"][i]) is not None]
                if amounts:
                    found[f] = [(first, i) for i in amounts]
    edges = columns(np.array([x1[i] for own in found.values() for _, i in own]), 1.5 * height)
    votes = [(edge, sum(any(abs(x1[i] - edge) <= 1.5 * height for _, i in own) for own in found.values())) for edge, _ in edges]
    agreed = [e for e, n in votes if n >= max(2, 0.75 * len(found))]
    out = []
    for f, own in found.items():
        pick = min(own, key=lambda p: (abs(x1[p[1]] - agreed[0]) if agreed else 0, x0[p[1]]))
        if agreed and abs(x1[pick[1]] - agreed[0]) > 1.5 * height:
            continue
        out.append((f, value_of(w["text"][pick[1]]), int(w["word_id"][pick[0]]), int(w["word_id"][pick[1]])))
    return out


def page_fields(words: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """(doc, page, field, value, label_word, amount_word) of every page, each value with the words it was read from."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in read_page(df, labels)], columns=["doc", "page", "field", "value", "label_word", "amount_word"])

    return words.groupBy("doc", "page").applyInPandas(run, "doc long, page int, field string, value double, label_word int, amount_word int")


def page_bands(words: DataFrame) -> DataFrame:
    """(doc, page, word_id, band) of every word."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return df.assign(band=bands(df["y0"].to_numpy(float), df["y1"].to_numpy(float)))[["doc", "page", "word_id", "band"]]

    return words.select("doc", "page", "word_id", "y0", "y1").groupBy("doc", "page").applyInPandas(run, "doc long, page int, word_id int, band int")


def classify(texts: Sequence[str], amounts: int, header: set[str]) -> str:
    """What a line of a table is: header, subtotal, employee (a name and amounts), continuation (amounts alone), section
    (words alone) or unread."""
    words = [t.lower() for t in texts if value_of(t) is None]
    if header and len(header & set(words)) >= max(2, len(header) // 2):
        return "header"
    if any(t in ("total", "totals", "subtotal", "average") for t in words):
        return "subtotal"
    if amounts and words:
        return "employee"
    if amounts:
        return "continuation"
    return "section" if words else "unread"


def table_rows(words: DataFrame, header: Sequence[str]) -> DataFrame:
    """(doc, page, band, kind, owner, label, amounts) of every line of every page; continuations belong to the employee
    above them."""
    head = {h.lower() for h in header}

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        w = df.sort_values("word_id").reset_index(drop=True)
        band = bands(w["y0"].to_numpy(float), w["y1"].to_numpy(float))
        out, owner = [], 0
        for b in range(int(band.max()) + 1 if len(band) else 0):
            line = w[band == b].sort_values("x0")
            values = [v for v in map(value_of, line["text"]) if v is not None]
            kind = classify(line["text"].tolist(), len(values), head)
            owner += kind == "employee"
            out.append((*key, b, kind, owner if kind in ("employee", "continuation") else None, " ".join(t for t in line["text"] if value_of(t) is None), values))
        made = pd.DataFrame(out, columns=["doc", "page", "band", "kind", "owner", "label", "amounts"])
        return made.astype({"owner": "Int32"})

    return words.groupBy("doc", "page").applyInPandas(run, "doc long, page int, band int, kind string, owner int, label string, amounts array<double>")


def coherence(rows: DataFrame, gross: str, withheld: str, net: str, within: Sequence[str], tolerance: float = 0.02) -> DataFrame:
    """(within, n, ties, worst, accepted): rows whose gross less deductions is net; a page is accepted with two rows or
    more of which three fifths tie, two at least."""
    gap = F.abs(F.col(gross) - F.col(withheld) - F.col(net))
    out = rows.groupBy(*within).agg(F.count("*").alias("n"), F.count_if(gap <= tolerance).alias("ties"), F.max(F.round(gap.cast("decimal(28,6)"), 2).cast("double")).alias("worst"))
    return out.withColumn("accepted", (F.col("n") >= 2) & (F.col("ties") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.6))))
