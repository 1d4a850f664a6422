"""Names of a roster taken for names that were misread, each once."""

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions.text import _MARKED, _PLAIN

_TABLE = str.maketrans(_MARKED, _PLAIN)
_FOLD = str.maketrans("1it0d586q", "llloosbgg")
#: Most names of either side of a register that meet in one task; a larger register is cut into squares of such sides.
SIDE = 2000
#: Pairs that the bound is worked out for at once.
CELLS = 150_000


def clean(name: str) -> str:
    """Letters and blanks in lower case."""
    return " ".join("".join(c if c.isalpha() or c.isdigit() else " " for c in (name or "").translate(_TABLE).lower()).split())


def _fold(s: str) -> str:
    return s.replace("rn", "m").translate(_FOLD)


@lru_cache(maxsize=200_000)
def likeness(a: str, b: str) -> float:
    """Of two texts, plain or with confused letters made one, the greater."""
    c, d = _fold(a), _fold(b)
    plain = SequenceMatcher(None, a, b).ratio()
    return plain if (a, b) == (c, d) else max(plain, SequenceMatcher(None, c, d).ratio())


def _score(a: str, b: str) -> float:
    """``name_score`` of clean names, neither empty."""
    (fa, la), (fb, lb) = ((s.split()[0], s.split()[-1]) for s in (a, b))
    last = likeness(la, lb)
    return max(likeness(a, b), 0.6 * last + 0.4 * likeness(fa, fb), last if last > 0.85 else 0.0)


def name_score(raw: str, candidate: str) -> float:
    """How well a roster name fits a read one: as a whole, by last and first part, or by a last part that is nearly it."""
    a, b = clean(raw), clean(candidate)
    return _score(a, b) if a and b else 0.0


def _ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """Twice the longest common subsequence by the sum of both lengths, for each x and y: matching blocks are such a
    subsequence, so no ratio of ``SequenceMatcher`` is greater. Texts over 64 letters count as wholly common."""
    code: dict[str, int] = {}
    steps = np.zeros((min(64, max(map(len, xs))), len(xs)), np.int64)
    for i, x in enumerate(xs):
        for k, c in enumerate(x[:64]):
            steps[k, i] = code.setdefault(c, len(code) + 1)
    places = np.zeros((len(code) + 1, len(ys)), np.uint64)
    for j, y in enumerate(ys):
        for k, c in enumerate(y[:64]):
            if c in code:
                places[code[c], j] |= np.uint64(1 << k)
    # A bit a letter of y, for all pairs at once; the zeros count the letters in common.
    free = np.full((len(xs), len(ys)), np.uint64(2**64 - 1))
    for step in steps:
        hit = free & places[step]
        free = (free + hit) | (free - hit)
    nx, ny = (np.array([len(t) for t in ts])[at] for ts, at in ((xs, np.s_[:, None]), (ys, np.s_[None, :])))
    common = np.where((nx > 64) | (ny > 64), np.minimum(nx, ny), np.bitwise_count(~free))
    return 2 * common / (nx + ny)


def _most_alike(xs: list[str], ys: list[str]) -> np.ndarray:
    """An upper bound of ``likeness`` for each x and y. With letters made one at least as many are in common; "rn" alone
    shortens a text when it is folded, so only texts with it are bounded once more."""
    (ux, ix), (uy, iy) = (np.unique(np.array(t, object), return_inverse=True) for t in (xs, ys))
    ux, uy = ux.tolist(), uy.tolist()
    out = _ratios([x.translate(_FOLD) for x in ux], [y.translate(_FOLD) for y in uy])
    fx, fy = [_fold(x) for x in ux], [_fold(y) for y in uy]
    if rows := [i for i, x in enumerate(ux) if "rn" in x]:
        out[rows] = np.maximum(out[rows], _ratios([fx[i] for i in rows], fy))
    if cols := [j for j, y in enumerate(uy) if "rn" in y]:
        out[:, cols] = np.maximum(out[:, cols], _ratios(fx, [fy[j] for j in cols]))
    return out[ix][:, iy]


def fits(read: list[str], roster: list[str], least: float) -> list[tuple[int, int, float]]:
    """(place in read, place in roster, ``name_score``) of all pairs of clean names, none empty, that score ``least`` or
    more. All pairs are bounded; those that can reach it are scored."""
    ends = lambda names, k: [n.split()[k] for n in names]
    step = max(1, CELLS // max(1, len(roster)))
    out = []
    for at in range(0, len(read) if roster else 0, step):
        part = read[at : at + step]
        last = _most_alike(ends(part, -1), ends(roster, -1))
        most = np.maximum(0.6 * last + 0.4 * _most_alike(ends(part, 0), ends(roster, 0)), np.where(last > 0.85 - 1e-9, last, 0))
        most = np.maximum(most, _most_alike(part, roster))
        for i, k in np.argwhere(most >= least - 1e-9).tolist():
            if (score := _score(part[i], roster[k])) >= least:
                out.append((at + i, k, score))
    return out


def adopt(fits: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """(ordinal, roster ordinal, score): in the order of ordinals each takes the best fitting name that is left, first of
    equals. Order decides: an earlier block takes a name from a later one that fits it better."""
    taken: set[int] = set()
    out = []
    by: dict[int, list[tuple[float, int]]] = {}
    for i, k, s in fits:
        by.setdefault(i, []).append((-s, k))
    for i in sorted(by):
        best = min((x for x in by[i] if x[1] not in taken), default=None)
        if best:
            taken.add(best[1])
            out.append((i, best[1], -best[0]))
    return out


def adopted(read: DataFrame, roster: DataFrame, within: str, least: float = 0.7) -> DataFrame:
    """(within, ord, roster_ord, score) of the names of ``read`` (within, ord, name) that take one of ``roster`` (within,
    ord, name). All names of a register are compared, in squares of ``SIDE`` wherever they lie; the rule that goes through
    a register in order sees the fits at ``least`` alone. Empty and null names take nothing; equal names of a roster are
    taken one by one."""
    sides = [df.where(F.trim("name") != "").select(within, "ord", "name") for df in (read, roster)]
    counts = [df.groupBy(within).agg(F.ceil(F.count("*") / SIDE).cast("int").alias(f"_n{k}")) for k, df in enumerate(sides)]
    cuts = counts[0].join(counts[1], within)
    square = []
    for k, df in enumerate(sides):
        own = F.pmod(F.xxhash64("ord"), F.col(f"_n{k}")).cast("int").alias(f"_k{k}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"_n{1 - k}") - 1)).alias(f"_k{1 - k}")
        square.append(df.join(cuts, within).select(within, "ord", "name", own, every).groupBy(within, "_k0", "_k1"))

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # Equal names are compared once.
        by: list[dict[str, list[int]]] = [{}, {}]
        for names, df in zip(by, (a, b)):
            for o, n in zip(df["ord"].tolist(), df["name"].map(clean)):
                if n:
                    names.setdefault(n, []).append(o)
        x, y = (sorted(names, key=lambda n: (len(n), n)) for names in by)
        got = [(key[0], i, k, score) for p, q, score in fits(x, y, least) for i in by[0][x[p]] for k in by[1][y[q]]]
        return pd.DataFrame(got, columns=[within, "_o1", "_o2", "_f"])

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        got = adopt(list(zip(df["_o1"], df["_o2"], df["_f"])))
        return pd.DataFrame([(key[0], *g) for g in got], columns=[within, "ord", "roster_ord", "score"])

    found = square[0].cogroup(square[1]).applyInPandas(meet, f"{within} long, _o1 long, _o2 long, _f double")
    return found.groupBy(within).applyInPandas(run, f"{within} long, ord long, roster_ord long, score double")
