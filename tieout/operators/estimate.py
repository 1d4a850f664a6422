"""What figures may be: weighted fits to identities, alternative readings, simulated intervals, triangular numbers."""

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.money import CONFUSED

#: The figures of a statement, and the identities that hold among them.
FIELDS = ("gross", "federal", "state", "social_security", "medicare", "retirement", "other_total", "total_deductions", "net_pay", "taxable_wages", "medicare_gross", "premium")
IDENTITIES = (
    {"gross": 1, "total_deductions": -1, "net_pay": -1},
    {"total_deductions": 1, "federal": -1, "state": -1, "social_security": -1, "medicare": -1, "retirement": -1, "other_total": -1},
    {"gross": 1, "retirement": -1, "premium": -1, "taxable_wages": -1},
    {"gross": 1, "premium": -1, "medicare_gross": -1},
)
#: Standard deviations of a reading and of an identity, where a calibration gives none.
READ_SD, IDENTITY_SD = 0.05, 0.02
#: The lines that together can't exceed gross less net, and what is material there; below, those of them that aren't fitted.
LINES, MATERIAL = ("federal", "state", "social_security", "medicare", "retirement", "retirement_insurance", "other_total", "premium", "fee"), 1.0
#: Fixed values of the calibration: how often a reading is wrong, by how many deviations, and dollars of one unit of doubt.
OUTLIER_RATE, OUTLIER_SCALE, TEMPERATURE = 0.0779, 5000.0, 5.0
UNFITTED = tuple(f for f in LINES if f not in FIELDS)


def fit_one(seen: Mapping[str, float], sd: Mapping[str, float] | None = None, huber: float = 2.5, rounds: int = 4) -> tuple[dict[str, float], dict[str, float], list[float]]:
    """Values and standard deviations of the figures that fit a statement's readings and identities best, and what each
    identity with two or more readings misses by. Least squares, reweighted so that a reading far off loses its pull.
    Figures that neither a reading nor an identity touches are left out; under three readings nothing is fitted."""
    if len(seen) < 3:
        return {}, {}, []
    used = [i for i in IDENTITIES if sum(f in seen for f in i) >= 2]
    names = [f for f in FIELDS if f in seen or any(f in i for i in used)]
    a = np.zeros((len(seen) + len(used), len(names)))
    b = np.zeros(len(a))
    base = np.zeros(len(a))
    for r, (f, y) in enumerate(seen.items()):
        a[r, names.index(f)], b[r], base[r] = 1.0, y, 1 / max((sd or {}).get(f, READ_SD), 1e-6) ** 2
    for r, identity in enumerate(used, len(seen)):
        for f, c in identity.items():
            a[r, names.index(f)] = c
        base[r] = 1 / IDENTITY_SD**2
    weight = base
    for _ in range(rounds):
        root = np.sqrt(weight)
        x = np.linalg.lstsq(a * root[:, None], b * root, rcond=None)[0]
        far = np.abs((a @ x - b) * np.sqrt(base))
        weight = base * np.minimum(1.0, huber / np.maximum(far, 1e-12))
    spread = np.sqrt(np.clip(np.diag(np.linalg.pinv((a * base[:, None]).T @ a)), 0, None))
    gaps = [float(sum(c * seen[f] for f, c in i.items())) for i in used if all(f in seen for f in i)]
    return dict(zip(names, np.round(x, 2).tolist())), dict(zip(names, np.round(spread, 4).tolist())), [round(g, 2) for g in gaps]


FIT = "fitted map<string,double>, sd map<string,double>, gaps array<double>, suspect string"


def fit_many(seen: np.ndarray, sd: Mapping[str, float] | None = None, huber: float = 2.5, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fit_one`` for many statements at once, a row each with the columns FIELDS and NaN for what wasn't read: fitted
    values, their standard deviations, and what each identity of the fitted values misses by, NaN where there are none.
    Statements with the same figures share a system, solved for the identities' multipliers, at most as many as there are
    identities; a statement whose weights have settled isn't solved again."""
    fitted, spread, misses = np.full(seen.shape, np.nan), np.full(seen.shape, np.nan), np.full((len(seen), len(IDENTITIES)), np.nan)
    have = ~np.isnan(seen)
    codes = have @ (1 << np.arange(len(FIELDS)))
    for code in np.unique(codes):
        rows = np.flatnonzero(codes == code)
        read = np.flatnonzero(have[rows[0]])
        if len(read) < 3:
            continue
        used = [k for k, i in enumerate(IDENTITIES) if sum(FIELDS.index(f) in read for f in i) >= 2]
        law = np.array([[IDENTITIES[k].get(f, 0.0) for f in FIELDS] for k in used]).reshape(-1, len(FIELDS))
        unread = np.flatnonzero(law.any(axis=0) & ~have[rows[0]])
        a, u = law[:, read], law[:, unread]
        base = np.r_[[1 / max((sd or {}).get(FIELDS[c], READ_SD), 1e-6) ** 2 for c in read], [1 / IDENTITY_SD**2] * len(used)]
        y = seen[np.ix_(rows, read)]
        # Figures that weren't read take up what they can: what they leave of the identities is tied to the readings.
        left, values, _ = np.linalg.svd(u) if u.size else (np.eye(len(used)), np.zeros(0), None)
        free = left[:, int((values > 1e-9).sum()) :]
        g = np.hstack([free.T @ a, free.T])  # of the readings' and the identities' deviations
        squares = (g.T[:, :, None] * g.T[:, None, :]).reshape(g.shape[1], -1)
        gap = y @ g[:, : len(read)].T
        weight, moved, live = np.tile(base, (len(rows), 1)), np.zeros((len(rows), len(base))), np.arange(len(rows))
        for _ in range(rounds if g.size else 0):
            w = weight[live]
            pull = np.linalg.solve(((1 / w) @ squares).reshape(-1, len(g), len(g)), gap[live][:, :, None])[:, :, 0]
            moved[live] = (pull @ g) / w
            weight[live] = base * np.minimum(1.0, huber / np.maximum(np.abs(moved[live] * np.sqrt(base)), 1e-12))
            live = live[(weight[live] != w).any(axis=1)]
        x, miss = y - moved[:, : len(read)], moved[:, len(read) :]
        fitted[np.ix_(rows, read)], misses[np.ix_(rows, used)] = x, miss
        if u.size:
            fitted[np.ix_(rows, unread)] = (miss - x @ a.T) @ np.linalg.pinv(u).T
        every = np.vstack([np.eye(len(FIELDS))[read], law])
        cols = np.r_[read, unread]
        spread[np.ix_(rows, cols)] = np.sqrt(np.clip(np.diag(np.linalg.pinv((every[:, cols] * base[:, None]).T @ every[:, cols])), 0, None))
    return fitted, spread, misses


def fits(rows: DataFrame, key: str, sd: Mapping[str, float] | None = None) -> DataFrame:
    """(key, fitted, sd, gaps, suspect) of statements: ``suspect`` is the reading farthest from its fit, if it is more
    than three deviations off. In batches; no shuffle."""
    signs = np.array([[i.get(f, 0.0) for f in FIELDS] for i in IDENTITIES])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            seen = df[list(FIELDS)].to_numpy(dtype=float, na_value=np.nan)
            fitted, spread, misses = fit_many(seen, sd)
            gaps = np.where(np.isnan(misses), np.nan, np.stack([seen[:, s != 0] @ s[s != 0] for s in signs], axis=1)).round(2)
            for k, y, x, v, gap in zip(df[key], seen, fitted.round(2).tolist(), spread.round(4).tolist(), gaps.tolist()):
                fit = {f: c for f, c in zip(FIELDS, x) if c == c}
                off = {f: abs(c - fit[f]) / (sd or {}).get(f, READ_SD) for f, c in zip(FIELDS, y.tolist()) if c == c and f in fit}
                worst = max(off, key=lambda f: (off[f], f), default=None)
                out.append((k, fit, {f: c for f, c in zip(FIELDS, v) if c == c}, [c for c in gap if c == c], worst if worst and off[worst] > 3 else None))
            yield pd.DataFrame(out, columns=[key, "fitted", "sd", "gaps", "suspect"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, *(F.col(f).cast("double").alias(f) for f in FIELDS)).mapInPandas(run, f"{key} {kind}, {FIT}")


def wrong_shares(seen: np.ndarray, field: str, identity: int) -> np.ndarray:
    """The chance that the reading of ``field`` is wrong, by the fit of its statement: its share of the blame among the
    figures of an identity that doesn't tie, by how near their misreadings come to what is missing, halved for readings
    near their fit. Nought where the identity ties, the usual rate where nothing could be fitted."""
    at = FIELDS.index(field)
    fitted, _, misses = fit_many(seen)
    out = np.where(np.isnan(fitted).all(axis=1), OUTLIER_RATE, 0.0)
    for r in np.flatnonzero(np.nan_to_num(np.abs(misses[:, identity].round(2))) > MATERIAL):
        need, share = abs(round(misses[r, identity], 2)), {}
        for f in IDENTITIES[identity]:
            if not np.isnan(v := float(seen[r, FIELDS.index(f)])):
                share[f] = math.exp(-min((abs(abs(x - v) - need) for x, _ in alternatives(v, 40)), default=need) / TEMPERATURE)
        if field in share:
            off = abs(fitted[r, at] - seen[r, at]) / READ_SD
            good, bad = (1 - OUTLIER_RATE) * math.exp(-0.5 * min(off**2, 1e4)), OUTLIER_RATE / OUTLIER_SCALE * math.exp(-0.5 * min((off / OUTLIER_SCALE) ** 2, 1e4))
            out[r] = round(min(1.0, share[field] / (sum(share.values()) or 1.0) * (0.5 + 0.5 * bad / max(good + bad, 1e-300))), 4)
    return out


def doubted(rows: DataFrame, keep: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """``keep``, and as ``<prefix>bad`` the chance that the net pay of the statement with this prefix is misread."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df[list(keep)].assign(**{f"{x}bad": wrong_shares(df[[f"_{x}{f}" for f in FIELDS]].to_numpy(dtype=float, na_value=np.nan), "net_pay", 0) for x in prefixes})

    kinds = dict(rows.dtypes)
    some = rows.select(*keep, *(F.col(f"{x}{f}").cast("double").alias(f"_{x}{f}") for x in prefixes for f in FIELDS))
    return some.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), *(f"{x}bad double" for x in prefixes)]))


def draw(draws: int, seed: int, mixed: Sequence[bool]) -> list[tuple[np.ndarray, ...]]:
    """For each figure in turn the deviations of its readings, and if it may be misread, the numbers that say as what
    and whether."""
    rng = np.random.default_rng(seed)
    return [(rng.standard_normal(draws), *((rng.random(draws), rng.random(draws)) if m else ())) for m in mixed]


def drawn(value: float, bad: float, sd: float, noise: np.ndarray, *mixture: np.ndarray) -> np.ndarray:
    """Draws of a figure: near what was read, or with chance ``bad`` one of its misreadings by their weights."""
    near = value + sd * noise
    if not mixture:
        return near
    other, weight = np.array(alternatives(value, 40)).T
    share = np.cumsum(weight / weight.sum())
    return np.where(mixture[1] < bad, other[np.searchsorted(share / share[-1], mixture[0], side="right")], near)


def intervals(rows: DataFrame, key: Sequence[str], before: str, after: str, promised: str, sd: float = 1.0, draws: int = 4000, seed: int = 12345, extra: str | None = None, periods: str | None = None, before_bad: str | None = None, after_bad: str | None = None) -> DataFrame:
    """(key, low, high, material) by simulation: 2.5 and 97.5 per cent points of the gap between the change per month and
    the promise, and the chance that it is over 25 either way. Both readings vary by ``sd``, and with the chances
    ``before_bad`` and ``after_bad`` are misread; ``extra`` is added to the change of one of ``periods`` pays a year.
    One seed for every row, so that results don't depend on how rows are spread. Rows with a missing figure are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = {(x, y): draw(draws, seed, (x, y)) for x in (False, True) for y in (False, True)}
        plain = np.sort(numbers[False, False][1][0] - numbers[False, False][0][0]) * sd
        for df in batches:
            got = []
            for b, a, p, more, month, b_bad, a_bad in df[["_b", "_a", "_p", "_x", "_m", "_bb", "_ab"]].itertuples(index=False):
                if b_bad <= 0 and a_bad <= 0:
                    gap = (plain + (a - b + more)) * month - p
                else:
                    of_b, of_a = numbers[b_bad > 0, a_bad > 0]
                    gap = (drawn(a, a_bad, sd, *of_a) - drawn(b, b_bad, sd, *of_b) + more) * month - p
                low, high = np.percentile(gap, [2.5, 97.5])
                got.append((round(float(low), 4), round(float(high), 4), float(np.mean(np.abs(gap) > 25.0))))
            yield df[list(key)].assign(low=[g[0] for g in got], high=[g[1] for g in got], material=[g[2] for g in got])

    number = lambda c, none: F.coalesce(F.col(c).cast("double"), F.lit(none)) if c else F.lit(none)
    figures = {c: F.col(x).cast("double") for c, x in (("_b", before), ("_a", after), ("_p", promised))} | {"_x": number(extra, 0.0), "_m": number(periods, 12.0) / 12.0, "_bb": number(before_bad, 0.0), "_ab": number(after_bad, 0.0)}
    some = rows.select(*key, *(x.alias(c) for c, x in figures.items())).dropna(subset=["_b", "_a", "_p"])
    kinds = dict(rows.dtypes)
    return some.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", low double, high double, material double")


def alternatives(value: float, limit: int = 400) -> list[tuple[float, float]]:
    """``money.misreadings`` of one value, for use within batches."""
    s = f"{value:.2f}"
    out = [(float(s[:i] + c + s[i + 1 :]), 1 / len(CONFUSED[d])) for i, d in enumerate(s) if d in CONFUSED for c in CONFUSED[d]]
    out += [(float(d + s), 0.02) for d in "123456789" if s[0] != "-"] + [(round(value * 100, 2), 0.01)]
    return sorted(((v, w) for v, w in out if abs(v - value) > 0.001), key=lambda x: (-x[1], x[0]))[:limit]


def misfits(seen: np.ndarray, unfitted: np.ndarray, sd: Mapping[str, float] | None = None) -> np.ndarray:
    """Dollars by which statements don't tie after their fit: over all identities, by which the lines read exceed gross
    less net, and by which they fall short of the printed total where one of them was read as nothing."""
    parts = [fit_many(seen[i : i + 65536], sd)[2] for i in range(0, len(seen), 65536)]
    out = np.nansum(np.abs(np.vstack([np.empty((0, len(IDENTITIES))), *parts]).round(2)), axis=1)
    lines = np.hstack([seen[:, [FIELDS.index(f) for f in LINES if f in FIELDS]], unfitted])
    gross, net, total = (seen[:, FIELDS.index(f)] for f in ("gross", "net_pay", "total_deductions"))
    excess, short = np.nansum(lines, axis=1) - (gross - net), total - np.nansum(lines, axis=1)
    out += np.where(excess > MATERIAL, excess.round(2), 0.0)
    return out + np.where((short > MATERIAL) & (np.abs(lines) < 0.005).any(axis=1), short.round(2), 0.0)


def readings(rows: DataFrame, key: str, expected: Mapping[str, tuple[str, float]], temperature: float = TEMPERATURE, margin: float = 2.0, decisive: float = 0.9) -> DataFrame:
    """(key, field, value, p, decisive): what figures in doubt were printed as, likeliest of the value read, with prior 1,
    and its misreadings. Each is weighed by how badly the statement ties with it, solved anew, and by what another
    document expects. In doubt are the reading farthest from its fit and those over three deviations from what is
    expected. ``expected``: field to the column that has it and its deviation."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            seen, unfitted = (df[list(c)].to_numpy(dtype=float, na_value=np.nan) for c in (FIELDS, UNFITTED))
            fitted = fit_many(seen)[0]
            off = np.nan_to_num(np.abs(seen - fitted.round(2)) / READ_SD, nan=-1.0)
            doubt = (off == off.max(axis=1, keepdims=True)) & (off > 3)
            want, sds = np.full(seen.shape, np.nan), np.ones(len(FIELDS))
            for f, (_, dev) in expected.items():
                want[:, FIELDS.index(f)], sds[FIELDS.index(f)] = df[f"_{f}"].to_numpy(dtype=float, na_value=np.nan), max(dev, 0.01)
            doubt |= np.nan_to_num(np.abs(seen - want)) > 3 * sds
            r, c = np.nonzero(doubt)
            each = [[(v, 1.0), *alternatives(v)] for v in seen[r, c].tolist()]
            sizes = np.array([len(x) for x in each], dtype=int)
            start, at = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(r)), sizes)
            value, prior = np.array([x for e in each for x in e], dtype=float).reshape(-1, 2).T
            trial = seen[r[at]]
            trial[np.arange(len(at)), c[at]] = value
            score = np.log(prior) - misfits(trial, unfitted[r[at]]) / temperature - np.nan_to_num(0.5 * ((value - want[r[at], c[at]]) / sds[c[at]]) ** 2)
            if not len(r):
                continue
            chance = np.exp(score - np.maximum.reduceat(score, start)[at])
            chance /= np.add.reduceat(chance, start)[at]
            top = np.flatnonzero(chance == np.maximum.reduceat(chance, start)[at])
            top = top[np.unique(at[top], return_index=True)[1]]
            p, rest = chance[top], chance.copy()
            rest[top] = 0.0
            sure = (p >= decisive) & (p > margin * np.maximum.reduceat(rest, start))
            yield pd.DataFrame({key: df[key].to_numpy()[r], "field": np.array(FIELDS, dtype=object)[c], "value": value[top].round(2), "p": p.round(6), "decisive": sure})

    figures = [F.col(f).cast("double").alias(f) for f in (*FIELDS, *UNFITTED)]
    some = rows.select(key, *figures, *(F.col(c).cast("double").alias(f"_{f}") for f, (c, _) in expected.items()))
    return some.mapInPandas(run, f"{key} {kind}, field string, value double, p double, decisive boolean")


def likely_reading(candidates: DataFrame, key: Sequence[str], value: str, weight: str, expected: str, sd: float, margin: float = 2.0, decisive: float = 0.9) -> DataFrame:
    """(key, value, p, decisive): of the candidates of a figure the likeliest, by weight and by how near it lies to what
    is expected; decisive at ``decisive`` or more if over ``margin`` times the next. Without weight nobody is likely."""
    z = (F.col(value) - F.col(expected)) / F.lit(sd)
    scored = candidates.withColumn("_s", F.col(weight) * F.exp(F.greatest(-0.5 * z * z, F.lit(-700.0))))
    total = scored.groupBy(*key).agg(F.sum("_s").alias("_t"), F.max(F.struct("_s", value)).alias("_best"))
    rest = scored.join(total, list(key)).where((F.col("_s") != F.col("_best._s")) | (F.col(value) != F.col(f"_best.{value}"))).groupBy(*key).agg(F.max("_s").alias("_next"))
    p = F.try_divide(F.col("_best._s"), F.col("_t"))
    sure = (p >= decisive) & (F.col("_best._s") > margin * F.coalesce("_next", F.lit(0.0)))
    return total.join(rest, list(key), "left").select(*key, F.col(f"_best.{value}").alias(value), F.round(p, 6).alias("p"), F.coalesce(sure, F.lit(False)).alias("decisive"))


def triangle(low: Column, mid: Column, high: Column) -> Column:
    """A triangular number."""
    return F.struct(low.alias("low"), mid.alias("mid"), high.alias("high"))


def add(a: Column, b: Column) -> Column:
    """The sum of triangular numbers."""
    return triangle(a["low"] + b["low"], a["mid"] + b["mid"], a["high"] + b["high"])


def subtract(a: Column, b: Column) -> Column:
    """The difference of triangular numbers."""
    return triangle(a["low"] - b["high"], a["mid"] - b["mid"], a["high"] - b["low"])


def scale(a: Column, k: float) -> Column:
    """A triangular number times a constant."""
    return triangle(a["low"] * k, a["mid"] * k, a["high"] * k) if k >= 0 else triangle(a["high"] * k, a["mid"] * k, a["low"] * k)


def membership(a: Column, v: Column) -> Column:
    """How far ``v`` belongs to a triangular number, 0 to 1."""
    up, down = F.try_divide(v - a["low"], a["mid"] - a["low"]), F.try_divide(a["high"] - v, a["high"] - a["mid"])
    return F.when(v == a["mid"], 1.0).when((v <= a["low"]) | (v >= a["high"]), 0.0).when(v < a["mid"], up).otherwise(down)


def support_below(a: Column, threshold: float, steps: int = 100) -> Column:
    """The greatest degree at which a triangular number reaches under ``threshold``, in hundredths."""
    degree = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / F.lit(float(steps)))
    return F.coalesce(F.array_max(F.filter(degree, lambda g: a["low"] + g * (a["mid"] - a["low"]) < threshold)), F.lit(0.0))


def observation_sd(field: Column, calibrated: Mapping[str, float], derived: Column, by_place: Column, default: float = READ_SD) -> Column:
    """The deviation to give a reading: that of its field in a calibration, twice it for a figure derived from others, at
    most the default for one read by its place on the page. Null flags are no."""
    known = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in calibrated.items() for x in (F.lit(k), F.lit(v)))), field), F.lit(default)) if calibrated else F.lit(default)
    twice = F.when(F.coalesce(derived, F.lit(False)), known * 2).otherwise(known)
    return F.when(F.coalesce(by_place, F.lit(False)), F.least(twice, F.lit(default))).otherwise(twice)


def log_likelihood(value: Column, expected: Column, sd: Column) -> Column:
    """Of a reading under a normal expectation, but for a constant."""
    return -0.5 * F.pow((value - expected) / sd, F.lit(2.0))


def near_miss(value: float) -> float:
    """One figure turned by a misread digit, for tests of the tests."""
    return value + 10 ** math.floor(math.log10(abs(value))) if value else 1.0


def corrupted(rows: DataFrame, value: str) -> DataFrame:
    """Every row four times, with a figure lost, tenfold, with its first digit raised, and with its sign turned: to see
    which systems of evidence notice."""
    v = F.col(value)
    kinds = F.array(
        F.struct(F.lit("lost").alias("kind"), F.lit(None).cast("double").alias("bad")),
        F.struct(F.lit("tenfold").alias("kind"), (v * 10).alias("bad")),
        F.struct(F.lit("digit").alias("kind"), (v + F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs(v), F.lit(0.01)))))).alias("bad")),
        F.struct(F.lit("sign").alias("kind"), (-v).alias("bad")),
    )
    return rows.select("*", F.explode(kinds).alias("_k")).select(*rows.columns, "_k.kind", "_k.bad")
