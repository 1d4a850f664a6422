"""One surviving record per group of duplicates: values chosen field by field by iterative truth discovery."""

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import names
from tieout.plans.lineage import cut

VOTE = "group_id long, field string, value string, source string, weight double, last string, alone boolean"


def _written(v: str) -> float:
    """How well a name is written, whatever it is: 1 for mixed case without foreign marks, near 0 for unreadable."""
    s = v.strip()
    if not s:
        return 0.0
    bad = any(c.isdigit() or c in "?�" for c in s) or names.repaired(s) != s
    out = 0.02 if bad else 1.0
    letters = [c for c in s if c.isalpha()]
    if not letters:
        return 0.001
    if all(c.isupper() for c in letters) and len(letters) > 1 or not any(c.isupper() for c in letters):
        out *= 0.05
    if s != v:
        out *= 0.3
    if len(letters) == 1:
        out *= 0.05
    if "," in s:
        out *= 0.05
    return out


def name_votes(claims: list[tuple]) -> Iterator[tuple[str, str, float, str]]:
    """Votes (value, source, weight, last) of one group and field of names, from its claims (value, source, n, last,
    freq). Claims fall into versions of the name: those alike, cut short, short forms, misspelt. The version claimed
    last holds; within it every claim votes for each value that it may be a damaged form of, and each value's weight
    carries how well it is written, how full it is and how many other groups know it."""
    good = [c for c in claims if c[0] is not None and _written(c[0]) > 0]
    if not good:
        return
    parts = {c[0]: names.tokens(c[0]) for c in good}
    values = list(parts)
    home = {v: v for v in values}

    def root(v: str) -> str:
        while home[v] != v:
            v = home[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if parts[a] and parts[b] and (names.name_likeness(parts[a], parts[b]) >= 0.84 or _initial(parts[a], parts[b]) or names.token_likeness("".join(parts[a]), "".join(parts[b])) >= 0.9):
                home[root(a)] = root(b)
    held = root(max(good, key=lambda c: (c[3] or "", c[0]))[0])
    mine = [v for v in values if root(v) == held]
    freq = {}
    for v, _, _, _, f in good:
        freq[v] = max(freq.get(v, 0), f or 0)
    longest = max(sum(map(len, parts[v])) for v in mine)
    worth = {}
    for v in mine:
        folded = "".join(parts[v])
        short = any(u != v and _shorter(parts[v], parts[u]) for u in mine)
        accent = any(u != v and parts[u] == parts[v] and not u.isascii() and v.isascii() and _written(u) >= 0.5 for u in mine)
        initials = sum(len(t) == 1 for t in parts[v])
        worth[v] = _written(v) * (0.03 if short else 1.0) * (0.6 if accent else 1.0) * (0.5**initials) * (1 + freq[v]) ** 0.7 * (len(folded) / longest) ** 0.5
    for v, source, n, last, _ in good:
        if v not in worth:
            continue
        for u in mine:
            near = 1.0 if u == v else 0.9 if parts[u] == parts[v] else 0.6
            yield u, source, near * n**0.5 * worth[u], last


def _initial(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    return len(a) == 1 and len(b) == 1 and min(len(a[0]), len(b[0])) == 1 and names.token_likeness(a[0], b[0]) > 0.5


def _shorter(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether ``a`` is a short, cut or initial form of ``b``."""
    if len(a) > len(b):
        return False
    if len(a) < len(b):
        return all(any(x == y or _shorter((x,), (y,)) for y in b) for x in a) and not any(len(y) == 1 for y in b)
    cut_ = [x != y and len(x) < len(y) and y.startswith(x) for x, y in zip(a, b)]
    nick = [x != y and y in names.NICKNAMES and y in names.full_forms(x) for x, y in zip(a, b)]
    return any(c or k for c, k in zip(cut_, nick)) and all(x == y or c or k for x, y, c, k in zip(a, b, cut_, nick))


def _name_votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        out = []
        for g, field, claims in zip(df["group_id"], df["field"], df["claims"]):
            rows = sorted(((c["value"], c["source"], c["n"], c["last"], c["freq"]) for c in claims), key=lambda c: (c[0], c[1] or ""))
            votes = list(name_votes(rows))
            alone = len({v for v, _, _, _ in votes}) < 2
            out += [(g, field, v, s, w, last, alone) for v, s, w, last in votes]
        yield pd.DataFrame(out, columns=["group_id", "field", "value", "source", "weight", "last", "alone"])


def _claims(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(group_id, field, value, source, n, last): each source's values of a group and field that are no blanks."""
    melted = rows.select("group_id", "source", "last", "n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("c")).where(F.col("c.value").rlike(r"\S"))
    return melted.groupBy("group_id", F.col("c.field").alias("field"), F.col("c.value").alias("value"), "source").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _plain_votes(claims: DataFrame) -> DataFrame:
    """Votes of any other field: each claim for its own value, half as much for each newer load of the group and field."""
    sets = claims.groupBy("group_id", "field").agg(F.collect_list(F.struct("value", "source", "n", "last")).alias("claims"), F.sort_array(F.collect_set(F.coalesce("last", F.lit(""))), asc=False).alias("loads"))
    vote = lambda c: F.struct(c["value"].alias("value"), c["source"].alias("source"), (F.sqrt(c["n"]) * F.pow(F.lit(0.5), F.array_position(F.col("loads"), F.coalesce(c["last"], F.lit(""))) - 1)).alias("weight"), c["last"].alias("last"))
    alone = F.size(F.array_distinct("claims.value")) < 2
    return sets.select("group_id", "field", F.explode(F.transform("claims", vote)).alias("v"), alone.alias("alone")).select("group_id", "field", "v.*", "alone")


def survivors(rows: DataFrame, fields: Mapping[str, str], *, group: str, source: str, last: str, rounds: int = 50, settled: float = 0.005) -> DataFrame:
    """One row per group: ``group_id`` and each of ``fields`` (column -> ``name`` or ``plain``), chosen from the values
    of its rows, exactly as one of them has it.

    Truth discovery: a value's support is the weight of its votes times -ln(1 - trust) of their sources; a source's trust
    is the mean share that its values have of the support in their group, smoothed to 0.8; both in turn until no trust moves by
    more than ``settled``; not to settle in ``rounds`` is an error, and with ``rounds`` = 0 all sources are trusted alike.
    ``source`` names a row's source within all data, ``last`` is text that orders rows by time. Equal support goes to the
    later, then the greater value. Nulls and blanks claim nothing; a group whose field has no readable value gets null.
    Groups of one row pass through.

    Equal rows are combined before they meet, so that copies never gather in one task. A group and field with one value
    alone is settled at once and counts towards its sources' trust as a sum; only disputed ones take part in the rounds."""
    values = [F.col(f).cast("string").alias(f) for f in fields]
    told = rows.select(F.col(group).alias("group_id"), F.col(source).cast("string").alias("source"), F.col(last).cast("string").alias("last"), *values)
    whole = cut(told.groupBy("group_id", "source", *fields).agg(F.count("*").alias("n"), F.max("last").alias("last")))
    named, plain = ([f for f, kind in fields.items() if (kind == "name") is k] for k in (True, False))
    parts = []
    if named:
        claims = _claims(whole, named).withColumn("plain", F.regexp_replace(F.lower("value"), r"^\s+|\s+$", ""))
        known = claims.groupBy("field", "plain").agg(F.count_distinct("group_id").alias("freq")).where("freq > 1")
        claimed = claims.join(known, ["field", "plain"], "left").select("group_id", "field", F.struct("value", "source", "n", "last", F.coalesce("freq", F.lit(1)).alias("freq")).alias("c"))
        parts.append(claimed.groupBy("group_id", "field").agg(F.collect_list("c").alias("claims")).mapInPandas(_name_votes, VOTE))
    if plain:
        parts.append(_plain_votes(_claims(whole.select("group_id", "source", "last", "n", *plain).repartition("group_id"), plain)))
    votes = cut(reduce(DataFrame.unionByName, parts))
    disputed = cut(votes.where("not alone"))
    settled_ = votes.where("alone")
    base = cut(settled_.groupBy("source").agg(F.sum("weight").alias("base")))
    claims = disputed.groupBy("group_id", "field", "value", "source").agg(F.max("weight").alias("w"))
    trust = cut(votes.select("source").distinct().withColumn("trust", F.lit(0.8)))
    moved = 0.0
    for k in range(rounds):
        support = _support(disputed, trust)
        whole_ = support.groupBy("group_id", "field").agg(F.sum("s").alias("t"))
        likely = support.join(whole_, ["group_id", "field"]).select("group_id", "field", "value", F.coalesce(F.try_divide("s", "t"), F.lit(0.0)).alias("p"))
        seen = claims.join(likely, ["group_id", "field", "value"]).groupBy("source").agg(F.sum(F.col("w") * F.col("p")).alias("right"), F.sum("w").alias("all"))
        own = trust.join(seen, "source", "left").join(base, "source", "left").na.fill(0.0, ["right", "all", "base"])
        now = cut(own.select("source", F.col("trust").alias("old"), ((F.col("right") + F.col("base") + 4.0) / (F.col("all") + F.col("base") + 5.0)).alias("trust")))
        moved = now.agg(F.max(F.abs(F.col("old") - F.col("trust")))).first()[0] or 0.0
        trust = now.select("source", "trust")
        if moved <= settled:
            break
    else:
        if rounds:
            raise RuntimeError(f"source trust hasn't settled in {rounds} rounds: it still moves by {moved}")
    best = _chosen(disputed, trust).unionByName(settled_.groupBy("group_id", "field").agg(F.max("value").alias("value")))
    wide = best.groupBy("group_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
    return whole.select("group_id").distinct().join(wide, "group_id", "left")


def _support(votes: DataFrame, trust: DataFrame) -> DataFrame:
    """The support ``s`` of each value of a group and field, and when it was claimed last."""
    sure = -F.log1p(-F.least("trust", F.lit(0.999)))
    return votes.join(trust, "source").groupBy("group_id", "field", "value").agg(F.round(F.sum(F.col("weight") * sure), 6).alias("s"), F.max("last").alias("last"))


def _chosen(votes: DataFrame, trust: DataFrame) -> DataFrame:
    """The best supported value of each group and field."""
    return _support(votes, trust).groupBy("group_id", "field").agg(F.max(F.struct("s", "last", "value")).alias("top")).select("group_id", "field", F.col("top.value").alias("value"))
