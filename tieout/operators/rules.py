"""Decision tables as data, compiled once to Column expressions; nothing is evaluated as code."""

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule that can't be compiled."""


@dataclass(frozen=True)
class Rule:
    """Conditions on inputs, (input, operator, value), all of which must hold, and outputs in order, each a literal, a
    formula with {references}, or a call ("FUNCTION", arguments)."""

    name: str
    conditions: Sequence[tuple[str, str, Any]]
    outputs: Mapping[str, Any]
    active: bool = True
    kind: Mapping[str, str] = field(default_factory=dict)


def _text(c: Column) -> Column:
    """A value as conditions compare it: trimmed upper case, null as NONE."""
    return F.coalesce(F.upper(F.trim(c.cast("string"))), F.lit("NONE"))


def _same(v: Any) -> str:
    return str(v).strip().upper()


def condition(value: Column, operator: str, wanted: Any, known: Mapping[str, Column] | None = None) -> Column:
    """One cell. ``anything`` and ``ELSE`` hold; =, !=, IN, NOT IN compare trimmed text without case, a null being the
    text NONE; <, <=, >, >=, between compare numbers, and fail for what is no number; ``function`` takes a call."""
    if operator in ("anything", "ELSE"):
        return F.lit(True)
    if operator == "function":
        return truth(call(wanted, known or {}))
    listed = [_same(v) for v in wanted] if isinstance(wanted, (list, tuple)) else [_same(wanted)]
    if operator in ("=", "==", "IN"):
        return _text(value).isin(*listed)
    if operator in ("!=", "NOT IN"):
        return ~_text(value).isin(*listed)
    number = value.try_cast("double")
    compare = {">": lambda: number > float(wanted), ">=": lambda: number >= float(wanted), "<": lambda: number < float(wanted), "<=": lambda: number <= float(wanted), "between": lambda: number.between(float(wanted[0]), float(wanted[1]))}
    if operator not in compare:
        raise RuleError(f"operator {operator!r}")
    return F.coalesce(compare[operator](), F.lit(False))


def truth(c: Column) -> Column:
    """Whether a value counts as true: a true, a number but 0, a text but the empty one."""
    return F.coalesce(F.when(c.try_cast("boolean").isNotNull(), c.try_cast("boolean")).otherwise(c.try_cast("double") != 0), F.lit(False))


def _num(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def call(expr: Any, known: Mapping[str, Column]) -> Column:
    """A literal, a text formula with {references}, or ("FUNCTION", argument, ...). A reference that isn't known is 0; so
    is a division by zero."""
    if isinstance(expr, str) and "{" in expr:
        return formula(expr, known)
    if not isinstance(expr, tuple):
        return F.lit(expr)
    name, args = expr[0].upper(), [call(a, known) for a in expr[1:]]
    n = [_num(a) if not isinstance(e, (tuple, str)) or "{" in str(e) or isinstance(e, tuple) else a for a, e in zip(args, expr[1:])]
    simple = {
        "PLUS_CHAR": lambda: reduce(lambda a, b: a + b, n), "SUM": lambda: reduce(lambda a, b: a + b, n), "MINUS_CHAR": lambda: n[0] - n[1], "TIMES_CHAR": lambda: n[0] * n[1],
        "DIVIDED_CHAR": lambda: F.coalesce(F.try_divide(n[0], n[1]), F.lit(0.0)), "ROUND": lambda: F.round(n[0].cast("decimal(28,6)"), int(expr[2]) if len(expr) > 2 else 2).cast("double"),
        "MAX": lambda: F.greatest(*n) if len(n) > 1 else n[0], "MIN": lambda: F.least(*n) if len(n) > 1 else n[0], "ABS": lambda: F.abs(n[0]), "FLOOR": lambda: F.floor(n[0]).cast("double"), "CEILING": lambda: F.ceil(n[0]).cast("double"),
        "BTW": lambda: n[0].between(n[1], n[2]), "IF": lambda: F.when(truth(args[0]), args[1]).otherwise(args[2]),
        "EQUAL": lambda: args[0] == args[1], "EQ": lambda: args[0] == args[1], "NOT_EQUAL": lambda: args[0] != args[1], "NEQ": lambda: args[0] != args[1],
        "GREATER": lambda: n[0] > n[1], "GT": lambda: n[0] > n[1], "GREATER_EQUAL": lambda: n[0] >= n[1], "GTE": lambda: n[0] >= n[1],
        "LESS": lambda: n[0] < n[1], "LT": lambda: n[0] < n[1], "LESS_EQUAL": lambda: n[0] <= n[1], "LTE": lambda: n[0] <= n[1],
        "AND": lambda: reduce(lambda a, b: a & b, map(truth, args)), "OR": lambda: reduce(lambda a, b: a | b, map(truth, args)), "NOT": lambda: ~truth(args[0]),
    }
    if name not in simple:
        raise RuleError(f"function {name!r}")
    return simple[name]()


_PART = re.compile(r"\s*(?:\{([^}]+)\}|(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([-+*/()]))")


def formula(text: str, known: Mapping[str, Column]) -> Column:
    """Arithmetic over {references} and numbers by recursive descent. Brackets left open close at the end; a reference
    that is unknown, null or no number is 0; a division by zero makes the formula 0, as does one that can't be read."""
    parts, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            return F.lit(0.0)
        parts.append(m)
        at = m.end()
    place = 0

    def peek() -> str | None:
        return parts[place].group(3) if place < len(parts) else None

    def atom() -> Column:
        nonlocal place
        if place >= len(parts):
            raise RuleError(text)
        m = parts[place]
        place += 1
        if m.group(1):
            ref = m.group(1).strip()
            return _num(known[ref]) if ref in known else F.lit(0.0)
        if m.group(2):
            return F.lit(float(m.group(2)))
        if m.group(3) == "-":
            return -atom()
        if m.group(3) == "+":
            return atom()
        if m.group(3) == "(":
            inner = total()
            if peek() == ")":
                place += 1
            elif place < len(parts):
                raise RuleError(text)
            return inner
        raise RuleError(text)

    def product() -> Column:
        nonlocal place
        out = atom()
        while peek() in ("*", "/"):
            sign = peek()
            place += 1
            out = out * atom() if sign == "*" else F.try_divide(out, atom())
        return out

    def total() -> Column:
        nonlocal place
        out = product()
        while peek() in ("+", "-"):
            sign = peek()
            place += 1
            out = out + product() if sign == "+" else out - product()
        return out

    try:
        out = total()
    except RuleError:
        return F.lit(0.0)
    return F.coalesce(out, F.lit(0.0)) if place == len(parts) else F.lit(0.0)


def validate(rules: Sequence[Rule], inputs: Sequence[str], banned: str = r"(?!)") -> list[str]:
    """What is wrong with a table: inputs that aren't declared, names that repeat, wording that isn't allowed."""
    out = [f"{r.name}: unknown input {i}" for r in rules for i, _, _ in r.conditions if i not in inputs]
    seen: set[str] = set()
    for r in rules:
        if r.name in seen:
            out.append(f"{r.name}: repeated")
        seen.add(r.name)
        out += [f"{r.name}: wording {v!r}" for v in r.outputs.values() if isinstance(v, str) and re.search(banned, v)]
    return out


def _result(rule: Rule, pos: int, known: Mapping[str, Column], variables: Mapping[str, Any], kinds: Mapping[str, str]) -> Column:
    at = {k: F.lit(v) for k, v in variables.items()} | dict(known)
    out = []
    for name, expr in rule.outputs.items():
        value = call(expr, at).cast(kinds.get(name, "string"))
        at[name] = value
        out.append(value.alias(name))
    return F.struct(F.lit(pos).alias("pos"), F.lit(rule.name).alias("rule"), *out)


def solve(rows: DataFrame, rules: Sequence[Rule], *, keep: Sequence[str], kinds: Mapping[str, str], strategy: str = "ALL_MATCH", variables: Mapping[str, Any] | None = None) -> DataFrame:
    """``keep`` of every row with what its rules give: (pos, rule, outputs). ALL_MATCH gives a row per matching rule,
    FIRST_MATCH the first one's. Rules are tried in order; later outputs see earlier ones; ``variables`` stand under the
    row's own columns. The table is one array expression of one pass; no rows, no rules: nothing."""
    known = {c: F.col(f"`{c}`") for c in rows.columns}
    cases = []
    for pos, rule in enumerate(rules):
        if not rule.active:
            continue
        tests = [condition(known.get(i, F.lit((variables or {}).get(i))), op, v, known) for i, op, v in rule.conditions]
        cases.append(F.when(reduce(lambda a, b: a & b, tests, F.lit(True)), _result(rule, pos, known, variables or {}, kinds)))
    if not cases:
        return rows.select(*keep).limit(0)
    if strategy == "FIRST_MATCH":
        return rows.select(*keep, F.coalesce(*cases).alias("_r")).where("_r is not null").select(*keep, "_r.*")
    if strategy != "ALL_MATCH":
        raise RuleError(strategy)
    return rows.select(*keep, F.explode(F.array_compact(F.array(*cases))).alias("_r")).select(*keep, "_r.*")


def rules_from_json(text: str) -> list[Rule]:
    """Rules as they are stored: a list of objects with ``name``, ``conditions`` (input, operator, value), ``outputs`` and
    ``active``. Calls are lists that start with a function's name after ``=``, as ["=SUM", 1, 2]."""
    import json

    def value(v: Any) -> Any:
        return (v[0][1:], *map(value, v[1:])) if isinstance(v, list) and v and isinstance(v[0], str) and v[0].startswith("=") else v

    return [Rule(r["name"], [(c[0], c[1], value(c[2])) for c in r.get("conditions", ())], {k: value(v) for k, v in r["outputs"].items()}, r.get("active", True)) for r in json.loads(text)]


def ranked_list(findings: DataFrame, key: Sequence[str], rank: Mapping[str, int], label: str = "label", pos: str = "pos", default: int = 45) -> DataFrame:
    """(key, n, findings): the labels of each key, once each, by rank and then position, numbered in one text."""
    ranks = F.create_map(*(x for k, v in rank.items() for x in (F.lit(k), F.lit(v)))) if rank else None
    order = F.coalesce(F.try_element_at(ranks, F.col(label)), F.lit(default)) if ranks is not None else F.lit(default)
    first = findings.groupBy(*key, label).agg(F.min(F.struct(order.alias("r"), F.col(pos).alias("p"))).alias("_o"))
    rows = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_o.r", "_o.p", F.col(label).alias("l")))).alias("_a"))
    return rows.select(*key, F.size("_a").alias("n"), F.array_join(F.transform("_a", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["l"])), " ").alias("findings"))
