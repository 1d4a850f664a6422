import operator

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tieout.operators.rules import Rule, RuleError, call, condition, formula, solve, validate

KINDS = {"label": "string", "amount": "double"}


def rows(spark):
    return spark.createDataFrame([(1, 10.0, "Y"), (2, -5.0, "n "), (3, None, None), (4, 0.0, "NONE")], "k int, v double, s string")


def keys(df):
    return sorted(r.k for r in df.collect())


@pytest.mark.parametrize("col,op,want,got", [("s", "=", "y", [1]), ("s", "!=", "N", [1, 3, 4]), ("s", "=", "none", [3, 4]), ("s", "IN", ["N", "Y"], [1, 2]), ("s", "NOT IN", ["N"], [1, 3, 4]), ("v", ">", 0, [1]), ("v", "<=", "0", [2, 4]), ("v", "between", [-5, 0], [2, 4]), ("v", "anything", None, [1, 2, 3, 4]), ("s", ">", 1, [])])
def test_conditions(spark, col, op, want, got):
    assert keys(rows(spark).where(condition(F.col(col), op, want))) == got


def test_bad_operator(spark):
    with pytest.raises(RuleError):
        condition(F.lit(1), "like", 1)


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_formulas(spark):
    known = {"a": F.lit(6.0), "b": F.lit(None).cast("double"), "s": F.lit("text")}
    assert value(spark, formula("({a} + 2) * 3 - {b}", known)) == 24
    assert value(spark, formula("({a} + (2 * 3", known)) == 12
    assert value(spark, formula("{a} / 0", known)) == 0 and value(spark, formula("{missing} + 1", known)) == 1 and value(spark, formula("{s} + 1", known)) == 1
    assert value(spark, formula("__import__('os')", known)) == 0 and value(spark, formula("1 +", known)) == 0


def test_functions(spark):
    known = {"a": F.lit(6.0)}
    for expr, want in [(("SUM", 1, 2, "{a}"), 9), (("DIVIDED_CHAR", 1, 0), 0), (("MAX", 1, 7, 3), 7), (("ROUND", 2.675, 2), 2.68), (("IF", ("GT", "{a}", 5), 1, 2), 1), (("BTW", "{a}", 1, 6), True), (("NOT", ("AND", ("GT", 1, 0), ("LT", 1, 0))), True), (("CEILING", 1.2), 2)]:
        assert value(spark, call(expr, known)) == want
    with pytest.raises(RuleError):
        call(("NOPE", 1), {})


def test_strategies_and_later_outputs(spark):
    rules = [Rule("a", [("v", ">", 0)], {"label": "up", "amount": "{v} * {rate}"}), Rule("off", [], {"label": "off", "amount": 1.0}, active=False), Rule("b", [("s", "!=", "N")], {"label": "not n", "amount": 2.0})]
    every = solve(rows(spark), rules, keep=["k"], kinds=KINDS, variables={"rate": 3})
    assert sorted((r.k, r.rule, r.amount) for r in every.collect()) == [(1, "a", 30.0), (1, "b", 2.0), (3, "b", 2.0), (4, "b", 2.0)]
    first = solve(rows(spark), rules, keep=["k"], kinds=KINDS, strategy="FIRST_MATCH")
    assert sorted((r.k, r.rule) for r in first.collect()) == [(1, "a"), (3, "b"), (4, "b")]
    assert solve(rows(spark), [], keep=["k"], kinds=KINDS).count() == 0
    with pytest.raises(RuleError):
        solve(rows(spark), rules, keep=["k"], kinds=KINDS, strategy="LAST")


def test_validate():
    bad = validate([Rule("a", [("x", "=", 1)], {"label": "tax table"}), Rule("a", [], {})], ["v"], "tax table")
    assert len(bad) == 3


@given(st.recursive(st.integers(0, 99).map(str), lambda e: st.tuples(e, st.sampled_from("+-*"), e).map(lambda x: f"({x[0]} {x[1]} {x[2]})"), max_leaves=8))
@settings(max_examples=25, deadline=None)
def test_formula_against_interpreter(spark, text):
    stack = []
    for part in text.replace("(", "").split():
        stack.append(part)

    def parse(s, i=0):
        if s[i] != "(":
            j = i
            while j < len(s) and s[j].isdigit():
                j += 1
            return float(s[i:j]), j
        a, i = parse(s, i + 1)
        op = {"+": operator.add, "-": operator.sub, "*": operator.mul}[s[i + 1]]
        b, i = parse(s, i + 3)
        return op(a, b), i + 1

    assert value(spark, formula(text, {})) == parse(text)[0]


def test_json_and_ranks(spark):
    from tieout.operators.rules import ranked_list, rules_from_json

    rules = rules_from_json('[{"name": "a", "conditions": [["v", ">", 0]], "outputs": {"label": "up", "amount": ["=SUM", "{v}", ["=ABS", -2]]}}, {"name": "b", "outputs": {"label": "all"}, "active": false}]')
    got = solve(rows(spark), rules, keep=["k"], kinds=KINDS).collect()
    assert [(r.k, r.amount) for r in got] == [(1, 12.0)]
    f = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (1, "x", 0), (2, "z", 0)], "k int, label string, pos int")
    assert sorted((r.k, r.n, r.findings) for r in ranked_list(f, ["k"], {"y": 1}).collect()) == [(1, 2, "1. y 2. x"), (2, 1, "1. z")]
