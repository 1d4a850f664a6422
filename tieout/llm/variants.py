"""Variant spellings of names: phonetic blocks, Jaro-Winkler with nicknames, connected components."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm import names
from tieout.llm.components import components
from tieout.plans.lineage import cut

#: First names of rows that sum others up: fixed values.
PSEUDO = ("total", "totals", "monthly average", "average")


def typed(first: str, last: str) -> Column:
    """Both parts of a typed name in one text, blanks around them gone, null as empty."""
    return F.trim(F.concat_ws(" ", F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(last, F.lit("")))))


def is_pseudo(first: str) -> Column:
    """Whether a row is a total or an average rather than a person."""
    return F.lower(F.trim(F.coalesce(first, F.lit("")))).isin(*PSEUDO)


@F.pandas_udf(T.ArrayType(T.StringType()))
def blocking_codes(name: pd.Series) -> pd.Series:
    """``names.codes`` of typed names."""
    return pd.Series([sorted(names.codes(names.tokens(x or ""))) for x in name])


@F.pandas_udf(T.StructType([T.StructField("like", T.DoubleType()), T.StructField("worst", T.DoubleType())]))
def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """How alike two typed names are as a whole, and in their least alike parts."""
    out = []
    for x, y in zip(a, b):
        out.append(names.compared(names.tokens(x or ""), names.tokens(y or "")))
    return pd.DataFrame(out, columns=["like", "worst"])


#: Names of one blocking code that meet in one task, squared: a code with more is split into cells of this side.
CELL = 1500


def alike_names(nodes: DataFrame, *, within: str, least: float = 0.8) -> DataFrame:
    """(within, a, b, like, worst): the pairs a <= b of distinct names ``name`` of ``nodes`` (within, name, side) that
    share a phonetic blocking code, of which one at least is carried by side 1, and that are at least so alike. Names are
    compared once however many rows carry them; a block holds distinct names alone and is split where it is large. Null
    and empty names pair with nothing."""
    spelt = nodes.where("name <> ''").groupBy(within, "name").agg(F.max("side").alias("row"))
    spelt = cut(spelt.withColumn("id", F.monotonically_increasing_id()))
    # Codes meet by their hash, names by a number: two codes of one hash make a pair more to compare, nothing else.
    coded = cut(spelt.select("id", "row", F.explode(blocking_codes("name")).alias("code"), within).select("id", "row", F.xxhash64(within, "code").alias("code")))
    many = coded.groupBy("code").agg(F.ceil(F.count("*") / CELL).cast("int").alias("strips")).where("strips > 1")
    # A name of a large code is in one strip and is repeated for every strip of the other side: two names meet in one cell.
    own = F.pmod(F.xxhash64("id"), F.col("strips")).cast("int").alias("own")
    coded = coded.join(many, "code", "left").withColumn("strips", F.coalesce("strips", F.lit(1)))
    coded = coded.select("code", "id", "row", own, F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("other"))
    left = coded.select("code", F.col("own").alias("i"), F.col("other").alias("j"), F.col("id").alias("x"), F.col("row").alias("row_x"))
    right = coded.select("code", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("y"), F.col("row").alias("row_y"))
    pairs = left.join(right, ["code", "i", "j"]).where("x <= y and row_x + row_y > 0").select("x", "y").distinct()
    named = pairs.join(spelt.select(within, F.col("id").alias("x"), F.col("name").alias("a_")), "x").join(spelt.select(F.col("id").alias("y"), F.col("name").alias("b_")), "y")
    ordered = named.select(within, F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))
    return ordered.withColumn("c", compared("a", "b")).select(within, "a", "b", "c.like", "c.worst").where(F.col("like") >= least)


def pay_evidence(stated: Column, known: Column) -> Column:
    """What a stated salary says against a known one: 3 equal, 2 rounded or buffered, 0 nothing known, -1 otherwise."""
    near = lambda x, tolerance: F.abs(stated - x) <= tolerance
    return (
        F.when(stated.isNull() | known.isNull(), 0.0)
        .when(near(known, 0.011), 3.0)
        .when(near(known * 1.03, 0.03), 2.5)
        .when(near(F.round(known, -2), 0.011) | near(known, 50.0), 2.0)
        .when(near(known * 1.015, known * 0.018), 0.5)
        .otherwise(-1.0)
    )


#: A row is accepted as an employee when the least alike parts are this alike; with agreeing pay, when at least so.
WORST, WORST_WITH_PAY = 0.86, 0.6
#: Two rows are accepted as one person's without agreeing pay when their least alike parts are this alike.
WORST_OF_ROWS = 0.95
#: What being the sure match of another row takes from an employee, for rows that could be several employees.
CLAIMED = 0.3
#: Pays that can agree are in the same or neighbouring steps of this width in their logarithm, from PAY_LEAST on.
PAY_STEP, PAY_LEAST = 0.05, 1000.0


def accepted_pairs(pairs: DataFrame, nodes: DataFrame, *, within: str) -> DataFrame:
    """(within, u, v, side, score, said, like): the pairs of nodes accepted as one person, ``v`` a row (side 1), ``u`` an
    employee (side 0) or a row with a smaller number.

    ``pairs``: ``alike_names``; ``nodes``: (within, node, side, name, pay), an employee with a line for every name and
    pay of theirs, pay null where not known. A row is accepted as an employee if all parts of the names are alike and the
    pay doesn't speak against it, or the pay agrees and the parts aren't unlike; two rows if the pay agrees likewise, or
    the names are nearly equal. Lines meet on the name and a step of the pay, so that namesakes are no square."""
    step = F.floor(F.log(F.greatest(F.col("pay"), F.lit(PAY_LEAST))) / PAY_STEP).cast("string")
    near = lambda d: (F.floor(F.log(F.greatest(F.col("pay"), F.lit(PAY_LEAST))) / PAY_STEP) + d).cast("string")
    # "u" and "v": the pay of this side is not known, so that any of the other meets it.
    first = F.when(F.col("pay").isNull(), F.array(F.lit("u"))).otherwise(F.array(F.lit("v"), step))
    second = F.concat(F.array(F.lit("u")), F.when(F.col("pay").isNull(), F.array(F.lit("v"))).otherwise(F.array(near(-1), near(0), near(1))))
    one = nodes.select(within, F.col("name").alias("a"), F.col("node").alias("u"), "side", F.col("pay").alias("known"), F.explode(first).alias("step"))
    two = nodes.where("side = 1").select(within, F.col("name").alias("b"), F.col("node").alias("v"), "pay", F.explode(second).alias("step"))
    both = pairs.unionByName(pairs.where("a < b").select(within, F.col("b").alias("a"), F.col("a").alias("b"), "like", "worst"))
    met = both.join(one, [within, "a"]).join(two, [within, "b", "step"]).where("side = 0 or u < v")
    back = F.when(F.col("side") == 1, pay_evidence(F.col("known"), F.col("pay"))).otherwise(-1.0)
    at = met.withColumn("said", F.greatest(pay_evidence(F.col("pay"), F.col("known")), back))
    sure = (F.col("said") >= 2) & (F.col("worst") >= WORST_WITH_PAY)
    least = F.when(F.col("side") == 0, WORST).otherwise(WORST_OF_ROWS)
    fits = at.where(sure | ((F.col("worst") >= least) & (F.col("said") >= 0)))
    return fits.groupBy(within, "u", "v", "side").agg(F.max(F.round(F.col("like") * 10 + F.col("said"), 6)).alias("score"), F.max("said").alias("said"), F.max("like").alias("like"))


def kept_pairs(accepted: DataFrame, labels: DataFrame, *, within: str) -> DataFrame:
    """(u, v, split): the accepted pairs that hold after conflicts. A component (``labels``: node, component) with one
    employee or none keeps all its pairs. Where it has several, every row keeps one pair: that with its best employee by
    name and pay, employees that are the sure match of another row coming after others where the pay says nothing; a row
    that is no employee's by itself keeps its best row, one that has an employee before one that has none. So no two
    employees remain connected. Ties go to the smallest node."""
    at = accepted.join(labels, accepted["v"] == labels["node"]).drop("node")
    several = at.where("side = 0").groupBy("component").agg((F.min("u") != F.max("u")).alias("split"))
    at = cut(at.join(several, "component", "left").withColumn("split", F.coalesce("split", F.lit(False))).drop("component"))
    direct = at.where("split and side = 0")
    claims = _best(direct, within).where("said >= 2 or like >= 0.97").groupBy(within, "u").agg(F.min("v").alias("by_first"), F.max("v").alias("by_last"))
    other = F.col("by_first").isNotNull() & ~((F.col("by_first") == F.col("v")) & (F.col("by_last") == F.col("v")))
    again = direct.join(claims, [within, "u"], "left").withColumn("score", F.col("score") - F.when(other & (F.col("said") <= 0), CLAIMED).otherwise(0.0))
    best = _best(again, within).select("u", "v")
    placed = best.select(F.col("v").alias("node"))
    rows = at.where("split and side = 1").select("u", "v", "score")
    ways = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"), "score"))
    lone = ways.join(placed, ways["v"] == placed["node"], "left_anti").join(placed.withColumn("has", F.lit(1)), F.col("u") == F.col("node"), "left")
    next_ = lone.groupBy("v").agg(F.max(F.struct(F.coalesce("has", F.lit(0)).alias("has"), "score", (-F.col("u")).alias("less"))).alias("top")).select((-F.col("top.less")).alias("u"), "v")
    return at.where("not split").select("u", "v").withColumn("split", F.lit(False)).unionByName(best.unionByName(next_).withColumn("split", F.lit(True)))


def _best(pairs: DataFrame, within: str) -> DataFrame:
    top = F.max(F.struct(F.round("score", 6).alias("score"), (-F.col("u")).alias("less"), "said", "like")).alias("top")
    return pairs.groupBy(within, "v").agg(top).select(within, "v", (-F.col("top.less")).alias("u"), "top.score", "top.said", "top.like")


def linked(nodes: DataFrame, *, within: str, least: float = 0.75) -> DataFrame:
    """(node, component): the nodes (see ``accepted_pairs``) that are one person, by connected components of the accepted
    pairs, so that spellings unlike each other meet through a third; components that join employees are split by
    ``kept_pairs`` and their parts found anew. Nodes without an accepted pair are not listed."""
    accepted = cut(accepted_pairs(cut(alike_names(nodes, within=within, least=least)), nodes, within=within))
    labels = components(accepted.select(F.col("u").alias("a"), F.col("v").alias("b")))
    kept = cut(kept_pairs(accepted, labels, within=within))
    parts = components(kept.where("split").select(F.col("u").alias("a"), F.col("v").alias("b")))
    whole = kept.where("not split").select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return labels.join(whole, "node", "left_semi").unionByName(parts)
