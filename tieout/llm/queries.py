"""Queries of the training-data problems."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.ids import same_id
from tieout.llm.entities import calibration, candidate_pairs, confidence, fitted, name_score, pay_score
from tieout.llm.leaks import leaks
from tieout.llm.packing import packed
from tieout.llm.people import employee_groups
from tieout.llm.splitting import pieces
from tieout.llm.survivor import survivors
from tieout.llm.tokens import sizes
from tieout.llm.variants import is_pseudo, linked, typed
from tieout.plans.lineage import cut
from tieout.sources.tables import table


def _repeated(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """Census rows of employees with two or more rows in a pack, with group_id, source and order."""
    census = table(spark, d, "census")
    groups = cut(employee_groups(census))
    many = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    rows = groups.join(many, "group_id").select("rec_id", "group_id")
    when = F.concat_ws(" ", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.format_string("%05d %09d", F.coalesce("file_ord", F.lit(0)), F.coalesce("row_ord", F.lit(0))))
    return census.select("rec_id", F.concat_ws("/", "pack_id", "file_ord").alias("source"), when.alias("last"), *columns).join(rows, "rec_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, first_name, last_name): the surviving name of each repeated employee."""
    fields = ["employee_first_name", "employee_last_name"]
    out = survivors(_repeated(spark, d, fields), dict.fromkeys(fields, "name"), group="group_id", source="source", last="last")
    return out.select("group_id", F.col("employee_first_name").alias("first_name"), F.col("employee_last_name").alias("last_name"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving row of each repeated employee, field by field."""
    named = ["employee_first_name", "employee_last_name"]
    plain = "employee_id state gross_annual_taxable_wages pay_frequency federal_w4_marital_status w4_year dependents step2c step3 group_health_monthly other_monthly_pretax retirement_401k_monthly additional_federal additional_state census_socialsec census_medicare".split()
    return survivors(_repeated(spark, d, named + plain), dict.fromkeys(named, "name") | dict.fromkeys(plain, "plain"), group="group_id", source="source", last="last")


def _variant_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    packs = table(spark, d, "pack").where("id_scheme = 'none'").select("pack_id")
    census = table(spark, d, "census").join(packs, "pack_id", "left_semi")
    proposal = table(spark, d, "proposal").join(packs, "pack_id", "left_semi").where(~is_pseudo("first_name"))
    return census, proposal.select("rec_id", "pack_id", "first_name", "last_name", F.col("annual_salary").alias("pay"), typed("first_name", "last_name").alias("name"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, side, cluster_id): census and proposal rows of packs without shared ids, one cluster per employee."""
    census, proposal = (cut(x) for x in _variant_rows(spark, d))
    groups = cut(employee_groups(census))
    typed_names = census.select("rec_id", typed("employee_first_name", "employee_last_name").alias("name"), F.col("gross_annual_taxable_wages").alias("pay"))
    people = groups.select("rec_id", "pack_id", F.col("group_id").alias("node")).join(typed_names, "rec_id").select("pack_id", "node", F.lit(0).alias("side"), "name", "pay").distinct()
    spelt = cut(proposal.where("name <> '' and pack_id is not null").groupBy("pack_id", "name", "pay").agg(F.min("rec_id").alias("node")))
    found = linked(cut(people.unionByName(spelt.select("pack_id", "node", F.lit(1).alias("side"), "name", "pay"))), within="pack_id")
    spelt = spelt.select(F.col("pack_id").alias("_pack"), F.col("name").alias("_name"), F.col("pay").alias("_pay"), "node")
    mine = proposal.join(spelt, (F.col("pack_id") == F.col("_pack")) & (F.col("name") == F.col("_name")) & F.col("pay").eqNullSafe(F.col("_pay")), "left").select("rec_id", F.lit("proposal").alias("side"), F.coalesce("node", "rec_id").alias("node"))
    rows = groups.select("rec_id", F.lit("census").alias("side"), F.col("group_id").alias("node")).unionByName(mine)
    return rows.join(found, "node", "left").select("rec_id", "side", F.coalesce("component", "node").alias("cluster_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b): census and proposal rows of one employee whose names are typed differently."""
    census, proposal = _variant_rows(spark, d)
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    clusters = cut(p6_clusters(spark, d))
    a = census.select("rec_id", plain("employee_first_name").alias("af"), plain("employee_last_name").alias("al")).join(clusters.where("side = 'census'"), "rec_id").select(F.col("rec_id").alias("id_a"), "cluster_id", "af", "al")
    b = proposal.select("rec_id", plain("first_name").alias("bf"), plain("last_name").alias("bl")).join(clusters.where("side = 'proposal'"), "rec_id").select(F.col("rec_id").alias("id_b"), "cluster_id", "bf", "bl")
    return a.join(b, "cluster_id").where("af <> bf or al <> bl").select("id_a", "id_b")


def _own_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of packs where each source numbers by itself: (rec_id, pack_id, side, entity, name, pays). Side 0 is the
    census, its entity the employee; side 1 proposal rows and statements, their entity those with one id of their source."""
    packs = table(spark, d, "pack").where("id_scheme = 'own'").select("pack_id")
    census = table(spark, d, "census").join(packs, "pack_id", "left_semi")
    dollars = lambda c: F.round(c).cast("int")
    taxed = F.col("gross_annual_taxable_wages") - 12 * (F.coalesce("group_health_monthly", F.lit(0.0)) + F.coalesce("other_monthly_pretax", F.lit(0.0)))
    a = census.select("rec_id", F.lit(0).alias("side"), typed("employee_first_name", "employee_last_name").alias("name"), F.array_compact(F.array(dollars("gross_annual_taxable_wages"), -dollars(taxed))).alias("pays"))
    a = a.join(cut(employee_groups(census)).select("rec_id", "pack_id", F.col("group_id").alias("entity")), "rec_id")
    entity = lambda kind, key: F.xxhash64(F.lit(kind), "pack_id", F.coalesce(same_id(key), F.concat(F.lit("-"), F.col("rec_id").cast("string"))))
    b = table(spark, d, "proposal").join(packs, "pack_id", "left_semi").where(~is_pseudo("first_name"))
    b = b.select("rec_id", F.lit(1).alias("side"), typed("first_name", "last_name").alias("name"), F.array_compact(F.array(dollars("annual_salary"), -dollars(F.col("taxable_income_before") * 12))).alias("pays"), "pack_id", entity("b", "client_employee_id").alias("entity"))
    c = table(spark, d, "paycheck").select("rec_id", "pack_id", "name", "employee_id", "gross").join(packs, "pack_id", "left_semi")
    c = c.select("rec_id", F.lit(1).alias("side"), F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.array_compact(F.array(*(dollars(F.col("gross") * n) for n in (12, 24, 26, 52)))).alias("pays"), "pack_id", entity("c", "employee_id").alias("entity"))
    return a, b.unionByName(c)


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b, confidence): each census row with the proposal rows and statements of its employee. The best employee
    by cosine, names and pay is taken if these speak for a match; its confidence is calibrated."""
    a, b = _own_records(spark, d)
    rows = cut(a.unionByName(b))
    shapes = rows.where("name <> ''").groupBy("pack_id", "side", "entity", "name", "pays").agg(F.lit(1).alias("_one")).drop("_one").withColumnRenamed("entity", "shape")
    shapes = cut(shapes.join(shapes.groupBy("pack_id").agg(F.count("*").alias("size")), "pack_id"))
    pairs = cut(candidate_pairs(shapes, fitted(shapes)))
    scored = pairs.withColumn("by_name", name_score(calibration(pairs)))
    scored = scored.withColumn("score", scored["by_name"] + pay_score())
    best = scored.groupBy("pack_id", F.col("b").alias("entity")).agg(F.max(F.struct("score", (-F.col("a")).alias("less"), "by_name", "pay")).alias("top")).where("top.score >= 0")
    chosen = best.select("pack_id", "entity", (-F.col("top.less")).alias("group_id"), "top.by_name", "top.pay").withColumn("confidence", confidence(scored))
    ours = rows.where("side = 0").select("pack_id", F.col("entity").alias("group_id"), F.col("rec_id").alias("id_a"))
    theirs = rows.where("side = 1").select("pack_id", "entity", F.col("rec_id").alias("id_b"))
    return chosen.join(theirs, ["pack_id", "entity"]).join(ours, ["pack_id", "group_id"]).select("id_a", "id_b", F.round("confidence", 6).alias("confidence"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b): the matches of ``p2_matches``."""
    return p2_matches(spark, d).select("id_a", "id_b")


def _limits(spark: SparkSession, d: str, overlapping: bool) -> DataFrame:
    return table(spark, d, "token_limit").where(F.coalesce("overlap_tokens", F.lit(0)) > 0 if overlapping else F.coalesce("overlap_tokens", F.lit(0)) == 0)


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """(limit_name, doc_id, piece, token_start, n_tokens, container_id): every document's container under each capacity."""
    return packed(cut(sizes(table(spark, d, "documents"))), _limits(spark, d, False))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: items, tokens, containers, the fewest containers that could hold them, and the share left unused."""
    used = p7_packed(spark, d).join(F.broadcast(_limits(spark, d, False).select("limit_name", "capacity_tokens")), "limit_name")
    load = used.groupBy("limit_name", "capacity_tokens", "container_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    out = load.groupBy("limit_name", "capacity_tokens").agg(F.sum("n").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_containers"), F.max("tokens").alias("fullest"))
    return out.withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))).withColumn("unused", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id, held, words, same_slots, changed_slots, clashing_slots, slots): evaluation items that leaked, how
    much of each, and what became of its numbers, units and names."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id) of ``p8_leaks``."""
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document over each capacity, with the limits' overlaps."""
    return pieces(table(spark, d, "documents"), _limits(spark, d, True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_matches": p2_matches, "p3_found": p3_found, "p3_survivors": p3_survivors, "p6_found": p6_found, "p6_clusters": p6_clusters, "p7_packed": p7_packed, "p7_report": p7_report, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_pieces": p9_pieces}
SQL: dict[str, str] = {}
