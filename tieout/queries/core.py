"""Queries of the general data problems: dangling references, drifting schemas, mixed units."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.headers import CENSUS, NUMBERS, PROPOSAL, SYNONYMS
from tieout.functions.ids import same_id
from tieout.operators.drift import cell_tags, file_schemas, inferred_column, new_alternatives, schema_changes, unified
from tieout.operators.orphans import orphans
from tieout.operators.units import common_units
from tieout.sources.tables import table


def p1_orphans(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, period, row_id, reason) of every reference that no census row answers at its time."""
    shared = table(spark, d, "pack").where("id_scheme = 'shared'").select(F.col("pack_id").alias("_pack"))
    census = table(spark, d, "census").select("pack_id", "rec_id", same_id("employee_id").alias("id"), "loaded_at", "withdrawn_at")
    proposal = table(spark, d, "proposal").select(F.lit("proposal").alias("src_table"), "period", F.col("rec_id").alias("row_id"), "pack_id", same_id("client_employee_id").alias("id"), F.col("loaded_at").alias("at"))
    paycheck = table(spark, d, "paycheck").select(F.lit("paycheck").alias("src_table"), "period", F.col("rec_id").alias("row_id"), "pack_id", same_id("employee_id").alias("id"), F.col("loaded_at").alias("at"))
    refs = proposal.unionByName(paycheck).join(shared, F.col("pack_id") == F.col("_pack"), "left_semi")
    # Rows without an id, and matches without a row, are masks of the keys that refer to nothing under simple match.
    match = table(spark, d, "audit_match").where("found").select(F.lit("audit_match").alias("src_table"), "period", F.col("match_id").alias("row_id"), "census_rec_id", F.col("run_at").alias("at"))
    parents = census.where("id is not null").join(shared, F.col("pack_id") == F.col("_pack"), "left_semi")
    time = {"at": "at", "loaded": "loaded_at", "withdrawn": "withdrawn_at"}
    out = ["src_table", "period", "row_id", "reason"]
    return orphans(refs, parents, [("pack_id", "pack_id"), ("id", "id")], **time).select(out).unionByName(orphans(match, census, [("census_rec_id", "rec_id")], **time).select(out))


def p1_partial(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, period, known, reason): proposal rows of shared packs that refer to the census by pack, id and last name,
    each of the last two as far as it is there, and that no row answers; ``known`` names the keys that are there."""
    name = lambda c: F.nullif(F.lower(F.regexp_replace(c, "[^A-Za-z]", "")), F.lit(""))
    shared = table(spark, d, "pack").where("id_scheme = 'shared'").select(F.col("pack_id").alias("_pack"))
    refs = table(spark, d, "proposal").select(F.col("rec_id").alias("row_id"), "period", "pack_id", same_id("client_employee_id").alias("id"), name("last_name").alias("last"), F.col("loaded_at").alias("at"))
    parents = table(spark, d, "census").select("pack_id", same_id("employee_id").alias("id"), name("employee_last_name").alias("last"), "loaded_at", "withdrawn_at")
    found = orphans(refs.join(shared, F.col("pack_id") == F.col("_pack"), "left_semi"), parents, [("pack_id", "pack_id"), ("id", "id"), ("last", "last")], at="at", loaded="loaded_at", withdrawn="withdrawn_at", match="partial")
    known = F.concat_ws("+", F.lit("pack"), F.when(F.col("id").isNotNull(), "id"), F.when(F.col("last").isNotNull(), "name"))
    return found.select("row_id", "period", known.alias("known"), "reason")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted by table, period and reason."""
    return p1_orphans(spark, d).groupBy("src_table", "period", "reason").agg(F.count("*").alias("n_refs"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, d, "upload_file").select("file_id", "series_id", "slot", "file_ord")
    rows = table(spark, d, "upload_row").select("file_id", "row_ord", "cells").join(files.select("file_id", "slot"), "file_id")
    return files, cell_tags(rows)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, field, change): how each file of a series differs from the one before."""
    files, cells = _cells(spark, d)
    changes = schema_changes(file_schemas(cells, "file_id", inferred_column(SYNONYMS)), files, file="file_id", series="series_id", order=["file_ord"])
    return changes.select("file_id", "field", "change")


def p4_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, field, alternative, before): types of cells that a field has newly in a file."""
    files, cells = _cells(spark, d)
    return new_alternatives(file_schemas(cells, "file_id", inferred_column(SYNONYMS)), files, file="file_id", series="series_id", order=["file_ord"])


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every uploaded row in one schema: canonical values, and typed branches of the numeric fields."""
    _, cells = _cells(spark, d)
    fields = list(dict.fromkeys([*CENSUS, *PROPOSAL]))
    return unified(cells, ["file_id", "row_ord", "slot"], fields, inferred_column(SYNONYMS), NUMBERS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(reading_id, field, common_value): each reading in its field's common unit."""
    return common_units(table(spark, d, "stated_amount"), table(spark, d, "reading_source")).select("reading_id", "field", "common_value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_orphans, "p1_report": p1_report, "p1_partial": p1_partial, "p4_found": p4_found, "p4_alternatives": p4_alternatives, "p4_unified": p4_unified, "p5_found": p5_found}
