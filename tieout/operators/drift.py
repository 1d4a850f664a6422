"""Files whose fields are added, renamed, removed or change type: one table and a list of the changes."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def plain_header(c: Column) -> Column:
    """Lower case, each run of characters other than a-z and 0-9 as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def cell_tags(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """``rows`` without ``cells``, one row per cell: ``header``, ``tag`` (``text``, ``number``, ``boolean``, ``list``,
    ``object``, or null for a JSON null), ``value`` as text. Rows whose JSON is null, broken or no object have no cells."""
    flat = rows.withColumn("_cells", F.try_parse_json(F.col(cells))).where(F.schema_of_variant("_cells").startswith("OBJECT"))
    view = flat.drop(cells)
    out = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("_cells").outer()).toDF("_pos", "_key", "_value"))
    kind = F.schema_of_variant("_value")
    return out.select(
        *(f"`{c}`" for c in view.columns if c != "_cells"),
        F.col("_key").alias("header"),
        F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").when(kind != "VOID", "number").alias("tag"),
        F.coalesce(F.try_variant_get("_value", "$", "string"), F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json("_value"))).alias("value"),
    )


def file_schemas(cells: DataFrame, file: str, synonyms: Column) -> DataFrame:
    """The tagged union of each file's rows: per file and wanted field the headers that carry it and the alternatives
    (``branches``) that its cells have, ``type`` being ``text`` if any cell is text, else ``number``. ``synonyms``: a field name for a
    (``slot``, plain header), null for a header of no wanted field.

    One aggregation on (file, header), combined before the shuffle; its result is one row per file and header."""
    by = cells.groupBy(file, "slot", "header").agg(F.collect_set("tag").alias("tags"))
    return (
        by.join(header_fields(by, synonyms), ["slot", "header"])
        .groupBy(file, "field")
        .agg(
            F.array_sort(F.collect_set("plain")).alias("headers"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("branches"),
        )
        .withColumn("type", F.when(F.array_contains("branches", "text"), "text").otherwise("number"))
    )


def header_fields(cells: DataFrame, synonyms: Column) -> DataFrame:
    """(slot, header, plain, field): every different header of a wanted field, looked up once."""
    # Of the maximum, which is the header: a filter on a grouping column would be moved before the grouping, to every cell.
    heads = cells.groupBy("slot", "header").agg(F.max("header").alias("_h")).withColumn("plain", plain_header(F.col("_h"))).drop("_h")
    return heads.withColumn("field", synonyms).where("field is not null")


def schema_changes(schemas: DataFrame, files: DataFrame, *, file: str, series: str, order: Sequence[str]) -> DataFrame:
    """One row per change of a field against the file before it in its series: (file, field, change, was, now).

    change: ``added`` and ``removed``; for a field in both files ``renamed`` if its headers differ, ``retyped`` if its
    type differs (both may hold). First files have none. ``order`` must place a series' files; ties go by file. A file
    without any wanted field counts, and a series with one file has no changes. Files without a series are left out."""
    seq = files.where(F.col(series).isNotNull()).select(
        F.col(series).alias("_series"), F.col(file).alias("_file"), F.row_number().over(W.partitionBy(series).orderBy(*order, file)).alias("_seq")
    )
    at = schemas.join(seq, schemas[file] == seq["_file"]).select("_series", "_seq", "field", "headers", "type")
    old = at.select("_series", (F.col("_seq") + 1).alias("_seq"), "field", F.struct("headers", "type").alias("_old"))
    new = at.select("_series", "_seq", "field", F.struct("headers", "type").alias("_new"))
    both = old.join(new, ["_series", "_seq", "field"], "full").join(seq.where("_seq > 1"), ["_series", "_seq"])
    kinds = F.array_compact(
        F.array(
            F.when(F.col("_old").isNull(), "added"),
            F.when(F.col("_new").isNull(), "removed"),
            F.when(F.col("_old.headers") != F.col("_new.headers"), "renamed"),
            F.when(F.col("_old.type") != F.col("_new.type"), "retyped"),
        )
    )
    told = lambda c: F.concat_ws(" ", F.concat_ws("|", f"{c}.headers"), F.concat(F.lit(":"), F.col(f"{c}.type")))
    return both.select(F.col("_file").alias(file), "field", F.explode(kinds).alias("change"), F.when(F.col("_old").isNotNull(), told("_old")).alias("was"), F.when(F.col("_new").isNotNull(), told("_new")).alias("now"))


def new_alternatives(schemas: DataFrame, files: DataFrame, *, file: str, series: str, order: Sequence[str]) -> DataFrame:
    """(file, field, alternative, before): each type of cell that a field has in a file and did not have in the file
    before it in its series, where it was there with other types, ``before``. A field of nothing but nulls has no types."""
    seq = files.where(F.col(series).isNotNull()).select(F.col(series).alias("_series"), F.col(file).alias("_file"), F.row_number().over(W.partitionBy(series).orderBy(*order, file)).alias("_seq"))
    at = schemas.where(F.size("branches") > 0).join(seq, schemas[file] == seq["_file"]).select("_series", "_seq", "_file", "field", "branches")
    old = at.select("_series", (F.col("_seq") + 1).alias("_seq"), "field", F.col("branches").alias("_old"))
    both = at.join(old, ["_series", "_seq", "field"])
    return both.select(F.col("_file").alias(file), "field", F.explode(F.array_except("branches", "_old")).alias("alternative"), F.array_join("_old", "|").alias("before"))


def inferred_column(synonyms: Mapping[str, Mapping[str, str]], slot: str = "slot", plain: str = "plain", least: int = 8) -> Column:
    """``synonym_column``, and for a header not listed the field of the listed header that it equals but for blanks, else
    of the first by name, of ``least`` letters or more, that one letter makes of it. Null for what is like none."""
    joined = {s: {h.replace(" ", ""): f for h, f in sorted(own.items(), reverse=True)} for s, own in synonyms.items()}
    listed = F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(h).alias("header"), F.lit(f).alias("field")) for s, own in synonyms.items() for h, f in sorted(own.items()) if len(h) >= least))
    near = F.filter(listed, lambda x: (x["slot"] == F.col(slot)) & (F.abs(F.length(x["header"]) - F.length(plain)) < 2) & (F.levenshtein(x["header"], F.col(plain)) == 1))
    squeezed = F.try_element_at(F.create_map(*(x for s, own in joined.items() for h, f in own.items() for x in (F.lit(f"{s}\t{h}"), F.lit(f)))), F.concat_ws("\t", slot, F.replace(F.col(plain), F.lit(" "), F.lit(""))))
    return F.coalesce(synonym_column(synonyms, slot, plain), squeezed, F.get(near, 0)["field"])


def synonym_column(synonyms: Mapping[str, Mapping[str, str]], slot: str = "slot", plain: str = "plain") -> Column:
    """(slot, plain header) -> field as one literal map, at most a few hundred entries, looked up in generated code."""
    pairs = [x for s, own in synonyms.items() for h, f in own.items() for x in (F.lit(f"{s}\t{h}"), F.lit(f))]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws("\t", slot, plain))


def unified(cells: DataFrame, keys: Sequence[str], fields: Sequence[str], synonyms: Column, numbers: Sequence[str]) -> DataFrame:
    """One row per ``keys`` with, for each field, its canonical value and for ``numbers`` also the typed branches
    ``<field>__text`` and ``<field>__number`` that the cell came in. Fields absent from a row are null. Where one row
    has several headers of a field, the first header by name with a value is taken."""
    tagged = cells.where("tag is not null").join(header_fields(cells, synonyms), ["slot", "header"])
    pick = lambda f, c: F.min_by(c, F.when(F.col("field") == f, F.col("header")))
    money = F.regexp_replace(F.col("value"), r"[$,\s]", "").try_cast("double")
    out = []
    for f in fields:
        if f in numbers:
            out += [
                pick(f, F.when((F.col("field") == f) & (F.col("tag") == "text"), F.col("value"))).alias(f"{f}__text"),
                pick(f, F.when((F.col("field") == f) & (F.col("tag") == "number"), F.col("value").try_cast("double"))).alias(f"{f}__number"),
                pick(f, money).alias(f),
            ]
        else:
            out.append(pick(f, F.trim("value")).alias(f))
    return tagged.groupBy(*keys).agg(*out)
