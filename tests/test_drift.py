from tieout.functions.headers import NUMBERS, SYNONYMS
from tieout.operators.drift import cell_tags, file_schemas, inferred_column, new_alternatives, schema_changes, synonym_column, unified


def frames(spark):
    files = spark.createDataFrame([(1, 7, "census", 1), (2, 7, "census", 2), (3, 7, "census", 3), (4, 8, "census", 1), (5, None, "census", 1)], "file_id int, series_id int, slot string, file_ord int")
    rows = spark.createDataFrame(
        [
            (1, 1, '{"First Name": "A", "Annual Salary": 10.5, "Notes": 1}'),
            (1, 2, '{"First Name": "B", "Annual Salary": null}'),
            (2, 1, '{"FIRST_NAME": "A", "Annual Salary": "$10.50", "Pay Freq.": null}'),
            (3, 1, '{"Forename": "A", "Notes": "x"}'),
            (3, 2, None), (3, 3, "broken"), (3, 4, "[1]"), (4, 1, '{"First Name": ""}'),
        ],
        "file_id int, row_ord int, cells string",
    )
    cells = cell_tags(rows.join(files.select("file_id", "slot"), "file_id"))
    return files, cells


def test_changes(spark):
    files, cells = frames(spark)
    got = schema_changes(file_schemas(cells, "file_id", synonym_column(SYNONYMS)), files, file="file_id", series="series_id", order=["file_ord"])
    assert sorted((r.file_id, r.field, r.change) for r in got.collect()) == [
        (2, "gross_annual_taxable_wages", "retyped"),
        (2, "pay_frequency", "added"),
        (3, "employee_first_name", "renamed"),
        (3, "gross_annual_taxable_wages", "removed"),
        (3, "pay_frequency", "removed"),
    ]


def test_unified(spark):
    _, cells = frames(spark)
    got = {(r.file_id, r.row_ord): r for r in unified(cells, ["file_id", "row_ord"], ["employee_first_name", "gross_annual_taxable_wages"], synonym_column(SYNONYMS), NUMBERS).collect()}
    assert got[1, 1].gross_annual_taxable_wages == 10.5 and got[1, 1].gross_annual_taxable_wages__number == 10.5
    assert got[2, 1].gross_annual_taxable_wages == 10.5 and got[2, 1].gross_annual_taxable_wages__text == "$10.50"
    assert got[1, 2].gross_annual_taxable_wages is None and got[3, 1].employee_first_name == "A"


def test_empty(spark):
    files, cells = frames(spark)
    got = schema_changes(file_schemas(cells.limit(0), "file_id", synonym_column(SYNONYMS)), files.limit(0), file="file_id", series="series_id", order=["file_ord"])
    assert got.count() == 0


def test_alternatives_and_unlisted_headers(spark):
    files = spark.createDataFrame([(1, 7, "census", 1), (2, 7, "census", 2), (3, 7, "census", 3)], "file_id int, series_id int, slot string, file_ord int")
    rows = spark.createDataFrame(
        [(1, 1, '{"Annual Salary": 10.5, "FirstName": "A", "Dependents": 1}'), (2, 1, '{"AnualSalary": true, "Annual Salery": [1], "Dependents": null}'), (2, 2, '{"Annual Salary": {"a": 1}, "Statement": 2}'), (3, 1, '{"Annual Salary": 3, "Dependents": "two"}')],
        "file_id int, row_ord int, cells string",
    )
    cells = cell_tags(rows.join(files.select("file_id", "slot"), "file_id"))
    assert {r.tag for r in cells.collect()} == {"number", "text", "boolean", "list", "object", None}
    schemas = file_schemas(cells, "file_id", inferred_column(SYNONYMS))
    assert {(r.file_id, r.field): r.headers for r in schemas.collect()}[2, "gross_annual_taxable_wages"] == ["annual salary", "annual salery"]
    got = new_alternatives(schemas, files, file="file_id", series="series_id", order=["file_ord"])
    assert sorted((r.file_id, r.field, r.alternative, r.before) for r in got.collect()) == [(2, "gross_annual_taxable_wages", "list", "number"), (2, "gross_annual_taxable_wages", "object", "number"), (3, "gross_annual_taxable_wages", "number", "list|object")]
    assert ("employee_first_name" in {r.field for r in schemas.where("file_id = 1").collect()}) and "state" not in {r.field for r in schemas.collect()}
