"""Pages of documents and uploads: tables of people, plain lines, scores, blocks, header rows, best files, unread pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.functions import text as t
from tieout.functions.headers import SYNONYMS
from tieout.operators import geometry, tables
from tieout.operators.drift import cell_tags, file_schemas, synonym_column
from tieout.sources import registers
from tieout.sources.tables import table
from tieout.streaming import store

#: Headings of the tables of people on pages.
ALIASES = {"gross": r"\bgross\b", "federal": r"\bfed", "net": r"\bnet\b", "fee": r"\bfee\b", "premium": r"\bpremium\b", "savings": r"\bsavings?\b", "allotment": r"\ballotment\b", "salary": r"\bsalary\b"}


def _words(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return geometry.words_of_text(table(spark, d, "documents").where(where).select("doc_id", "text"))


def people_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every page of every document that reads as a table of people, line by line. A page whose text doesn't have the
    headings of a header's least number of fields can be none, so its words need not be placed."""
    headed = " + ".join(f"cast(lower(text) rlike '{p}' as int)" for p in ALIASES.values()).replace("\\", "\\\\")
    return tables.read_tables(_words(spark, d, f"{headed} >= {tables.FIELDS}"), ALIASES)


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """The words of statement pages laid out again as lines, columns apart."""
    at = tables.grid_lines(_words(spark, d, "kind = 'statement_page'"))
    return at.select("doc", "page", F.row_number().over(W.partitionBy("doc", "page").orderBy("line")).alias("line"), F.md5("text").alias("digest"), F.length("text").alias("n"))


def page_scores(spark: SparkSession, d: str) -> DataFrame:
    """How much each page of every document looks like lines, and like language and money."""
    return tables.page_scores(_words(spark, d))


def page_people(spark: SparkSession, d: str) -> DataFrame:
    """People and net pay of statement pages read as scans: blocks end with the line of net pay."""
    w = _words(spark, d, "kind = 'statement_page'")
    deep = w.groupBy("doc", "page").agg((F.max("y1") + 12).alias("_deep"))
    tokens = w.join(deep, ["doc", "page"]).select("doc", "page", F.col("text").alias("t"), F.col("x0").alias("x"), F.round(1 - F.col("y0") / F.col("_deep"), 6).alias("y"))
    return tables.block_people(tables.blocks(tokens, end="NET", keep="NET", near=0.0, reach=0.000001), net="NET")


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """Uploads as sheets: a title, the headers of the first row, then its cells."""
    rows = table(spark, d, "upload_row").select("file_id", "row_ord", "cells")
    first = rows.groupBy("file_id").agg(F.min_by("cells", "row_ord").alias("cells"))
    heads = F.json_object_keys("cells")
    values = F.transform(heads, lambda k: F.lit(None).cast("string"))
    title = first.select("file_id", F.lit(0).alias("row_ord"), F.array(F.lit("Upload")).alias("cells"))
    head = first.select("file_id", F.lit(1).alias("row_ord"), heads.alias("cells"))
    return title.unionByName(head).unionByName(first.select("file_id", F.lit(2).alias("row_ord"), values.alias("cells")))


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    """The row of each upload that its headers stand in; 0 where no row has four filled cells."""
    return registers.header_row(_sheets(spark, d), ["file_id"])


def best_files(spark: SparkSession, d: str) -> DataFrame:
    """Of every series the file that most wanted fields map to, five more for a hint in its name; of equals the first."""
    files = table(spark, d, "upload_file").where("series_id is not null").select("file_id", "series_id", "slot", "file_name", "file_ord")
    cells = cell_tags(table(spark, d, "upload_row").select("file_id", "cells").join(files.select("file_id", "slot"), "file_id"))
    n = file_schemas(cells, "file_id", synonym_column(SYNONYMS)).groupBy("file_id").agg(F.count("*").alias("n"))
    scored = files.join(n, "file_id").withColumn("at", F.struct("file_ord", "file_id"))
    return registers.best_sheet(scored, ["series_id"], "n", "file_name", "final", "at").select("series_id", "file_id", "n")


def unread_pages(spark: SparkSession, d: str) -> DataFrame:
    """Per source, different pages that came in a later half of the time and that the store of the first half hasn't."""
    p = table(spark, d, "documents").where("text is not null and ingested_at is not null").select("source", "ingested_at", t.key_of(F.col("text")).alias("page_key"))
    span = p.agg(F.unix_micros(F.min(F.col("ingested_at").cast("timestamp"))).alias("a"), F.unix_micros(F.max(F.col("ingested_at").cast("timestamp"))).alias("b")).first()
    at = p.withColumn("_late", F.unix_micros(F.col("ingested_at").cast("timestamp")) > F.lit(((span.a or 0) + (span.b or 0)) // 2))
    late = at.where("_late").select("source", "page_key").distinct()
    return store.new_pages(late, at.where("not _late")).groupBy("source").agg(F.count("*").alias("n"))


QUERIES = {"people_tables": people_tables, "page_lines": page_lines, "page_scores": page_scores, "page_people": page_people, "header_rows": header_rows, "best_files": best_files, "unread_pages": unread_pages}

_PAGES = "p as (select doc_id as doc, unnest(range(0, len(a))) as page, unnest(a) as x from (select doc_id, string_split(text, chr(12)) as a from documents where text is not null and {w})), l as (select doc, page, unnest(range(0, len(a))) as n, unnest(a) as line from (select doc, page, regexp_split_to_array(x, '\\r?\\n') as a from p))"
SQL = {
    "page_scores": "with " + _PAGES.format(w="true") + r""", k as (select doc, page, n, regexp_extract_all(line, '[^\s]+') as w from l), r as (select * from k where len(w) > 0),
w as (select doc, page, unnest(w) as w from r), s as (select doc, page, list(len(w) order by len(w)) as c, count(*) filter (len(w) >= 4) as many, count(*) as rows from r group by all),
q as (select doc, page, count(*) filter (regexp_full_match(w, '[A-Za-z][A-Za-z''\-.]{2,}|[\d,]+\.\d{2}')) / count(*) + 0.001::double * sum(length(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))) as plausible from w group by all)
select doc, page::int as page, round(c[len(c) // 2 + 1] + 4.0::double * many / rows, 6) as lines, round(plausible, 6) as plausible from s join q using (doc, page)""",
    "page_lines": "with " + _PAGES.format(w="kind = 'statement_page'") + r""", t as (select doc, page, n, regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s{3,}', chr(1), 'g'), '\s+', ' ', 'g') as x from l where regexp_matches(line, '[^\s]'))
select doc, page::int as page, row_number() over (partition by doc, page order by n)::int as line, md5(replace(x, chr(1), ' | ')) as digest, length(replace(x, chr(1), ' | '))::int as n from t""",
    "header_rows": "with f as (select file_id, arg_min(cells, row_ord) as cells from upload_row group by all) select file_id, case when len(list_filter(json_keys(cells), lambda h: trim(h) <> '')) >= 4 then 1 else 0 end as header from f",
    "unread_pages": "with p as (select source, ingested_at, sha256(text) as k from documents where text is not null and ingested_at is not null), h as (select (epoch_us(min(ingested_at)::timestamp) + epoch_us(max(ingested_at)::timestamp)) // 2 as half from p), l as (select distinct source, k from p, h where epoch_us(ingested_at::timestamp) > half) select source, count(*) as n from l where k not in (select k from p, h where epoch_us(ingested_at::timestamp) <= half) group by all",
}
