"""Identifiers as people and programs write them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_id(col: Column | str) -> Column:
    """The id in a form in which equal ids are equal strings: case, blanks, punctuation, leading zeros and a decimal
    tail of zeros do not count. Null for null, and for an id with no digit 1-9, which refers to nothing."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(F.trim(c.cast("string")), r"\.0+\s*$", "")
    c = F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")
    c = F.regexp_replace(c, "^0+", "")
    return F.when(c.rlike("[1-9]"), c)
