"""The page store as streams: readings kept once, corrections appended, effective values on demand. An extension."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.operators.ordered import effective


def append_readings(stream: DataFrame, path: str, checkpoint: str, late: str = "1 hour"):
    """Starts a query that appends each page reading once: repeats of a page_key within ``late`` of event time ``saved``
    are dropped, with state that ends with the watermark. Runs over what is there and stops."""
    once = stream.withWatermark("saved", late).dropDuplicatesWithinWatermark(["page_key"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_totals(stream: DataFrame, time: str, value: str, by: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, by, n, total) by tumbling window; rows later than ``late`` are dropped once their window has ended."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def append_corrections(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Corrections are appended, never changed; the writer's commit makes each call whole or nothing."""
    rows.write.mode("append").parquet(path)


def effective_values(spark: SparkSession, readings: str, corrections: str) -> DataFrame:
    """Stored values with their latest corrections."""
    return effective(spark.read.parquet(readings), spark.read.parquet(corrections), ["page_key", "field"], "value", ["at", "seq"])


def new_pages(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """The pages that the store hasn't read: expensive reading is for these alone."""
    return pages.join(stored.select("page_key").distinct(), "page_key", "left_anti")
