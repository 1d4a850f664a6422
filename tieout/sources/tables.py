"""The Parquet tables of a data directory."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``, read lazily so filters and column selections reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
