"""What every query of this subpackage reads, and where intermediate tables go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.sources.tables import kept as written
from glyphsieve.sources.tables import outside, scratch, shared_dir

__all__ = ["outside", "read", "scratch", "shared_dir", "small", "written"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, row_bytes: int, most_bytes: int) -> DataFrame:
    """The table itself, marked for a broadcast if its counted rows, at so many bytes each, keep within most_bytes. df must be cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df
