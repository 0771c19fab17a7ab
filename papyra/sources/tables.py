"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.sizes import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``, wherever the folder is: only Spark's reader gets the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def place() -> tuple[Column, Column]:
    """Where a row stands in a table just read: its file, and its number there; SQL that leaves a tie open takes the first."""
    return F.col("_metadata.file_path"), F.col("_metadata.row_index")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The table ``documents``, for work on whole texts: spread over all cores if it is only a few files."""
    return spread(table(spark, folder, "documents"))
