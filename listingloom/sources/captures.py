"""Stored page captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures kept as Parquet with at least ``url`` and ``html``."""
    return spark.read.parquet(path)


def load_capture_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Captures kept as one HTML file each: ``url`` is the file's path."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.htm*")
        .load(path)
    )
    return files.select(F.col("path").alias("url"), F.decode("content", encoding).alias("html"))
