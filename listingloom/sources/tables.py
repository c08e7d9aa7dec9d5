"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly over as many tasks as a shuffle has.

    For short rows that are long work: a scan is split by its bytes, so all of them can
    be one task's."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
