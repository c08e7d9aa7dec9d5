"""Job tables laid out for the reads that batches make.

Jobs lie in a folder for each batch and, inside it, in buckets by job, sorted; results in as
many buckets by job. A batch is read without the others, and jobs meet their results
bucket by bucket, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listingloom.session import scratch_folder

BUCKETS = 64


def _stored(df: DataFrame, table: str, path: str | None, buckets: int, *by: str) -> DataFrame:
    spark = df.sparkSession
    # one file for a bucket of a folder: rows are dealt out as the buckets are
    writer = df.repartition(buckets, "job_id").write.bucketBy(buckets, "job_id").sortBy("job_id")
    if by:
        writer = writer.partitionBy(*by)
    writer.option("path", path or scratch_folder(spark, table)).saveAsTable(table)
    return spark.table(table)


def store_jobs(jobs: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Write jobs as a table, partitioned by batch and bucketed by job, and return it.

    Without ``path`` it lies in the shared folder until the driver ends.
    """
    return _stored(jobs, table, path, buckets, "batch_id")


def store_results(
    results: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Write results as a table bucketed like the jobs they belong to, and return it."""
    return _stored(results, table, path, buckets)


def drop_tables(spark: SparkSession, *tables: str) -> None:
    """Forget stored tables; their files stay where they were asked to be."""
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
