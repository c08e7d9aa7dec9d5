"""Exports and batch documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.functions.text import csv_cell_doubled

_BOM = "﻿"


def export_name(at: datetime) -> str:
    """Time-stamped name of an export."""
    return f"scraping-results-{at:%Y-%m-%dT%H-%M-%S}.csv"


def write_export(export: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a byte order mark at the head of each part file."""
    first, *rest = export.columns
    (
        export.toDF(_BOM + first, *rest)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def export_lines(export: DataFrame) -> DataFrame:
    """Comma-joined lines in the form whose inner quotes are doubled twice."""
    *cells, status = export.columns
    return export.select(
        F.concat_ws(",", *(csv_cell_doubled(F.col(f"`{c}`")) for c in cells), status).alias("value")
    )


def write_batch_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Batch documents as JSON, one folder per batch."""
    documents.write.mode(mode).partitionBy("batch_id").json(path)


def write_document_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents given as ``batch_id, seq, value``, one folder per batch.

    The files of a folder, one after the other by name, are the batch's JSON document. Lines
    are dealt out by batch and place, so a large batch is written by many tasks, each a
    piece of it, and a task holds one line at a time.
    """
    dealt = lines.repartitionByRange("batch_id", "seq").sortWithinPartitions("batch_id", "seq")
    dealt.select("batch_id", "value").write.mode(mode).partitionBy("batch_id").text(path)


def write_jobs(jobs: DataFrame, path: str, mode: str = "append") -> None:
    """Jobs as Parquet, one folder per batch, so that a batch is read without the others.

    ``mode="overwrite"`` replaces the batches that ``jobs`` holds and leaves the others.
    """
    jobs.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
