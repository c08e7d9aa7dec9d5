"""Positions inside large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.session import checkpoint_dir


def position_in_group(
    df: DataFrame, group: list[str], order: list[Column], name: str, start: int = 0
) -> DataFrame:
    """Add each row's position inside its group under a total order.

    ``row_number`` alone would sort a whole group in one task, and one group may
    hold a large share of the table. Here the rows are range-partitioned by group
    and order, so a large group spreads over many tasks; a row's position is its
    position inside its slice plus the sizes of the slices before it. ``order``
    must be total inside a group, and must not be repeated in ``df``'s columns.
    """
    checkpoint_dir(df.sparkSession)
    keys = [F.col(column) for column in group]
    # The slice a row falls into depends on sampled range bounds. They are drawn
    # once and written down, so both uses below see the same slices.
    sliced = (
        df.repartitionByRange(*keys, *order)
        .withColumn("_slice", F.spark_partition_id())
        .checkpoint()
    )
    sizes = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per group and slice is left here
    offsets = sizes.select(
        *(F.col(column).alias(f"_group_{column}") for column in group),
        F.col("_slice").alias("_of_slice"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
    )
    same = F.col("_slice") == F.col("_of_slice")
    for column in group:
        # rows without a group are a group as well
        same = same & F.col(column).eqNullSafe(F.col(f"_group_{column}"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_row", F.row_number().over(inside))
        .join(offsets, same)
        .withColumn(name, F.col("_row") + F.col("_offset") - 1 + start)
        .drop("_slice", "_row", "_offset", "_of_slice", *(f"_group_{c}" for c in group))
    )
