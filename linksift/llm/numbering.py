"""Gapless numbers within groups, also where one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_ROWS = 2_000


def number_within(
    df: DataFrame, group: str, order: list[str], name: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each value of ``group``.

    A group is cut into slices of about ``slice_rows`` rows by a hash of ``order``; rows are
    numbered slice by slice and each slice starts where the ones before it end. ``df`` should be
    a settled table, since it is read for the counts and again for the rows. Rows equal in
    ``order`` may swap numbers. Meant for a bounded number of groups (shards, lengths): their
    counts are broadcast.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / slice_rows).alias("_slices"))
    key: Column = F.pmod(F.xxhash64(*order), F.col("_slices"))
    sliced = df.join(F.broadcast(sizes.withColumnRenamed(group, "_group")), F.col(group).eqNullSafe(F.col("_group")))
    sliced = sliced.withColumn("_slice", key).drop("_group", "_slices")
    counts = sliced.groupBy(group, "_slice").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_group"),
        F.col("_slice").alias("_of"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    within = W.partitionBy(group, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_at", F.row_number().over(within).cast("long") - 1)
    return (
        numbered.join(
            starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_of"))
        )
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_group", "_of", "_start", "_at", "_slice")
    )
