"""Running totals along a global order without putting a key's rows into one task.

A plain ``sum() over (partition by key order by x)`` sends all rows of a key to one task. Here
the order column is cut into ranges that hold about equally many rows, each (key, range) pair
is summed on its own, and the few range totals give the offset of each range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linksift.operators.selection import values_at

# A range is cut to about this many rows, so that it sorts within one task's memory.
ROWS_PER_RANGE = 1_000_000


def cut_points(df: DataFrame, order: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Values that cut the rows of a settled table into ranges of equal size, at exact ranks.

    The driver holds one number per range, so 8 MB for 1e12 rows; there is no limit on their number.
    """
    n = df.count()
    ranges = -(-n // rows_per_range)
    if ranges < 2:
        return []
    found = values_at(df, {order: [n * i // ranges for i in range(1, ranges)]})[order]
    return sorted({value for value in found.values() if math.isfinite(value)})


def with_range(df: DataFrame, order: str, cuts: list[float], out: str = "_range") -> DataFrame:
    """Number the range of each value; the cuts are literals, so a retry gives the same ranges."""
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=order, outputCol=out).transform(df)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: list[str],
    cuts: list[float],
    ascending: bool = True,
) -> DataFrame:
    """Add ``before_x`` (total of the rows ahead) and ``all_x`` (total of the key) for each sum.

    ``df`` holds one row per (keys, order) and no null or NaN in ``order``. Also adds
    ``_next``: the sums of the next row in the order, as a struct, null on the last row.
    """
    along = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    edge = F.min_by if ascending else F.max_by
    ranged = with_range(df, order, cuts)
    group = [*keys, "_range"]

    per_range = ranged.groupBy(*group).agg(
        *[F.sum(s).alias(f"_range_{s}") for s in sums],
        # One number each: a struct here would turn the hash aggregate into a sorting one.
        *[edge(s, order).alias(f"_first_{s}") for s in sums],
    )
    by_key = Window.partitionBy(*keys).orderBy(along("_range"))
    ahead = by_key.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *group,
        *[F.coalesce(F.sum(f"_range_{s}").over(ahead), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_range_{s}").over(Window.partitionBy(*keys)).alias(f"all_{s}") for s in sums],
        F.lead(F.struct(*[F.col(f"_first_{s}").alias(s) for s in sums]))
        .over(by_key)
        .alias("_next_first"),
    )
    in_range = Window.partitionBy(*group).orderBy(along(order))
    so_far = in_range.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumns(
            {
                **{f"_in_{s}": F.coalesce(F.sum(s).over(so_far), F.lit(0)) for s in sums},
                "_next_in": F.lead(F.struct(*sums)).over(in_range),
            }
        )
        .join(offsets, group)
        .select(
            *df.columns,
            *[(F.col(f"_off_{s}") + F.col(f"_in_{s}")).alias(f"before_{s}") for s in sums],
            *[f"all_{s}" for s in sums],
            F.coalesce("_next_in", "_next_first").alias("_next"),
        )
    )
