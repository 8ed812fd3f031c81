"""Counts and exact column statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linksift.operators.selection import values_at
from linksift.session import settled

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def shape(df: DataFrame) -> DataFrame:
    """A1: row and column counts."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """A2: rows per class; a hot class is summed before the shuffle."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def _shown(stats: DataFrame, digits: int | None) -> DataFrame:
    columns = ["mean", "std", "min", *QUARTILES, "max"]
    rounded = [F.col(c) if digits is None else F.round(c, digits).alias(c) for c in columns]
    return stats.select("feature", "count", *rounded)


def describe(
    df: DataFrame,
    columns: list[str],
    digits: int | None = 2,
    last_rows: int | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """A3: count, mean, std, min, quartiles (linear interpolation), max per numeric column.

    A column of nulls has count 0 and nulls; nulls and NaN do not count. Exact: one aggregate, and the
    values at the quartiles' ranks of all columns narrowed together (``selection``), so that what is
    shuffled depends neither on the rows nor on their distinct values. The columns are written once.
    With ``accuracy`` set, quartiles are approximate (1/accuracy in rank) from one aggregate,
    for wide tables of high-cardinality doubles.
    """
    if accuracy is not None:
        values = (
            df.select(*[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot([], columns, "feature", "value")
            .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        )
        quartiles = F.percentile_approx("value", list(QUARTILES.values()), accuracy)
        return _shown(
            values.groupBy("feature")
            .agg(
                F.count("*").alias("count"),
                F.avg("value").alias("mean"),
                F.stddev_samp("value").alias("std"),
                F.min("value").alias("min"),
                quartiles.alias("_q"),
                F.max("value").alias("max"),
            )
            .withColumns({name: F.col("_q")[i] for i, name in enumerate(QUARTILES)}),
            digits,
        )
    names = [f"v{i}" for i in range(len(columns))]
    numbers = [F.col(c).cast("double") for c in columns]
    wide = settled(df.select(*[F.when(~F.isnan(c), c).alias(name) for c, name in zip(numbers, names)]))
    kinds = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    told = wide.agg(*[kind(name).alias(f"{stat}_{name}") for name in names for stat, kind in kinds.items()]).first()
    places = {name: {q: (told[f"count_{name}"] - 1) * share for q, share in QUARTILES.items()} for name in names}
    sides = lambda at: (math.floor(at), math.ceil(at))
    ranks = {name: [r for at in places[name].values() for r in sides(at)] if told[f"count_{name}"] else [] for name in names}
    found = values_at(wide, ranks, last_rows)
    rows = []
    for column, name in zip(columns, names):
        quartiles = []
        for at in places[name].values():
            low, high = (found[name].get(r) for r in sides(at))
            quartiles.append(None if low is None else low + (high - low) * (at - math.floor(at)))
        rows.append((column, *(told[f"{stat}_{name}"] for stat in ("count", "mean", "std", "min")), *quartiles, told[f"max_{name}"]))
    numeric = ", ".join(f"{c} double" for c in ("mean", "std", "min", *QUARTILES, "max"))
    return _shown(df.sparkSession.createDataFrame(rows, f"feature string, count long, {numeric}"), digits)


def head(df: DataFrame, n: int = 3, order: str = "id") -> DataFrame:
    """The first rows in a stated order (a top-k, not a sort)."""
    return df.orderBy(order).limit(n)


def first_examples(df: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """The URL with the lowest id of each class."""
    return df.groupBy(label).agg(F.min_by("url", id_col).alias("url"))
