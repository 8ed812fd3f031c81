"""The values at wanted ranks of many columns at once, exactly and without sorting the table.

A double has an order-preserving 64-bit key. The key at a rank is narrowed down from the top: count
the rows per prefix, keep only the prefixes that hold wanted ranks, count their longer prefixes, and
so on. All ranks of all columns advance in the same pass. Counts are added up in the tasks before the
shuffle, so neither repeated nor distinct values move; at most ``1 << STEP`` counts per open prefix do.
Once the open prefixes hold few rows, their whole keys are counted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 12
WIDTH = 64
#: Rows in open prefixes below which whole keys are counted.
LAST_ROWS = 200_000
#: A task adds up its counts whenever it holds so many.
HELD = 1 << 20


def keys_of(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys in the order of the doubles; both zeros have one key."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def values_of(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.int64)
    return (keys ^ ((keys >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def _counted(df: DataFrame, columns: list[str], open_prefixes: list[np.ndarray] | None, bits: int, step: int) -> DataFrame:
    """(col, up, prefix, n): rows per prefix of ``bits`` bits below the open prefixes."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        every, n = np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
        found, where = np.unique(every, return_inverse=True)
        return found, np.bincount(where, n, len(found)).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for c in range(len(columns)):
                values = np.asarray(batch.column(c).drop_null())
                prefix = keys_of(values[~np.isnan(values)]) >> np.int64(WIDTH - bits)
                if open_prefixes is not None:
                    wanted, up = open_prefixes[c], prefix >> np.int64(step)
                    at = np.minimum(np.searchsorted(wanted, up), max(0, len(wanted) - 1))
                    prefix = prefix[wanted[at] == up] if len(wanted) else prefix[:0]
                if len(prefix):
                    one = np.unique(prefix, return_counts=True)
                    held.setdefault(c, []).append(one)
                    size += len(one[0])
            if size > HELD:
                held = {c: [merged(parts)] for c, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values()) // 2
        for c, parts in held.items():
            prefix, n = merged(parts)
            up = np.zeros_like(prefix) if open_prefixes is None else prefix >> np.int64(step)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c)), pa.array(up), pa.array(prefix), pa.array(n)], ["col", "up", "prefix", "n"])

    read = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return read.mapInArrow(work, "col long, up long, prefix long, n long").groupBy("col", "up", "prefix").agg(F.sum("n").alias("n"))


def _located(wanted: dict[tuple[int, int], list[tuple[int, int]]]):
    """Finds where the ranks of one open prefix lie among its longer prefixes."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("prefix", ignore_index=True)
        asked = wanted.get((int(group["col"].iloc[0]), int(group["up"].iloc[0])), [])
        inside, rank = (np.array([a[i] for a in asked], np.int64) for i in (0, 1))
        counts = group["n"].to_numpy()
        ends = counts.cumsum()
        at = np.searchsorted(ends, inside, side="right")
        found = at < len(ends)
        at, inside, rank = at[found], inside[found], rank[found]
        return pd.DataFrame(
            {"col": group["col"].iloc[0], "prefix": group["prefix"].to_numpy()[at], "inside": inside - (ends[at] - counts[at]), "rank": rank, "n": counts[at]}
        )

    return work


def values_at(df: DataFrame, ranks: dict[str, list[int]], last_rows: int | None = None) -> dict[str, dict[int, float]]:
    """For each column the value at each 0-based rank, ascending; nulls and NaN do not count.

    ``df`` is read once per narrowing, about three times and at most six; settle a derived table first. Ranks beyond a column's values
    are left out of the result.
    """
    last_rows = LAST_ROWS if last_rows is None else last_rows
    columns = list(ranks)
    # (col, prefix) -> the wanted ranks inside it, as (rank inside, rank).
    wanted = {(c, 0): sorted((r, r) for r in set(ranks[name])) for c, name in enumerate(columns) if ranks[name]}
    bits, step, root = STEP, STEP, True
    while wanted:
        prefixes = None if root else [np.array(sorted(p for k, p in wanted if k == c), np.int64) for c in range(len(columns))]

        counts = _counted(df, columns, prefixes, bits, step)
        placed = counts.groupBy("col", "up").applyInPandas(_located(wanted), "col long, prefix long, inside long, rank long, n long").toPandas()
        if bits == WIDTH:
            out = {name: {} for name in columns}
            for c, key, rank in zip(placed["col"], placed["prefix"], placed["rank"]):
                out[columns[c]][int(rank)] = float(values_of(np.array([key]))[0])
            return out
        wanted = {}
        for c, p, inside, rank in zip(placed["col"], placed["prefix"], placed["inside"], placed["rank"]):
            wanted.setdefault((int(c), int(p)), []).append((int(inside), int(rank)))
        left = int(placed.drop_duplicates(["col", "prefix"])["n"].sum())
        step = WIDTH - bits if left <= last_rows else min(STEP, WIDTH - bits)
        bits, root = bits + step, False
    return {name: {} for name in columns}
