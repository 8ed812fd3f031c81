"""Running totals within many groups, of which any may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linksift.llm.tables import settle

SLICE_ROWS = 2_000
#: A side of a join is broadcast only up to so many rows (of a few numbers each).
BROADCAST_ROWS = 200_000
PLACES = 1 << 32


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table, marked for broadcasting if it has been counted to be short."""
    return F.broadcast(df) if df.count() <= rows else df


def place_of(*columns: Column | str) -> Column:
    """32 bits of a hash, as a place for ``running_within``."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(PLACES - 1))


def running_within(
    df: DataFrame, keys: list[str], place: Column, order: list[str], name: str, weight: Column | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add ``name``: the total weight of the earlier rows of the same keys, in the order (place, *order).

    ``df`` must be settled and its keys not null; ``place`` lies in [0, 2^32), spread evenly. A group
    of more than ``slice_rows`` rows is cut into slices along its places; each slice is added up in a
    task of its own and starts where the ones before it end. Only the sizes of such groups meet the
    other rows. Without ``weight`` rows are numbered 0, 1, 2, ...
    """
    weighed = df.withColumns({"_place": place, "_weight": F.lit(1) if weight is None else weight})
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_rows)
    sizes = settle(sizes.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.ceil(F.col("_n") / slice_rows).alias("_slices")), "sizes")
    same = [F.col(k) == F.col(f"_of_{k}") for k in keys]
    sliced = weighed.join(small(sizes), same, "left").drop(*(f"_of_{k}" for k in keys))
    sliced = sliced.withColumn("_slice", F.coalesce(F.shiftright(F.col("_place") * F.col("_slices"), 32), F.lit(0)))
    totals = sliced.where("_slices is not null").groupBy(*keys, "_slice").agg(F.sum("_weight").alias("_total"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_slice").alias("_at"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    starts = small(settle(starts, "starts"))
    within = W.partitionBy(*keys, "_slice").orderBy("_place", *order).rowsBetween(W.unboundedPreceding, -1)
    summed = sliced.withColumn("_within", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    found = summed.join(starts, [*same, F.col("_slice") == F.col("_at")], "left")
    return found.select(*df.columns, (F.col("_within") + F.coalesce("_start", F.lit(0))).cast("long").alias(name))


#: Words of 64 bits in a filter of keys: eight keys a word, within these bounds.
FILTER_WORDS = (1 << 10, 1 << 20)


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits, words): a bitmap of the hashes of settled keys, at most ``FILTER_WORDS`` rows."""
    least, most = FILTER_WORDS
    words = min(most, max(least, 1 << (keys.count() // 8).bit_length()))
    word, bit = _filter_place(key, words)
    marked = keys.select(word.alias("word"), bit.alias("bit"))
    held = marked.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return settle(held.withColumn("words", F.lit(words)), "filter")


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Add ``_maybe``: false only for rows whose key is not in a ``key_filter``.

    Rows that cannot find a partner need not be shuffled to learn that; the others are joined exactly.
    """
    told = keys.select("words").first()
    if told is None:
        return df.withColumn("_maybe", F.lit(False))
    word, bit = _filter_place(key, told["words"])
    placed = df.withColumns({"_word": word, "_bit": bit})
    met = placed.join(F.broadcast(keys.select(F.col("word").alias("_word"), "bits")), "_word", "left")
    held = F.expr("(shiftright(bits, _bit) & 1) = 1")
    return met.withColumn("_maybe", F.coalesce(held, F.lit(False))).drop("_word", "_bit", "bits")


def _filter_place(key: str, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return h.bitwiseAND(F.lit(words - 1)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")
