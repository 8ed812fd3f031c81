"""Repeatable randomness: every draw is a function of (seed, tag, id), never of the partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def row_hash(seed: int, *parts: Column | str) -> Column:
    """128-bit hex digest of the seed and the row's own key."""
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def draw(digest: Column, slot: int) -> Column:
    """One of the four 32-bit numbers (slot 0..3) in a digest, as a bigint."""
    return F.conv(F.substring(digest, 8 * slot + 1, 8), 16, 10).cast("bigint")


def pick(words: list[str], number: Column) -> Column:
    """A word chosen by a draw."""
    return F.get(F.lit(words), (number % len(words)).cast("int"))


def pick_from(words: Column, size: int, number: Column) -> Column:
    """A word of an array column of known size chosen by a draw."""
    return F.get(words, (number % size).cast("int"))


def between(low: int, high: int, number: Column) -> Column:
    """A whole number in [low, high] chosen by a draw."""
    return number % (high - low + 1) + low


def happens(rate: float, number: Column) -> Column:
    """True with the given rate."""
    return number < int(rate * DRAW_RANGE)
