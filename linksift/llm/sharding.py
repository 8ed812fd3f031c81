"""Shards of near equal bytes by a histogram sort over a hashed key.

Rows are ordered by a 60-bit hash of their text, then by doc_id, so copies of a text stand side by
side. The cut between two shards is searched by counting the exact bytes below candidate keys:
every pass probes all open cuts at once with ``PROBES`` keys each, spaced evenly over the range that
must hold the cut, until a probe comes within ``tolerance`` of the wanted bytes. If the range has
shrunk to a single key, a group of copies lies across the cut; the search goes on over doc_id
within the group, and where rows are equal in both, over a number of the row. Then one exchange deals
out the rows.

Null texts have the size 1 and count as empty; null doc_ids come first in their group; rows equal
in text and doc_id are told apart by a number each, so they spread over shards like any others and may
swap places. Texts of any length are one row. An empty table gives no rows. Carried columns travel in
the struct ``row``, so that no names clash.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linksift.llm.numbering import number_within
from linksift.llm.tables import settle

PROBES = 1024
KEY_BITS = 60
TOLERANCE = 0.001
NULL_ID = -(1 << 63)
LAST_ID = 1 << 63
WIDE = "decimal(20,0)"


#: What orders the rows, and the least and one past the last value of each.
LEVELS = ("_key", "_id", "_no")
BOUNDS = ((0, 1 << KEY_BITS), (NULL_ID, LAST_ID), (0, LAST_ID))


@dataclass(frozen=True)
class Cut:
    """Rows whose (key, id, number) lie below ``found`` lie before the cut; open while it is None.

    ``low`` and ``high`` bound the first of the three that is not yet fixed by ``prefix``.
    """

    target: float
    low: int
    high: int
    below: int = 0
    prefix: tuple[int, ...] = ()
    found: tuple[int, int, int] | None = None


def keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` in row, size (UTF-8 bytes and one), text_crc32, _key, _id and _no.

    ``_no`` tells equal rows apart; it holds once the table is settled.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.struct(*columns).alias("row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long").alias("_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.monotonically_increasing_id().alias("_no"),
    )


def _wide(number: int) -> Column:
    return F.lit(Decimal(number)).cast(WIDE)


def _step(cut: Cut) -> int:
    return max(1, -(-(cut.high - cut.low) // PROBES))


def _probe(rows: DataFrame, cuts: list[Cut]) -> dict[int, dict[int, int]]:
    """For each open cut the bytes in each of its probed intervals, from one pass over the rows."""
    hits = []
    for at, cut in enumerate(cuts):
        # As decimals, since two ids may lie further apart than a long can tell.
        value = F.col(LEVELS[len(cut.prefix)]).cast(WIDE)
        inside = (value >= _wide(cut.low)) & (value < _wide(cut.high))
        for level, fixed in zip(LEVELS, cut.prefix):
            inside = inside & (F.col(level) == F.lit(fixed))
        slot = F.floor((value - _wide(cut.low)) / _wide(_step(cut))).cast("int")
        hits.append(F.when(inside, F.struct(F.lit(at).alias("cut"), slot.alias("slot"))))
    found = (
        rows.select("size", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        .groupBy("hit.cut", "hit.slot")
        .agg(F.sum("size").alias("bytes"))
        .collect()
    )
    out: dict[int, dict[int, int]] = {}
    for row in found:
        out.setdefault(row["cut"], {})[row["slot"]] = row["bytes"]
    return out


def _narrow(cut: Cut, bytes_in: dict[int, int], slack: float) -> Cut:
    """The cut after one pass: found, or open over one of the probed intervals."""
    step, below = _step(cut), cut.below
    edges = [(cut.low, below)]
    holder = None
    for slot in sorted(bytes_in):
        begins = cut.low + slot * step
        if holder is None and below + bytes_in[slot] >= cut.target:
            holder = (begins, min(begins + step, cut.high), below)
        edges.append((begins, below))
        below += bytes_in[slot]
        edges.append((min(begins + step, cut.high), below))
    place, near = min(edges, key=lambda e: (abs(e[1] - cut.target), e[0]))
    last = holder is None or (step == 1 and len(cut.prefix) == len(LEVELS) - 1)
    if last or abs(near - cut.target) <= slack:
        return replace(cut, found=_first((*cut.prefix, place)))
    if step == 1:  # one key, or one id of it: a group of copies across the cut
        prefix = (*cut.prefix, holder[0])
        low, high = BOUNDS[len(prefix)]
        return replace(cut, prefix=prefix, low=low, high=high, below=holder[2])
    return replace(cut, low=holder[0], high=holder[1], below=holder[2])


def _first(place: tuple[int, ...]) -> tuple[int, int, int]:
    """The least (key, id, number) that does not lie before a place, which may end its level."""
    while len(place) > 1 and place[-1] >= BOUNDS[len(place) - 1][1]:
        place = (*place[:-2], place[-2] + 1)
    return (*place, *(low for low, _ in BOUNDS[len(place) :]))


def find_cuts(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """The first (key, id, number) of each shard but the first, for a settled table of keyed rows."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    cuts = [Cut(total * s / shards, 0, 1 << KEY_BITS) for s in range(1, shards)]
    while any(c.found is None for c in cuts) and total:
        todo = [c for c in cuts if c.found is None]
        counted = _probe(rows, todo)
        done = {c: _narrow(c, counted.get(at, {}), slack) for at, c in enumerate(todo)}
        cuts = [done.get(c, c) for c in cuts]
    return [c.found for c in cuts if c.found]


def shard_of(cuts: list[tuple[int, int, int]]) -> Column:
    """How many cuts lie at or before the row's (key, id, number)."""
    key, own, no = (F.col(level) for level in LEVELS)
    beyond = [
        ((key > F.lit(k)) | ((key == F.lit(k)) & ((own > F.lit(i)) | ((own == F.lit(i)) & (no >= F.lit(n)))))).cast("int")
        for k, i, n in cuts
    ]
    return reduce(lambda a, b: a + b, beyond, F.lit(0))


def shard_documents(
    docs: DataFrame, columns: list[str], shards: int = 8, tolerance: float = TOLERANCE
) -> DataFrame:
    """row (the carried columns), size, text_crc32, shard and slot (gapless from 0 in a shard)."""
    rows = settle(keyed(docs, columns), "keyed")
    dealt = rows.withColumn("shard", shard_of(find_cuts(rows, shards, tolerance)))
    numbered = number_within(dealt, "shard", list(LEVELS), "slot")
    return numbered.select("row", "size", "text_crc32", "shard", "slot")
