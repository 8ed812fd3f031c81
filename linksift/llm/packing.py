"""Packing documents into training sequences by minimum bin slack.

Each document is encoded, closed with an end id and cut into pieces: as many full windows as it
holds, and the rest. Which pieces share a window depends on their lengths alone, so the plan is
made from the histogram of lengths (at most ``capacity`` entries, whatever the corpus): a window
takes the longest length left and then the multiset of other lengths whose sum comes closest to
the room left, found by a bitset subset-sum; the window is used as often as the counts allow.
If that leaves more windows than the sum of lengths needs, plans that allow a window a little more
slack where longer pieces cause it are tried too. Pieces then get a number among those of their
length, and the number finds window and place.

A null or empty text is one piece with the end id; a text of any length is encoded whole. Rows that
share a doc_id, and rows that repeat another, are documents of their own. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linksift.llm.numbering import number_within
from linksift.llm.tables import settle
from linksift.llm.tokens import Encoder

CAPACITY = 4096
#: Slack that a window may have beyond the least, as shares of the capacity; each gives a plan.
ALLOWANCES = (0.0, 0.01, 0.02, 0.03, 0.05)
BATCH_BYTES = 4 << 20


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, added_tokens: bool = False
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): pieces with their ids as little-endian 32-bit."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, held = Encoder(tokenizer, added_tokens), [], 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                data = encoder.encode(text.as_py()) + end
                for at in range(0, len(data), 4 * capacity):
                    part = data[at : at + 4 * capacity]
                    rows.append((key.as_py(), at // 4, len(part) // 4, len(data) // 4, part))
                held += len(data)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, ids binary"
    )


def fill_window(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The lengths, with how many of each, whose sum is the largest that fits into ``room``.

    Bit s of ``reach`` tells whether the sum s can be made from the lengths seen so far. Counts
    are split into powers of two, so a length costs a logarithm of its count; the search ends as
    soon as the room can be filled wholly. The steps kept are walked back to find the counts.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            target -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return list(chosen.items())


def largest_first(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The lengths, with how many of each, that fit into ``room`` if the longest are taken first."""
    chosen = {}
    for length in sorted(counts, reverse=True):
        if taken := min(counts[length], room // length):
            chosen[length] = taken
            room -= taken * length
    return list(chosen.items())


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the pieces of each length go.

    A row says: the pieces of ``length`` numbered ``first`` to ``last`` fill, ``each`` at a time,
    the sequences from ``sequence`` on, beginning at ``offset``. Of the plans for some allowances the
    one with the fewest sequences is taken; a plan without avoidable slack ends the search.
    """
    fewest = -(-sum(x * n for x, n in counts.items()) // capacity)
    best = None
    for share in ALLOWANCES:
        rows, sequences = _planned(counts, capacity, int(share * capacity))
        if best is None or sequences < best[1]:
            best = rows, sequences
        if sequences <= fewest:
            break
    return pd.DataFrame(best[0], columns=["at_length", "first", "last", "each", "sequence", "offset_0"], dtype="int64")


def _planned(counts: dict[int, int], capacity: int, allowance: int) -> tuple[list[tuple], int]:
    """One plan: a window may have ``allowance`` more slack than it must, if that takes longer pieces.

    Short pieces are what later windows can be filled up with, so they are not spent for little.
    """
    left, used, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    for longest in sorted(counts, reverse=True):
        while left[longest]:
            left[longest] -= 1
            window, room = dict(fill_window(left, capacity - longest)), capacity - longest
            if allowance:
                other = dict(largest_first(left, room))
                filled = lambda w: sum(x * n for x, n in w.items())
                window = other if filled(other) >= filled(window) - allowance else window
            left[longest] += 1
            window[longest] = window.get(longest, 0) + 1
            times, offset = min(left[x] // n for x, n in window.items()), 0
            for length, each in sorted(window.items(), reverse=True):
                rows.append((length, used[length], used[length] + each * times - 1, each, sequence, offset))
                used[length] += each * times
                left[length] -= each * times
                offset += each * length
            sequence += times
    return rows, sequence


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a settled table with doc_id, start, length and _no, a number of each) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    schema = "at_length long, first long, last long, each long, sequence long, offset_0 long"
    plan = pieces.sparkSession.createDataFrame(plan_windows(counts, capacity), schema)
    numbered = number_within(pieces, "length", ["doc_id", "start", "_no"], "_number")
    at = F.col("_number") - F.col("first")
    # The plan has a few rows for each of at most ``capacity`` lengths.
    return (
        numbered.join(
            F.broadcast(plan),
            (F.col("length") == F.col("at_length")) & F.col("_number").between(F.col("first"), F.col("last")),
        )
        .withColumn("sequence_id", F.col("sequence") + F.floor(at / F.col("each")))
        .withColumn("offset", F.col("offset_0") + (at % F.col("each")) * F.col("length"))
        .drop("_number", *plan.columns)
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, added_tokens: bool = False
) -> DataFrame:
    """Pieces of all documents with ids, their checksum, sequence_id and offset."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity, added_tokens).withColumn("ids_crc32", F.crc32("ids"))
    # The number tells repeated rows apart, so that a group of them spreads over slices too.
    return pack(settle(pieces.withColumn("_no", F.monotonically_increasing_id()), "pieces"), capacity).drop("_no")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the ids of each sequence, at most ``capacity`` of them."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
    ).select("sequence_id", "length", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
