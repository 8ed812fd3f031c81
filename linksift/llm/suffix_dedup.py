"""Repeated byte strings across a corpus, by a blockwise suffix sort with a difference cover.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts anywhere else too. Only suffixes
that can have such a twin are sorted. A string of ``LENGTH`` bytes is put into the bucket of its
*anchor*, the substring of ``ANCHOR`` bytes with the smallest hash (the leftmost of equals), which equal
strings share with its place in them. The strings with one anchor start next to each other and make
up its *run*. A bucket whose anchor occurs once is dropped; equal runs are sent once, with their
number; what is left are the buckets with different runs around one anchor.

These buckets are sorted, a block of whole buckets at a time. Suffixes are ordered by their first
``PERIOD`` bytes, and longer ties by the ranks of a difference cover sample: every position whose
residue modulo ``PERIOD`` is in ``COVER`` has its rank among the block's sample suffixes, found before
by doubling. Runs are laid out with their anchors at multiples of ``PERIOD``, so suffixes at the same
distance from their anchors reach the sample by the same step. Neighbours that agree in ``LENGTH``
bytes are marked. A task holds one block. Buckets with more than ``BUCKET_RUNS`` different runs are
not gathered in a task: their strings are counted by 128-bit hashes instead, with partial sums.

Null and empty texts have no bytes and lose none. Rows with equal texts are copies of each other
(also if their ids are equal), so they go wholly from ``LENGTH`` bytes on. Empty tables give no rows.
Carried columns travel in the struct ``row``, so that no names clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linksift.llm.ranks import key_filter, maybe_in
from linksift.llm.tables import settle

LENGTH = 400
ANCHOR = 128
# A perfect difference set, every residue is the difference of one pair.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
BUCKET_RUNS = 2_000
BLOCK_BYTES = 1 << 19
CHUNK = 1 << 18
#: Rows of a batch that a Python worker turns into objects, and bytes that it gathers, at a time.
SLICE_ROWS = 128
SLICE_BYTES = 1 << 20
PLACE_BITS = 21
#: A side of a join is broadcast only up to so many rows or list entries.
BROADCAST_ROWS = 100_000
FACTOR = 0x9E3779B97F4A7C15


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2**64."""
    up = np.full(count, FACTOR, np.uint64)
    down = np.full(count, pow(FACTOR, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Anchors:
    """Finds the runs of a text: (first start, number of starts, place of the anchor)."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR):
        self.length, self.anchor = length, anchor
        self.width = length - anchor + 1
        self.up, self.down = _powers(CHUNK + length + 1)

    def _chunk(self, data: np.ndarray) -> np.ndarray:
        """The place of the anchor of every start in one chunk."""
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * self.up[: len(data)], out=total[1:])
        count = len(data) - self.anchor + 1
        value = (total[self.anchor :] - total[:count]) * self.down[:count]
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        value = (value >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(count, dtype=np.uint64)
        # The least of every ``width`` values, from least values up to and from block borders.
        width, starts = self.width, count - self.width + 1
        grid = np.full(-(-count // width) * width, np.iinfo(np.uint64).max, np.uint64)
        grid[:count] = value
        grid = grid.reshape(-1, width)
        left = np.minimum.accumulate(grid, axis=1).reshape(-1)
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(right[:starts], left[width - 1 : width - 1 + starts])
        return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)

    def runs(self, data: bytes) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        whole = np.frombuffer(data, np.uint8)
        for begin in range(0, len(data) - self.length + 1, CHUNK):
            places = self._chunk(whole[begin : begin + CHUNK + self.length - 1])
            first = np.flatnonzero(np.diff(places, prepend=-1))
            counts = np.diff(np.append(first, len(places)))
            out += zip((first + begin).tolist(), counts.tolist(), (places[first] + begin).tolist())
        return out


def _batches(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """The rows of some columns; a worker holds few of them as Python objects at a time."""
    for a in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(a, SLICE_ROWS)
        yield from zip(*(part.column(c).to_pylist() for c in columns))


RUN = pa.schema(
    [("text_key", pa.binary()), ("start", pa.int64()), ("count", pa.int32()), ("ahead", pa.int32()), ("anchor", pa.int64()), ("run", pa.binary())]
)
PIECE = pa.schema(
    [("anchor", pa.int64()), ("run", pa.binary()), ("count", pa.int32()), ("ahead", pa.int32()), ("bytes", pa.binary())]
)
MARKED = pa.schema([("anchor", pa.int64()), ("run", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])


def text_runs(docs: DataFrame) -> DataFrame:
    """All runs of all texts: place, anchor hash and 128-bit hash of the bytes the run spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, rows = Anchors(), []
        for batch in batches:
            for key, text in _rows(batch, "text_key", "text"):
                data = text.encode("utf-8", "surrogatepass")
                for start, count, place in anchors.runs(data):
                    mark = xxhash.xxh3_64_intdigest(data[place : place + ANCHOR])
                    span = xxhash.xxh3_128(data[start : start + count - 1 + LENGTH])
                    span.update(b"%d %d" % (count, place - start))
                    rows.append((key, start, count, place - start, mark - (1 << 63), span.digest()))
                if len(rows) > 5_000:
                    yield _batches(rows, RUN)
                    rows = []
        if rows:
            yield _batches(rows, RUN)

    long_enough = docs.where(F.octet_length("text") >= LENGTH)
    return long_enough.select(text_key().alias("text_key"), "text").mapInArrow(work, _ddl(RUN))


def text_key():
    """16 bytes that equal texts share."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def cover_ranks(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Ranks of the sample suffixes by at least ``depth`` bytes; other positions stay zero.

    The first names are ranks by ``PERIOD`` bytes. Position i + PERIOD is in the sample whenever i
    is, so names of twice the depth are ranks of pairs.
    """
    places = np.arange(len(text) - PERIOD + 1)
    places = places[np.isin(places % PERIOD, COVER)]
    names = np.zeros(len(text) + 2 * depth + 2 * PERIOD, np.int64)
    names[places] = prefix_names(text, places) + 1
    reach = PERIOD
    while reach < depth:
        pairs = names[places] * (len(places) + 2) + names[places + reach]
        names[places] = np.unique(pairs, return_inverse=True)[1] + 1
        reach *= 2
    return names


def prefix_names(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The rank of each place by its first ``PERIOD`` bytes."""
    words = []  # of 8 bytes, the first byte highest; the last word ends with the last byte
    for at in (0, 8, 16, PERIOD - 8):
        word = np.zeros(len(places), np.uint64)
        for k in range(8):
            word <<= np.uint64(8)
            word |= text[places + (at + k)]
        words.append(word)
    order = np.lexsort(words[::-1])
    differs = np.zeros(max(len(places) - 1, 0), bool)
    for word in words:
        word = word[order]
        differs |= word[1:] != word[:-1]
    names = np.empty(len(places), np.int64)
    names[order] = np.append(0, np.cumsum(differs))
    return names


def repeated_starts(pieces: list[bytes], buckets: list[int], counts: list[int], ahead: list[int]) -> list[np.ndarray]:
    """For every piece of a block, which of its starts have a twin in the same bucket.

    Piece i spans the run of ``counts[i]`` starts whose anchor lies ``ahead[i]`` bytes after the first.
    """
    begins, at = [], 0
    for piece, far in zip(pieces, ahead):
        at += -(at + far) % PERIOD  # the anchor comes to a multiple of the period
        begins.append(at)
        at += len(piece)
    text = np.zeros(at + LENGTH + PERIOD, np.uint8)
    for begin, piece in zip(begins, pieces):
        text[begin : begin + len(piece)] = np.frombuffer(piece, np.uint8)
    number = np.repeat(np.arange(len(pieces)), counts)
    inside = np.arange(len(number)) - np.repeat(np.cumsum([0, *counts[:-1]]), counts)
    place = np.array(begins)[number] + inside
    away = np.array(ahead)[number] - inside
    group = np.array(buckets)[number] * (2 * LENGTH) + away + LENGTH
    steps = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    ranks = cover_ranks(text)
    order = np.lexsort((ranks[place + steps[place % PERIOD]], prefix_names(text, place), group))
    sorted_place, sorted_group = place[order], group[order]
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    same = np.zeros(len(order), bool)
    for a in range(0, len(order) - 1, 5_000):
        b = min(a + 5_000, len(order) - 1)
        alike = sorted_group[a:b] == sorted_group[a + 1 : b + 1]
        left, right = sorted_place[a:b][alike], sorted_place[a + 1 : b + 1][alike]
        hit = np.flatnonzero(alike) + a
        same[hit] = (windows[left] == windows[right]).all(axis=1)
    twin = same | np.append(False, same[:-1])
    found = np.zeros(len(order), bool)
    found[order] = twin
    return np.split(found, np.cumsum(counts)[:-1])


def _stretches(marks: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of every stretch of marks."""
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()))


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of their buckets in, marked stretches out; one block of buckets at a time."""

    def close(block: list[tuple]) -> pa.RecordBatch | None:
        anchors, runs, counts, ahead, pieces = map(list, zip(*block))
        ids = {a: n for n, a in enumerate(dict.fromkeys(anchors))}
        marks = repeated_starts(pieces, [ids[a] for a in anchors], counts, ahead)
        rows = [(a, r, x, y) for a, r, m in zip(anchors, runs, marks) for x, y in _stretches(m)]
        return _batches(rows, MARKED) if rows else None

    block, held = [], 0
    for batch in batches:
        for row in _rows(batch, *PIECE.names):
            if held > BLOCK_BYTES and row[0] != block[-1][0]:
                if (out := close(block)) is not None:
                    yield out
                block, held = [], 0
            block.append(row)
            held += len(row[4])
    if block and (out := close(block)) is not None:
        yield out


def _small(df: DataFrame, size) -> DataFrame:
    """A settled table, marked for broadcast if its total size is small."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_ROWS else df


def _cut(docs: DataFrame, runs: DataFrame, schema: pa.Schema, made) -> DataFrame:
    """The rows that ``made`` makes of each of some runs and the bytes that it spans, cut from its text."""
    entry = F.struct("anchor", "run", "count", "ahead", "start")
    by_text = settle(runs.groupBy("text_key").agg(F.collect_list(entry).alias("runs")), "run-lists")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for text, runs in _rows(batch, "text", "runs"):
                data = text.encode("utf-8", "surrogatepass")
                for r in runs:
                    piece = data[r["start"] : r["start"] + r["count"] - 1 + LENGTH]
                    found = made(r["anchor"], r["run"], r["count"], r["ahead"], piece)
                    rows += found
                    held += len(piece) * len(found)
                    if held > SLICE_BYTES:
                        yield _batches(rows, schema)
                        rows, held = [], 0
            if rows:
                yield _batches(rows, schema)

    keyed = docs.where(F.octet_length("text") >= LENGTH).select(text_key().alias("text_key"), "text")
    keyed = maybe_in(keyed, "text_key", key_filter(by_text, "text_key")).where("_maybe").drop("_maybe")
    met = keyed.join(_small(by_text, F.size("runs")), "text_key")
    one = met.select("text_key", "text", "runs").dropDuplicates(["text_key"])
    return one.select("text", "runs").mapInArrow(cut, _ddl(schema))


def _pieces(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes that each of some runs spans."""
    return _cut(docs, runs, PIECE, lambda *row: [row])


def _by_hashes(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Marked stretches of buckets too large for one task: strings are counted by their hashes."""
    schema = pa.schema([*MARKED, ("away", pa.int32()), ("hash", pa.binary())])

    def every(anchor, run, count, ahead, data):
        return [(anchor, run, at, at, ahead - at, xxhash.xxh3_128_digest(data[at : at + LENGTH])) for at in range(count)]

    strings = settle(_cut(docs, runs, schema, every), "strings")
    key = ["anchor", "away", "hash"]
    twice = strings.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1").drop("times")
    return strings.join(twice, key, "left_semi").select(*MARKED.names)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(text_key, spans): the stretches of bytes to remove from each text, which may overlap."""
    runs = settle(text_runs(docs), "runs")
    often = settle(runs.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").drop("times"), "often")
    met = maybe_in(runs, "anchor", key_filter(often, "anchor")).where("_maybe").drop("_maybe")
    runs = settle(met.join(often, "anchor"), "met-runs")
    place = F.struct("text_key", "start", "count", "ahead")
    kinds = settle(runs.groupBy("anchor", "run").agg((F.count("*") > 1).alias("again"), F.min(place).alias("place")), "kinds")
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = settle(kinds.join(sizes, "anchor").select("anchor", "run", "kinds", "place.*"), "mixed")
    # The bytes are cut once and go straight to the task that sorts their bucket.
    pieces = _pieces(docs, mixed.where(F.col("kinds") <= BUCKET_RUNS)).repartition("anchor")
    marked = pieces.sortWithinPartitions("anchor").mapInArrow(_sort_blocks, _ddl(MARKED))
    large = mixed.where(F.col("kinds") > BUCKET_RUNS)
    if not large.isEmpty():
        marked = marked.union(_by_hashes(docs, large))
    whole = kinds.where("again").select("anchor", "run", F.lit(0).alias("first"), (F.col("place.count") - 1).alias("last"))
    marked = settle(whole.union(marked), "marked")

    # Copies of a text have equal rows here; the spans of a text are made distinct when they are gathered.
    found = runs.join(marked, ["anchor", "run"]).select(
        "text_key",
        F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + LENGTH).alias("b")).alias("span"),
    )
    return found.groupBy("text_key").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (the carried ``columns``), n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 of every document."""
    spans = settle(repeated_spans(docs), "spans")
    source = docs.select("text", F.struct(*columns).alias("row"), text_key().alias("_key"))
    # Texts that lose nothing stay where they are read.
    told = maybe_in(source, "_key", key_filter(spans, "text_key"))
    of = _small(spans, F.size("spans")).withColumnRenamed("text_key", "_of")
    met = told.where("_maybe").join(of, F.col("_key") == F.col("_of"), "left").select("text", "row", "spans")
    whole = told.where("not _maybe").select("text", "row", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    joined = met.union(whole)
    schema = f"row {source.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long"
    added = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())]

    def cut_one(text: str | None, spans: list | None) -> tuple:
        data, at, parts, n_spans = (text or "").encode("utf-8", "surrogatepass"), 0, [], 0
        for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
            if a > at or not n_spans:
                n_spans += 1
                parts.append(data[at:a])
            at = max(at, b)
        kept = b"".join([*parts, data[at:]])
        return len(data), len(data) - len(kept), n_spans, kept, hashlib.sha256(kept).hexdigest()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(a, SLICE_ROWS)
                found = zip(*(cut_one(*row) for row in _rows(part, "text", "spans")))
                arrays = [part.column("row"), *(pa.array(x, kind) for x, (_, kind) in zip(found, added))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", *(name for name, _ in added)])

    return joined.mapInArrow(cut, f"{schema}, kept binary, kept_sha256 string")
