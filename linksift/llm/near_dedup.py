"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A document's set holds its shingles of ``SHINGLE`` words (A-Z lower-cased), of ``STAGE_SHINGLE``
where near-duplicates are dropped. Its sketch has ``BINS``
coordinates: in round 0, 1, ... every element is thrown into one bin by that round's hash, and a bin
keeps the smallest (round, hash) it has seen; from round ``BINS`` on, round BINS + i throws all
elements into bin i. So every coordinate is filled after at most 2 * BINS rounds, usually after one,
and the share of equal coordinates estimates the similarity with the concentration of independent
hashes. Sketches are banded: two sets at similarity 0.8 miss all 32 bands of four coordinates with
probability 5e-8.

Texts that are equal form one class first. Within a bucket of a band, classes are linked to one
centre instead of to each other; a link counts once the full sets confirm it. The centre is the class
that meets most others over all its buckets: where many copies of a text drift apart, that is the text
itself, which is closer to each of them than they are to each other. Buckets whose classes are all in
one component are done. The classes of the others are compared across components where they share one
of their rarest shingles and the places of that shingle leave room for enough in common (prefix and
positional filter, exact), so copies that have gone too far meet nobody, and pairs within a component,
nearly all of a large group, are never made.

A document without words has no set and is linked with nothing; its component is itself. A null
doc_id is no candidate for the smallest id; a component without any id has none, and op7 keeps its
rows. Rows equal in id and text stand for one document and stay together in op7. Where near-duplicates
are dropped, one row of each component stays in both cases. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linksift.llm.components import components
from linksift.llm.tables import settle

SHINGLE = 4
#: Words of a shingle where documents are dropped; op7 lists components by SHINGLE.
STAGE_SHINGLE = 5
BINS = 128
ROWS = 4
SIMILAR = 80
KNOWN_WORDS = 300_000
#: A side of a join is broadcast only up to so many rows (of an id and a hash).
BROADCAST_ROWS = 300_000
MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class ShingleHashes:
    """Sorted distinct 64-bit hashes of a text's shingles; remembers the hashes of words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}
        self.factors = seeds(size) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        each = np.array(list(map(self.known.__getitem__, words)), np.uint64)
        size = min(self.size, len(words))
        count = len(each) - size + 1
        total = np.full(count, size, np.uint64)
        for at in range(size):
            total += mixed(each[at : at + count] * self.factors[at])
        return np.unique(mixed(total))


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """``bins`` coordinates of a non-empty set; a coordinate is round << 48 | 48 bits of a hash."""
    out = np.full(bins, MASK, np.uint64)
    every = seeds(2 * bins)
    step, start = max(1, 2048 // len(hashes)), 0
    while start < 2 * bins and out.max() == np.uint64(MASK):
        rounds = np.arange(start, min(start + step, 2 * bins))
        drawn = mixed(hashes[None, :] ^ every[rounds][:, None])
        where = np.where(rounds[:, None] < bins, (drawn % np.uint64(bins)).astype(np.int64), rounds[:, None] - bins)
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (drawn >> np.uint64(16))
        np.minimum.at(out, where.reshape(-1), value.reshape(-1))
        start += step
    return out


def bands(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for every ``rows`` coordinates; the number of the band is mixed in."""
    grid = coordinates.reshape(-1, rows)
    total = seeds(len(grid)).copy()
    for at in range(rows):
        total = mixed(total ^ grid[:, at]) + np.uint64(at)
    return total.view(np.int64)


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, class, n_shingles, buckets) of every document; ``class`` is equal for equal texts."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("class", pa.string()), ("n_shingles", pa.int64()), ("buckets", pa.list_(pa.int64()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShingleHashes(shingle)
        for batch in batches:
            sizes, buckets = [], []
            for text in batch.column("text").to_pylist():
                found = hashes(text)
                sizes.append(len(found))
                buckets.append(bands(sketch(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("class"), pa.array(sizes, pa.int64()), pa.array(buckets, schema.field(3).type)],
                schema=schema,
            )

    keyed = docs.select(F.col("doc_id").cast("long"), class_of().alias("class"), "text")
    return keyed.mapInArrow(work, "doc_id long, class string, n_shingles long, buckets array<long>")


def class_of():
    return F.md5(F.coalesce("text", F.lit("")))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    of = lambda end: texts.select(F.col("class").alias(end), F.col("text").alias(f"text_{end}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=32)
        def full(text: str) -> frozenset:
            words = words_of(text)
            size = min(shingle, len(words))
            return frozenset(zip(*(words[at:] for at in range(size))))

        for batch in batches:
            good = []
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                x, y = full(a), full(b)
                common = len(x & y)
                good.append(100 * common >= similar * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(verify, "a string, b string")


def _mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, class, n, degree, label) of the buckets whose classes lie in different components."""
    found = members.join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
    label = F.coalesce("component", "class").alias("label")
    found = found.select("bucket", "class", "n", "degree", label)
    ends = found.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    return found.join(ends.select("bucket"), "bucket", "left_semi")


def _near_in_size(similar: int):
    return (100 * F.col("n_a") >= similar * F.col("n_b")) & (100 * F.col("n_b") >= similar * F.col("n_a"))


def class_links(sketches: DataFrame, docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(node, component) for the classes that are linked to another, from settled sketches."""
    first = sketches.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.first("buckets").alias("buckets")
    )
    classes = settle(first, "classes")
    members = classes.select("class", "n", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = settle(members.join(shared, "bucket"), "met")
    degrees = met.groupBy("class").agg(F.sum("size").alias("degree"))
    members = settle(met.drop("size").join(degrees, "class"), "members")

    # The texts of classes that share a bucket, from one of their documents.
    wanted = classes.join(members.select("class").distinct(), "class", "left_semi").select(
        F.col("class").alias("of"), F.col("doc_id").alias("id")
    )
    texts = docs.select("doc_id", class_of().alias("class"), "text").join(
        wanted, (F.col("class") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))
    )
    texts = settle(texts.select("class", "text").dropDuplicates(["class"]), "texts")

    each = F.struct("degree", "class", "n")
    centre = members.groupBy("bucket").agg(F.max(each).alias("c")).select("bucket", F.col("c.class").alias("b"), F.col("c.n").alias("n_b"))
    met = members.select("bucket", F.col("class").alias("a"), F.col("n").alias("n_a")).join(centre, "bucket")
    pairs = met.where("a != b").where(_near_in_size(similar)).select("a", "b").distinct()
    none = docs.sparkSession.createDataFrame([], "node string, component string")
    labels = _relabelled(none, settle(confirmed(pairs, texts, shingle, similar), "confirmed"))
    mixed_now = settle(_mixed_buckets(members, labels), "mixed")
    if mixed_now.isEmpty():
        return labels
    pairs = settle(_crossing_pairs(mixed_now, texts, shingle, similar), "crossing")
    return _relabelled(labels, settle(confirmed(pairs, texts, shingle, similar), "confirmed"))


def _crossing_pairs(mixed_now: DataFrame, texts: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Pairs (a, b) of classes of the mixed buckets, in different components, that may be similar.

    Shingles are ordered by the number of these classes that have them, then by hash. Two similar sets
    share one among the first n - least overlap + 1 of each, with enough left behind it in both.
    """
    wanted = mixed_now.select("class", "n", "label").distinct().withColumn("id", F.monotonically_increasing_id())
    wanted = settle(wanted, "wanted")
    sides = wanted.groupBy("label").agg(F.min("id").alias("side"))
    wanted = settle(wanted.join(sides, "label").select("id", "class", "n", "side"), "wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShingleHashes(shingle)
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found = hashes(text).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], ["id", "hash"])

    own = texts.join(wanted.select("class", "id"), "class").select("id", "text")
    each = settle(own.mapInArrow(hashed, "id long, hash long"), "shingles")
    shared = each.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1")
    of_one = W.partitionBy("id")
    placed = each.join(shared, "hash").join(wanted.drop("class"), "id").select(
        "hash", "id", "n", "side",
        # Shingles that no other class has come first; they take places but meet nobody.
        (F.col("n") - F.count("*").over(of_one) + F.row_number().over(of_one.orderBy("times", "hash")) - 1).alias("at"),
    )
    prefix = settle(placed.where(F.col("at") <= F.col("n") - F.ceil(similar * F.col("n") / 100)), "prefix")
    of = lambda x: prefix.select("hash", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "side", "at")))
    n, m = F.col("n_a"), F.col("n_b")
    enough = F.least(n - F.col("at_a"), m - F.col("at_b")) >= F.ceil(F.lit(similar) * (n + m) / F.lit(100 + similar))
    met = of("a").join(of("b"), "hash").where("id_a < id_b and side_a != side_b").where(enough & _near_in_size(similar))
    met = met.select("id_a", "id_b").distinct()
    named = lambda x: wanted.select(F.col("id").alias(f"id_{x}"), F.col("class").alias(x))
    return met.join(named("a"), "id_a").join(named("b"), "id_b").select("a", "b")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with the components that new links (a, b) of nodes join."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a != b")
    joined = settle(components(ends), "joined")
    then = joined.select(F.col("node").alias("component"), F.col("component").alias("then"))
    moved = labels.join(then, "component", "left").select("node", F.coalesce("then", "component").alias("component"))
    return settle(moved.union(joined.join(labels, "node", "left_anti")), "labels")


def without_near_duplicates(docs: DataFrame, columns: list[str], shingle: int = STAGE_SHINGLE) -> DataFrame:
    """``columns`` of one document of each component, that with the least (doc_id nulls last, class).

    Of rows equal in id and text one is taken. Rows without words stay, unless they repeat an id.
    """
    sketches = settle(sketched(docs, shingle), "sketches")
    labels = class_links(sketches, docs, shingle)
    # One row per id and text, then the least id of each class with the number of its rows.
    rows = sketches.groupBy("class", "doc_id").agg(F.count("*").alias("times"), F.min("n_shingles").alias("n"))
    rows = settle(rows, "rows")
    no_id = F.col("doc_id").isNull().alias("no_id")
    lowest = rows.where("n > 0").groupBy("class").agg(F.min(F.struct(no_id, "doc_id")).alias("low"))
    lowest = settle(
        lowest.join(labels, F.col("class") == F.col("node"), "left").select(
            "class", "low.*", F.coalesce("component", "class").alias("component")
        ),
        "lowest",
    )
    first = lowest.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "class")).alias("first"))
    first = first.select(F.col("first.class").alias("_of"), F.col("first.doc_id").alias("_id"), F.lit(True).alias("first"))
    chosen = rows.join(first, (F.col("class") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    stays = F.coalesce("first", F.col("n") == 0)
    repeats = stays & (F.col("times") > 1) & (F.col("first") | F.col("doc_id").isNotNull())
    marks = chosen.select(F.col("doc_id").alias("_id"), F.col("class").alias("_of"), stays.alias("stays"), F.coalesce(repeats, F.lit(False)).alias("repeats"))
    marks = settle(marks.where("repeats or not stays"), "marks")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    read = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), class_of().alias("_class"))
    same = (F.col("_class") == F.col("_of")) & F.col("_doc").eqNullSafe(F.col("_id"))
    # Equal rows are reduced before the shuffle, to one in each task.
    one = read.join(marks.where("repeats"), same).select("_row", "_doc", "_class").dropDuplicates(["_doc", "_class"])
    return read.join(marks, same, "left_anti").select("_row.*").union(one.select("_row.*"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """doc_id, class, n_shingles, component_id and kept of every document."""
    sketches = settle(sketched(docs, shingle), "sketches")
    labels = class_links(sketches, docs, shingle, similar)
    lowest = sketches.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("low"))
    lowest = settle(
        lowest.join(labels, F.col("class") == F.col("node"), "left").select(
            "class", "low", F.coalesce("component", "class").alias("component")
        ),
        "lowest",
    )
    grouped = lowest.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = lowest.join(grouped, "component").select("class", "component_id")
    rows = sketches.select("doc_id", "class", "n_shingles").join(
        by_class.withColumnRenamed("class", "_class"), F.col("class") == F.col("_class"), "left"
    )
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    rows = rows.withColumn("component_id", own).drop("_class")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
