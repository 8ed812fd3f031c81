"""Hard negatives by windows of scores, found exactly in a multiway hyperplane tree.

Rows are integer vectors with a label; a score is an inner product. For each anchor the first
``POSITIVES`` other rows of its label are its positives, and for each of those the first ``NEGATIVES``
rows of other labels whose score lies between ``LOW`` and ``HIGH`` percent of the positive's. First
means the highest score, then the smallest id.

The tree follows GNAT. With one more coordinate that brings every row to the same length M, a score s
of an anchor q is the distance sqrt(|q|^2 + M^2 - 2 s), so a window of scores is an annulus around q.
A node holds up to ``FAN`` split points; a row goes to the nearest, so hyperplanes bound the subtrees.
Each split point stores the least and greatest distance to the rows of every sibling subtree. A
subtree is left out if, for any split point, that range does not meet the distances at which the
triangle inequality allows rows of the annulus. Split points come from a sample of ``SAMPLE`` rows of
least hash; every row is indexed and the ranges are of all rows. Leaves are compared exactly, so
nothing is missed (recall 1) whatever the sample; it only decides how much can be left out.

Rows lie in the shared folder by leaf, in ranges of (leaf, hash), so a large leaf or a vector that
many rows share spreads over tasks. Anchors are the stated queries: ``BLOCK`` of them at a time meet
all rows, in two passes (positives, then windows). Their bounds start from the sample and tighten as a
task goes on; a task keeps at most the wanted number of rows for each window. Nothing is shuffled but
those few.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of
different lengths are filled up with zeros. Rows that share an id are one candidate, at the higher
score; of anchors that share an id the one with the least (label, vector) is taken; an anchor is no
partner of its own id. Empty tables give no rows. Only the named columns are read, so extra ones
cannot clash. Scores must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linksift.llm.ranks import small
from linksift.llm.tables import fresh_path, settle

FAN = 16
SAMPLE = 4_096
LEAF_SAMPLE = 32
BLOCK = 8_192
#: Rows compared at a time within a leaf.
STEP = 1_024
#: Scores looked at together.
CELLS = 1 << 20
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
ROWS_PER_TASK = 50_000
NEVER = -(1 << 62)


def usable(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, vector as doubles) of the rows that take part."""
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    read = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), numbers.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return read.where("id is not null and label is not null and vector is not null").where(finite)


@dataclass
class Tree:
    """Split points of all nodes; ``child[n][j]`` is a node, or ~leaf for a leaf."""

    points: list[np.ndarray]
    child: list[list[int]]
    paths: list[list[tuple[int, int]]]
    length: float

    def raised(self, rows: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that brings them to the common length."""
        wide = rows.astype(np.float64)
        rest = np.maximum(self.length**2 - (wide * wide).sum(1), 0.0)
        return np.hstack([wide, np.sqrt(rest)[:, None]])


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2.0 * (rows @ points.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _spread(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next one is that farthest from those taken."""
    taken, far = [0], distances(rows, rows[:1])[:, 0]
    while len(taken) < count and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, distances(rows, rows[taken[-1:]])[:, 0])
    return rows[taken]


def grown(sample: np.ndarray, length: float) -> Tree:
    """A tree whose leaves hold about ``LEAF_SAMPLE`` rows of the sample."""
    tree = Tree([], [], [], length)
    work = [(tree.raised(sample), [])]
    while work:
        rows, path = work.pop()
        at = len(tree.points)
        if path:
            tree.child[path[-1][0]][path[-1][1]] = at
        points = _spread(rows, min(FAN, max(1, len(rows) // LEAF_SAMPLE)))
        tree.points.append(points)
        tree.child.append([0] * len(points))
        nearest = distances(rows, points).argmin(1)
        for j in range(len(points)):
            own = rows[nearest == j]
            if len(points) > 1 and len(own) >= 2 * LEAF_SAMPLE and len(own) < len(rows):
                work.append((own, [*path, (at, j)]))
            else:
                tree.child[at][j] = ~len(tree.paths)
                tree.paths.append([*path, (at, j)])
    return tree


def leaves_of(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf of each raised row."""
    leaf, work = np.empty(len(rows), np.int64), [(0, np.arange(len(rows)))]
    while work:
        node, which = work.pop()
        nearest = distances(rows[which], tree.points[node]).argmin(1)
        for j, child in enumerate(tree.child[node]):
            own = which[nearest == j]
            if child < 0:
                leaf[own] = ~child
            elif len(own):
                work.append((child, own))
    return leaf


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten()).reshape(len(lists), dim)


def indexed(rows: DataFrame, tree: Tree, dim: int, parts: int) -> DataFrame:
    """(leaf, id, label, vector), settled in ranges of leaves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaves_of(tree, tree.raised(matrix(batch.column("vector"), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c) for c in ("id", "label", "vector"))], ["leaf", "id", "label", "vector"])

    dealt = rows.mapInArrow(work, "leaf long, id long, label long, vector array<long>")
    spread = F.xxhash64("id", "vector")
    return settle(dealt.repartitionByRange(parts, "leaf", spread).sortWithinPartitions("leaf"), "leaves")


def ranges_of(index: DataFrame, tree: Tree, dim: int) -> list[np.ndarray]:
    """Per node [split point, sibling, least or greatest distance], over all rows of the index."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full((len(p), len(p)), np.inf) for p in tree.points]
        high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
        for batch in batches:
            raised, leaf = tree.raised(matrix(batch.column("vector"), dim)), np.asarray(batch.column("leaf"))
            for number in np.unique(leaf):
                own = raised[leaf == number]
                for node, j in tree.paths[number]:
                    far = distances(own, tree.points[node])
                    low[node][:, j] = np.minimum(low[node][:, j], far.min(0))
                    high[node][:, j] = np.maximum(high[node][:, j], far.max(0))
        cells = [(n, i, j, low[n][i, j], high[n][i, j]) for n in range(len(low)) for i, j in np.argwhere(np.isfinite(low[n]))]
        columns = list(zip(*cells)) if cells else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "point", "sibling", "low", "high"])

    cells = index.select("leaf", "vector").mapInArrow(work, "node long, point long, sibling long, low double, high double")
    found = [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)], 2) for p in tree.points]
    for r in cells.groupBy("node", "point", "sibling").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        found[r["node"]][r["point"], r["sibling"]] = r["low"], r["high"]
    return found


@dataclass
class Windows:
    """Anchors and, for each, some windows of scores of which the first ``want`` rows are sought."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray  # anchors x windows, raised as rows are found
    high: np.ndarray
    same: bool  # rows of the anchor's label, or of all others
    want: int


class Best:
    """The first rows of each window that one task has seen."""

    def __init__(self, windows: Windows):
        self.w, self.low = windows, windows.low.copy()
        self.slots, self.ids, self.scores, self.fresh = [], [], [], 0

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Keep what lies in a window of ``scores`` (anchors x rows), some anchors at a time."""
        w, step = self.w, max(1, CELLS // max(1, len(ids)))
        for at in range(0, len(anchors), step):
            some = anchors[at : at + step]
            least, most = self.low[some].min(1).astype(scores.dtype), w.high[some].max(1).astype(scores.dtype)
            a, x = np.nonzero(scores[at : at + step] >= least[:, None])
            row, score = some[a], scores[at : at + step][a, x]
            fits = (score <= most[a]) & ((w.labels[row] == labels[x]) == w.same) & (w.ids[row] != ids[x])
            row, score, key = row[fits], score[fits].astype(np.int64), ids[x[fits]]
            for j in range(w.low.shape[1]):
                inside = (score >= self.low[row, j]) & (score <= w.high[row, j])
                self.slots.append(row[inside] * w.low.shape[1] + j)
                self.ids.append(key[inside])
                self.scores.append(score[inside])
                self.fresh += int(inside.sum())
            if self.fresh > CELLS // 4:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut every window to its first rows and raise its bound."""
        slots, ids, scores = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.slots, self.ids, self.scores))
        order = np.lexsort((-scores, ids, slots))
        slots, ids, scores = slots[order], ids[order], scores[order]
        once = np.r_[True, (slots[1:] != slots[:-1]) | (ids[1:] != ids[:-1])][: len(slots)]
        slots, ids, scores = slots[once], ids[once], scores[once]
        order = np.lexsort((ids, -scores, slots))
        slots, ids, scores = slots[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]][: len(slots)])
        at = np.arange(len(slots)) - np.repeat(starts, np.diff(np.r_[starts, len(slots)]))
        full, flat = at == self.w.want - 1, self.low.reshape(-1)
        flat[slots[full]] = np.maximum(flat[slots[full]], scores[full])
        kept = at < self.w.want
        slots, ids, scores = slots[kept], ids[kept], scores[kept]
        self.slots, self.ids, self.scores, self.fresh = [slots], [ids], [scores], 0
        return slots, ids, scores


def alive(tree: Tree, ranges: list[np.ndarray], far: list[np.ndarray], leaf: int, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Which anchors may have rows of their annulus [inner, outer] in a leaf; ``far``: to all split points."""
    good, slack = np.ones(len(inner), bool), 1e-6 * (1.0 + tree.length)
    for node, j in tree.paths[leaf]:
        low, high = ranges[node][:, j, 0], ranges[node][:, j, 1]
        least = np.maximum(0.0, np.maximum(far[node] - outer[:, None], inner[:, None] - far[node])) - slack
        most = far[node] + outer[:, None] + slack
        good &= ((low[None, :] <= most) & (high[None, :] >= least)).all(1)
    return good


def searched(index: DataFrame, tree: Tree, ranges: list[np.ndarray], windows: Windows, exact: type) -> DataFrame:
    """(slot, id, score): the first rows of every window; slot = anchor * windows + window."""
    dim = windows.vectors.shape[1]
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows
        best, queries = Best(w), w.vectors.astype(exact)
        squares = (w.vectors.astype(np.float64) ** 2).sum(1)
        raised = np.hstack([w.vectors.astype(np.float64), np.zeros((len(queries), 1))])
        far = [distances(raised, points) for points in tree.points]
        reach = lambda score: np.sqrt(np.maximum(squares + tree.length**2 - 2.0 * score, 0.0))
        inner = reach(w.high.max(1).astype(np.float64))
        for batch in batches:
            leaf = np.asarray(batch.column("leaf"))
            rows, ids, labels = matrix(batch.column("vector"), dim).astype(exact), np.asarray(batch.column("id")), np.asarray(batch.column("label"))
            cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
            for start, end in zip(cuts[:-1], cuts[1:]):
                outer = reach(best.low.min(1).astype(np.float64))
                able = np.flatnonzero(alive(tree, ranges, far, leaf[start], inner, outer) & (best.low.min(1) <= w.high.max(1)))
                for at in range(start, end, STEP):
                    to = min(end, at + STEP)
                    if len(able):
                        best.add(able, queries[able] @ rows[at:to].T, ids[at:to], labels[at:to])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.settle()], ["slot", "id", "score"])

    found = index.mapInArrow(work, "slot long, id long, score long")
    one = found.groupBy("slot", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return one.withColumn("place", place).where(F.col("place") <= windows.want)


def _seeded(windows: Windows, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, exact: type) -> Windows:
    """The same windows with the bounds that the sample gives."""
    best = Best(windows)
    every = np.arange(len(windows.ids))
    for at in range(0, len(ids), STEP):
        part = slice(at, at + STEP)
        best.add(every, windows.vectors.astype(exact) @ vectors[part].astype(exact).T, ids[part], labels[part])
    best.settle()
    windows.low = best.low
    return windows


def _taken(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array([r["id"] for r in rows], np.int64)
    labels = np.array([r["label"] for r in rows], np.int64)
    return ids, labels, np.array([r["vector"] for r in rows], np.int64).reshape(len(rows), dim)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (all whole numbers).

    ``vectors`` has id, label and vector (whole numbers, none null); ``is_anchor`` tells the anchors.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vectors = settle(vectors.select("id", "label", F.col("vector").cast("array<long>").alias("vector")), "vectors")
    size = F.size("vector")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    told = vectors.agg(F.count("*").alias("n"), F.max(size).alias("dim"), F.max(square).alias("square")).first()
    if not told["n"]:
        return spark.createDataFrame([], schema)
    dim, length = max(1, told["dim"]), float(np.sqrt(told["square"])) + 1.0
    if told["square"] >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit a long")
    # No partial sum of a product exceeds the greatest squared length.
    exact = np.float32 if told["square"] < 2**24 else np.float64 if told["square"] < 2**53 else np.int64
    filled = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - size))
    rows = vectors.select("id", "label", F.when(size == dim, F.col("vector")).otherwise(filled).alias("vector"))

    sample = rows.orderBy(F.xxhash64("id", "vector"), "id", "label").limit(SAMPLE).collect()
    known = _taken(sample, dim)
    tree = grown(known[2], length)
    index = indexed(rows, tree, dim, max(1, -(-told["n"] // ROWS_PER_TASK), spark.sparkContext.defaultParallelism))
    ranges = ranges_of(index, tree, dim)

    anchors = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    anchors = settle(anchors, "anchors")
    blocks = -(-anchors.count() // BLOCK)
    path = fresh_path(spark, "mined")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(blocks):
        ids, labels, queries = _taken(anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect(), dim)
        if not len(ids):
            continue
        bounds = lambda value, width: np.full((len(ids), width), value, np.int64)  # noqa: E731, B023
        windows = _seeded(Windows(ids, labels, queries, bounds(NEVER, 1), bounds(-NEVER, 1), True, positives), *known, exact)
        partners = searched(index, tree, ranges, windows, exact).collect()
        if not partners:
            continue
        # Windows without a positive are empty.
        windows = Windows(ids, labels, queries, bounds(-NEVER, positives), bounds(NEVER, positives), False, negatives)
        for r in partners:
            at = r["slot"], r["place"] - 1
            windows.low[at], windows.high[at] = -(-low * r["score"] // 100), high * r["score"] // 100
        found = searched(index, tree, ranges, _seeded(windows, *known, exact), exact)
        pairs = [(r["slot"] * positives + r["place"] - 1, int(ids[r["slot"]]), r["id"], r["score"]) for r in partners]
        given = spark.createDataFrame(pairs, "slot long, anchor_id long, positive_id long, positive_score long")
        joined = found.join(small(given), "slot")
        joined.select(
            "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
