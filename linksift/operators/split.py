"""Exact stratified splits, folds and samples by hash cut-offs (T1, T9 folds, L4, L7).

Rows are ordered by a hash of their id. The hash at a wanted rank is found by narrowing down:
count rows per hash prefix, keep only the prefix that holds the rank, and so on; only the last,
small bucket is sorted. Rows that share an id share a hash and so a part: sizes are exact for unique
ids, and off by at most the copies of the ids at the cuts otherwise. The result is one literal per (class, rank), so that assigning rows to
parts is a plain column expression: no shuffle and no join of the data itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linksift.functions.draws import row_hash
from linksift.session import scratch_path, settled

PREFIX_STEP = 3
HASH_DIGITS = 32
SORTED_ROWS = 100_000
#: Classes whose cuts are written as literals, and those whose table of cuts is broadcast.
FEW_CLASSES = 100
BROADCAST_CLASSES = 500_000

Counts = dict[object, int]
Ranks = dict[object, list[int]]


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def hash_cutoffs(
    df: DataFrame,
    id_col: str,
    label: str,
    seed: int,
    ranks_of: Callable[[Counts], Ranks],
    sorted_rows: int = SORTED_ROWS,
) -> tuple[Counts, dict[tuple[object, int], str]]:
    """Class sizes, and the hash at each wanted 1-based rank of each class."""
    keyed = df.select(F.col(label).alias("label"), row_hash(seed, F.col(id_col)).alias("key"))

    def histogram(rows: DataFrame, digits: int) -> dict[tuple[object, str], int]:
        counted = rows.groupBy("label", F.substring("key", 1, digits).alias("prefix")).count()
        return {(r["label"], r["prefix"]): r["count"] for r in counted.collect()}

    buckets = histogram(keyed, PREFIX_STEP)
    sizes: Counts = {}
    for (klass, _), n in buckets.items():
        sizes[klass] = sizes.get(klass, 0) + n
    if None in sizes:
        raise ValueError(f"{sizes[None]} rows have no {label}")
    # Open targets: where each wanted rank lies, as (prefix, rank inside that prefix).
    wanted = {(k, r): ("", r) for k, ranks in ranks_of(sizes).items() for r in ranks if r > 0}
    digits = PREFIX_STEP
    while wanted:
        ordered = sorted(buckets.items(), key=lambda item: item[0][1])
        for (klass, rank), (prefix, inside) in wanted.items():
            for (k, bucket), n in ordered:
                if k != klass or not bucket.startswith(prefix):
                    continue
                if inside <= n:
                    wanted[klass, rank] = (bucket, inside)
                    break
                inside -= n
        open_buckets = {(klass, prefix) for (klass, _), (prefix, _) in wanted.items()}
        rows = keyed.filter(
            _any([(F.col("label") == k) & F.startswith("key", F.lit(p)) for k, p in open_buckets])
        )
        largest = max(buckets[b] for b in open_buckets)
        if largest <= sorted_rows:
            break
        if digits >= HASH_DIGITS:  # rows of one id: the whole hash is the cut
            return sizes, {target: prefix for target, (prefix, _) in wanted.items()}
        digits = min(HASH_DIGITS, digits + PREFIX_STEP)
        buckets = histogram(rows, digits)
    if not wanted:
        return sizes, {}

    in_bucket = Window.partitionBy("label", F.substring("key", 1, digits)).orderBy("key")
    placed = rows.withColumns(
        {"rank": F.row_number().over(in_bucket)}
    )
    hits = placed.filter(
        _any(
            [
                (F.col("label") == klass)
                & F.startswith("key", F.lit(prefix))
                & (F.col("rank") == inside)
                for (klass, _), (prefix, inside) in wanted.items()
            ]
        )
    ).collect()
    found = {(r["label"], r["key"][:digits], r["rank"]): r["key"] for r in hits}
    return sizes, {
        (klass, rank): found[klass, prefix, inside]
        for (klass, rank), (prefix, inside) in wanted.items()
    }


def _upto(label: str, cutoffs: dict[object, str]) -> Column:
    """Whether the row's ``_key`` is at or before the cut of its class."""
    return _any([(F.col(label) == k) & (F.col("_key") <= cut) for k, cut in cutoffs.items()])


def held_out_sizes(sizes: Counts, fraction: float) -> Counts:
    """Rows of each class in the test part: ceil(fraction * n) in all, shared by class size.

    Each class gets the whole part of its share; what remains goes to the largest fractions,
    the smaller class label first on a tie.
    """
    total = sum(sizes.values())
    n_test = -int(-(fraction * total) // 1)
    shares = {k: n_test * n / total for k, n in sizes.items()}
    taken = {k: int(s) for k, s in shares.items()}
    by_rest = sorted(sizes, key=lambda k: (-(shares[k] - taken[k]), k))
    for k in by_rest[: n_test - sum(taken.values())]:
        taken[k] += 1
    return taken


def _written(df: DataFrame, name: str) -> DataFrame:
    """A long narrow table written once as Parquet, which takes less disk than a checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df


def in_order(table: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number the rows of a table 0, 1, 2, ... in an order, range by range."""
    placed = _written(table.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, rest = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))  # one row per range
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(out, F.col("_start") + rest).drop("_at", "_part", "_start")


def held_out_ranks(sizes: DataFrame, fraction: float) -> Callable[[Column, Column], Column]:
    """As ``held_out_sizes`` for any number of classes: the test rows of a class from its size and label.

    A share depends on the size only, so how many classes have each size tells which fractions are
    rounded up; only the classes of the last such fraction are ordered by label.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_test = -int(-(fraction * total) // 1)
    share = lambda n: F.lit(n_test) * n / F.lit(float(total or 1))
    rest = lambda n: share(n) - F.floor(share(n))
    kinds = sizes.groupBy("n").agg(F.count("*").alias("k"))  # different sizes: at most sqrt(2 * rows)
    kinds = settled(kinds.select("k", F.floor(share(F.col("n"))).alias("whole"), rest(F.col("n")).alias("rest")))
    more = n_test - (kinds.agg(F.sum(F.col("whole") * F.col("k"))).first()[0] or 0)
    if more <= 0:
        return lambda n, label: F.floor(share(n))
    upto = Window.orderBy(F.desc("rest")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = kinds.groupBy("rest").agg(F.sum("k").alias("k")).withColumn("upto", F.sum("k").over(upto))
    last = steps.where(F.col("upto") >= more).orderBy("upto").first()
    edge, left = last["rest"], more - (last["upto"] - last["k"])
    if left == last["k"]:
        return lambda n, label: F.floor(share(n)) + F.when(rest(n) >= edge, 1).otherwise(0)
    tied = in_order(sizes.where(rest(F.col("n")) == edge).select("label"), [F.asc("label")], "place")
    final = F.lit(tied.where(F.col("place") == left - 1).first()["label"])
    return lambda n, label: F.floor(share(n)) + F.when((rest(n) > edge) | ((rest(n) == edge) & (label <= final)), 1).otherwise(0)


def class_cuts(
    df: DataFrame, id_col: str, label: str, seed: int, wanted: DataFrame, sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """(label, rank, cut): the hash at each wanted 1-based rank, with all classes narrowed in one grouped job.

    As ``hash_cutoffs``, but the open ranks are a table; nothing is kept per class on the driver.
    """
    keyed = df.select(F.col(label).alias("label"), row_hash(seed, F.col(id_col)).alias("key"))
    state = wanted.select("label", "rank", F.lit("").alias("prefix"), F.col("rank").alias("inside"))
    digits, largest = 0, None
    while largest is None or (largest > sorted_rows and digits < HASH_DIGITS):
        above, digits = digits, min(HASH_DIGITS, digits + PREFIX_STEP)
        open_prefixes = _near(state.select("label", F.col("prefix").alias("up")).distinct())
        rows = keyed.select("label", F.substring("key", 1, above).alias("up"), F.substring("key", 1, digits).alias("long"))
        counts = rows.join(open_prefixes, ["label", "up"], "left_semi").groupBy("label", "up", "long").agg(F.count("*").alias("n"))
        ahead = Window.partitionBy("label", "up").orderBy("long").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        met = state.withColumnRenamed("prefix", "up").join(counts, ["label", "up"])
        met = met.where((F.col("before") < F.col("inside")) & (F.col("inside") <= F.col("before") + F.col("n")))
        placed = settled(met.select("label", "rank", F.col("long").alias("prefix"), (F.col("inside") - F.col("before")).alias("inside"), "n"))
        largest = placed.agg(F.max("n")).first()[0] or 0
        state = placed.drop("n")
    if digits == HASH_DIGITS:  # rows of one id: the whole hash is the cut
        return state.select("label", "rank", F.col("prefix").alias("cut"))
    rows = keyed.withColumn("prefix", F.substring("key", 1, digits)).join(_near(state.select("label", "prefix").distinct()), ["label", "prefix"], "left_semi")
    number = F.row_number().over(Window.partitionBy("label", "prefix").orderBy("key"))
    hits = rows.withColumn("inside", number.cast("long"))
    return settled(state.join(hits, ["label", "prefix", "inside"]).select("label", "rank", F.col("key").alias("cut")))


def stratified_split(
    df: DataFrame,
    id_col: str = "id",
    label: str = "label",
    fraction: float = 0.2,
    seed: int = 42,
    out: str = "is_test",
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """Flag exactly the wanted number of rows of each class as test rows.

    Up to ``FEW_CLASSES`` classes the cuts are literals. Beyond that rows are ranked within their class
    in one shuffle, and only classes of more than ``sorted_rows`` rows get a table of cuts. Both give
    the same rows.
    """
    sizes = _written(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")), "sizes")
    if sizes.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES:
        want: Counts = {}

        def ranks(sizes: Counts) -> Ranks:
            want.update(held_out_sizes(sizes, fraction))
            return {k: [n] for k, n in want.items()}

        _, cuts = hash_cutoffs(df, id_col, label, seed, ranks, sorted_rows)
        flag = _upto(label, {k: cut for (k, _), cut in cuts.items()})
        return df.withColumn("_key", row_hash(seed, F.col(id_col))).withColumn(out, flag).drop("_key")
    if missing := sizes.where("label is null").agg(F.sum("n")).first()[0]:
        raise ValueError(f"{missing} rows have no {label}")
    rank = held_out_ranks(sizes, fraction)
    # Classes that one task sorts are ranked where their rows meet; their sizes are told there too.
    large = settled(sizes.where(F.col("n") > sorted_rows))
    rows, parts = df, []
    if not large.isEmpty():
        wanted = large.select("label", rank(F.col("n"), F.col("label")).alias("rank")).where("rank > 0")
        cuts = class_cuts(df, id_col, label, seed, settled(wanted), sorted_rows)
        # At most rows / sorted_rows classes; one without test rows has no cut.
        cuts = large.select("label").join(cuts, "label", "left").select(F.col("label").alias("_label"), "cut", F.lit(True).alias("_large"))
        joined = df.join(_near(cuts), F.col(label) == F.col("_label"), "left")
        flagged = joined.where("_large").withColumn(out, F.coalesce(row_hash(seed, F.col(id_col)) <= F.col("cut"), F.lit(False)))
        parts.append(flagged.select(*df.columns, out))
        rows = joined.where("_large is null").select(*df.columns)
    same = Window.partitionBy(label)
    # Rows of one id have one rank, so they are on one side.
    keyed = rows.repartition(label).withColumn("_key", F.unhex(row_hash(seed, F.col(id_col))))  # made where it is sorted
    placed = keyed.withColumns({"_n": F.count("*").over(same), "_rank": F.rank().over(same.orderBy("_key"))})
    parts.append(placed.withColumn(out, F.col("_rank") <= rank(F.col("_n"), F.col(label))).select(*df.columns, out))
    return reduce(DataFrame.unionByName, parts)


def fold_sizes(sizes: Counts, k: int) -> dict[object, list[int]]:
    """Rows of each class in each fold: positions of the label-sorted rows dealt out in turn."""
    out, start = {}, 0
    for klass in sorted(sizes):
        end = start + sizes[klass]
        out[klass] = [len(range(start + (f - start) % k, end, k)) for f in range(k)]
        start = end
    return out


def stratified_folds(
    df: DataFrame,
    k: int = 5,
    id_col: str = "id",
    label: str = "label",
    seed: int = 42,
    out: str = "fold",
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """The fold (0..k-1) of each row; per class, folds are consecutive runs in hash order."""
    last: dict[object, list[int]] = {}

    def ranks(sizes: Counts) -> Ranks:
        for klass, parts in fold_sizes(sizes, k).items():
            last[klass] = [sum(parts[: f + 1]) for f in range(k)]
        return {klass: sorted(set(ends)) for klass, ends in last.items()}

    _, cuts = hash_cutoffs(df, id_col, label, seed, ranks, sorted_rows)
    fold = F.lit(None).cast("int")
    for klass, ends in last.items():
        inner = F.lit(k - 1)
        for f in range(k - 2, -1, -1):
            if ends[f] > (ends[f - 1] if f else 0):
                inner = F.when(F.col("_key") <= cuts[klass, ends[f]], F.lit(f)).otherwise(inner)
        fold = F.when(F.col(label) == klass, inner).otherwise(fold)
    return df.withColumn("_key", row_hash(seed, F.col(id_col))).withColumn(out, fold).drop("_key")


def sample_per_class(
    df: DataFrame,
    per_class: int = 5,
    id_col: str = "id",
    label: str = "label",
    seed: int = 99,
) -> DataFrame:
    """L4 / O2: the ``per_class`` rows of each class with the lowest hashes (all, if fewer).

    One scan: every task keeps its own lowest rows of each class before the shuffle.
    """
    lowest = Window.partitionBy(label).orderBy(row_hash(seed, F.col(id_col)), id_col, F.xxhash64(*df.columns))
    placed = df.withColumn("_place", F.row_number().over(lowest))
    return placed.filter(F.col("_place") <= per_class).drop("_place")


def shuffled(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Rows in hash order, for output only."""
    return df.orderBy(row_hash(seed, F.col(id_col)), id_col)
