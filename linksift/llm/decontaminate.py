"""Benchmark passages in documents, by a prefix-filtered set join on word shingles.

An item is read as windows of ``WINDOW`` consecutive words (one shorter window if it has fewer),
and a window as the set of its shingles. Shingles are ordered by rarity: how often each occurs in
the whole corpus. A document that holds a window holds each of its shingles, so the rarest one is a
necessary prefix and the only one joined; a window with a shingle that never occurs is out at once.
A match must leave room for the window before and after it (length and positional bounds), and
then the window's words are compared one by one with the document's.

Texts are lower-cased in A-Z only. Null texts have no words and hit nothing. An item without words
is skipped, one without an id marks words but is not listed. Rows that share a doc_id are judged
each by its own text. Empty tables give no rows, or no hits. Only DataFrame functions are used.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linksift.llm.tables import settle

WINDOW = 13
SHINGLE = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A side of a join is broadcast only up to so many rows (of a hash and a short text).
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """A settled table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingles(rows: DataFrame, size: int) -> DataFrame:
    """One row for each place ``at`` of a shingle of ``size`` words, with its hash."""
    places = F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - size))
    at = [F.get("words", F.col("at") + i) for i in range(size)]
    return rows.withColumn("at", F.explode(places)).withColumn("shingle", F.xxhash64(F.lit(size), *at))


def _all_shingles(rows: DataFrame, sizes: list[int]) -> DataFrame:
    return reduce(DataFrame.union, (_shingles(rows, size) for size in sizes))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, phrase, size): the windows of every item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    size = F.least(F.lit(window), F.size("all"))
    cut = items.select("item_id", "all", size.alias("size")).withColumn(
        "from", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("size") + 1))
    )
    words = F.slice("all", F.col("from"), F.col("size"))
    return cut.select("item_id", words.alias("words"), F.array_join(words, " ").alias("phrase"), "size")


def contamination(
    docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """row (the carried ``columns``), n_words, n_hit, n_items, item_ids and contaminated of every document."""
    spark = docs.sparkSession
    item_words = settle(item_windows(benchmark, window), "item-windows")
    windows = item_words.select("words", "phrase", "size").distinct()
    sizes = sorted(
        r[0] for r in windows.select(F.least("size", F.lit(shingle)).alias("size")).distinct().collect()
    )
    parts = [_shingles(windows.where(F.least("size", F.lit(shingle)) == s), s) for s in sizes]
    empty = spark.createDataFrame([], "words array<string>, phrase string, size int, at int, shingle long")
    own = settle(reduce(DataFrame.union, parts, empty), "item-shingles")

    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").alias("_doc"),
        F.xxhash64(text).alias("_a"),
        F.xxhash64(F.lit(1), text).alias("_b"),
        words_of(F.col("text")).alias("words"),
    )
    wanted = settle(own.select("shingle").distinct(), "wanted")
    seen = _all_shingles(keyed.select("words"), sizes or [shingle]).join(_small(wanted), "shingle")
    rarity = settle(seen.groupBy("shingle").agg(F.count("*").alias("times")), "rarity")

    # The rarest shingle of each window; an inner join would keep windows with unseen shingles.
    ranked = own.join(rarity, "shingle", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    prefix = ranked.groupBy("phrase", "size").agg(
        F.min(F.struct("times", "shingle", F.col("at").alias("inside"))).alias("first")
    )
    prefix = settle(prefix.where("first.times > 0").select("phrase", "size", "first.shingle", "first.inside"), "prefix")

    start = F.col("at") - F.col("inside")
    met = (
        _all_shingles(keyed, sizes or [shingle])
        .join(_small(prefix), "shingle")
        .where((start >= 0) & (start + F.col("size") <= F.size("words")))
        .where(F.array_join(F.slice("words", start + 1, F.col("size")), " ") == F.col("phrase"))
        .select("_doc", "_a", "_b", "phrase", F.struct(start.alias("start"), (start + F.col("size")).alias("stop")).alias("span"))
    )
    named = met.join(_small(settle(item_words.select("phrase", "item_id").distinct(), "phrases")), "phrase")
    hits = named.groupBy("_doc", "_a", "_b").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'upto', 0), (acc, s) -> named_struct("
        "'n', acc.n + greatest(0, s.stop - greatest(s.start, acc.upto)), 'upto', greatest(acc.upto, s.stop)), acc -> acc.n)"
    )
    hits = hits.select("_doc", "_a", "_b", covered.alias("n_hit"), "item_ids")
    base = docs.select(
        F.struct(*columns).alias("row"),
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.col("doc_id").alias("_id"),
        F.xxhash64(text).alias("_x"),
        F.xxhash64(F.lit(1), text).alias("_y"),
    )
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return base.join(hits, same, "left").select(
        "row",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
