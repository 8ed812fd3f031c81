"""Mixing sources to target weights by entropy balancing.

Each source is to give a number of words (``targets``): its share by weight of ``share`` times all
words, at most ``most`` times its own, the excess going to the others by weight. Among all rates r of
its documents that meet the target, entropy balancing takes those nearest to one pass over the source,
sum r (log r - 1) at its least with 0 <= r <= most. Its dual is convex with one multiplier per source:
r = min(most, exp(lambda * size / mean size)). Newton steps on all sources at once, one grouped sum a
step over the counts per (source, size), kept within brackets, bring the words of every source to
half a word of its target. The sums are of decimals, so their order does not matter and reruns agree.

The rates become copies class by class, a class being the documents of one source and size: from the
longest to the shortest, a class takes the whole number of copies nearest to what its rate and the
error left by the classes before ask for. What is left in the end, less than a document, is added to
or cut from one document (the longest class that can bear it). Inside a class the copies go round,
and those that do not go round to the documents with the least hashes of (doc_id, text).

A source's classes meet in one task: d different sizes need d * d / 2 words, so they are few beside
its documents. A null text has no words, as one without any; documents without words take none and
sources without words have the target 0. A null source is one source, the last in the order. Repeated
rows are documents of their own; equal ones may swap copies. An empty table gives no rows. Texts are
counted whole. Carried columns travel in the struct ``row``, so that no names clash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linksift.llm.ranks import place_of, running_within, small
from linksift.llm.tables import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 42
STEPS = 100


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered_sources(rows: DataFrame) -> DataFrame:
    """(source, s, words): the sources by code point, null last, numbered from 0 by ranges."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("words"))
    order = sums.orderBy(F.col("source").asc_nulls_last()).select("source", "words", F.monotonically_increasing_id().alias("at"))
    order = settle(order, "sources")
    part = F.shiftright("at", 33)
    counts = order.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    s = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return settle(order.withColumn("part", part).join(F.broadcast(starts), "part").select("source", s.alias("s"), "words"), "sources")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target``: weight times a common level, at most ``most`` times the source's words.

    Each pass gives what the full sources cannot take to the others, by weight, until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("room", most * F.col("words"))
    goal, level = share * (sources.agg(F.sum("words")).first()[0] or 0), 0.0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("room")
        told = weighed.agg(F.sum(F.when(full, F.col("room"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        then = (goal - (told["held"] or 0)) / told["free"] if told["free"] else level
        if then <= level:
            break
        level = then
    return weighed.select("source", "s", "words", F.least(F.col("weight") * F.lit(level), F.col("room").cast("double")).alias("target"))


def _exact(amount: Column) -> Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(amount.cast("decimal(28,6)")).cast("double")


def tilts(classes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(s, lam, mean, target, words): the multiplier of each source with words, by Newton's method."""
    means = classes.groupBy("s").agg((F.sum(F.col("docs") * F.col("size")) / F.sum("docs")).alias("mean"))
    state = sources.where("words > 0").join(small(settle(means, "means")), "s").select(
        "s", "mean", "target", "words", F.log(F.greatest(F.col("target") / F.col("words"), F.lit(1e-9))).alias("lam"),
        F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
        # At the most that the source can give, every rate is at its limit.
        (F.col("target") >= most * F.col("words")).alias("done"),
    )
    state = settle(state, "state")
    for _ in range(STEPS):
        met = classes.join(small(state.where("not done")), "s")
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("docs") * F.col("size")
        sums = met.groupBy("s").agg(
            _exact(words * F.least(tilt, F.lit(float(most)))).alias("got"),
            _exact(F.when(tilt < most, words * x * tilt).otherwise(0.0)).alias("slope"),
        )
        error = F.col("target") - F.col("got")
        lo = F.when(error > 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(error > 0, F.col("hi")).otherwise(F.col("lam"))
        step = F.when(F.col("slope") > 0, error / F.col("slope")).otherwise(F.signum(error))
        newton = F.col("lam") + F.greatest(F.lit(-4.0), F.least(F.lit(4.0), step))
        inside = (newton > lo) & (newton < hi)
        then = F.when(inside, newton).otherwise((lo + hi) / 2)
        found = F.abs(error) <= F.greatest(F.lit(0.5), 1e-9 * F.col("target"))
        moved = state.join(small(settle(sums, "sums")).withColumnRenamed("s", "_s"), F.col("s") == F.col("_s"), "left")
        now = F.coalesce(found, F.col("done"))
        stuck = now | (then == F.col("lam"))
        state = moved.select(
            "s", "mean", "target", "words",
            F.when(now, F.col("lam")).otherwise(then).alias("lam"),
            F.when(now, F.col("lo")).otherwise(lo).alias("lo"), F.when(now, F.col("hi")).otherwise(hi).alias("hi"),
            stuck.alias("done"),
        )
        state = settle(state, "state")
        if state.where("not done").isEmpty():
            break
    return state.select("s", "lam", "mean", "target", "words")


def _rounded(most: int):
    """Rounds the classes of one source, from the longest to the shortest."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ascending=False, ignore_index=True)
        target, asked, given, copies = frame["target"].iloc[0], 0.0, 0, []
        for size, docs, rate in zip(frame["size"].tolist(), frame["docs"].tolist(), frame["rate"].tolist()):
            asked += docs * size * rate
            count = min(most * docs, max(0, round((asked - given) / size)))
            given += count * size
            copies.append(count)
        frame["given"], frame["part"] = copies, 0
        left = round(target) - given
        if left > 0:
            able = (frame["given"] < most * frame["docs"]) & (frame["size"] >= left)
        else:
            able = (frame["given"] > 0) & (frame["size"] >= -left)
        if left and able.any():
            frame.loc[able.idxmax(), "part"] = left
        return frame[["s", "size", "docs", "given", "part"]]

    return work


def rounded_classes(classes: DataFrame, tilted: DataFrame, most: int = MOST) -> DataFrame:
    """(s, size, docs, given, part): the copies of each class, and the words added to or cut from one document."""
    rate = F.when(F.col("target") >= most * F.col("words"), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))
    )
    rated = classes.join(tilted, "s").select("s", "size", "docs", "target", rate.alias("rate"))
    return rated.groupBy("s").applyInPandas(_rounded(most), "s long, size long, docs long, given long, part long")


def mix(
    docs: DataFrame, carried: list[Column], source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """row (the carried columns), size, source_size, target, copies and taken of every document.

    ``copies`` is the number of whole copies; ``taken`` the words of all, with the part of the one
    document of a source that is added to or cut. At most ``most`` times a document is taken.
    """
    read = docs.select(F.struct(*carried).alias("row"), F.col(source).alias("source"), words_in(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash"))
    rows = settle(read.withColumn("no", F.monotonically_increasing_id()), "sizes")
    sources = settle(targets(numbered_sources(rows), weights, share, most), "targets")
    of = small(sources.select(F.col("source").alias("_source"), "s", F.col("words").alias("source_size"), "target"))
    rows = settle(rows.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source"), "rows")
    classes = settle(rows.where("size > 0").groupBy("s", "size").agg(F.count("*").alias("docs")), "classes")
    given = settle(rounded_classes(classes, tilts(classes, sources, most), most), "given")
    uneven = (F.col("given") % F.col("docs") != 0) | (F.col("part") != 0)
    whole = small(given.where(~uneven).select("s", "size", (F.col("given") / F.col("docs")).cast("long").alias("copies")))
    even = rows.where("size > 0").join(whole, ["s", "size"]).withColumn("taken", F.col("copies") * F.col("size"))
    parted = settle(rows.join(small(given.where(uneven)), ["s", "size"]), "uneven")
    parted = running_within(parted, ["s", "size"], place_of("hash"), ["hash", "no"], "at")
    copies = F.floor(F.col("given") / F.col("docs")) + F.when(F.col("at") < F.col("given") % F.col("docs"), 1).otherwise(0)
    # Words are added to the last of a class, which has the fewest copies, and cut from the first.
    added = F.when((F.col("part") > 0) & (F.col("at") == F.col("docs") - 1), F.col("part")).when((F.col("part") < 0) & (F.col("at") == 0), F.col("part"))
    parted = parted.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size") + F.coalesce(added, F.lit(0)))
    none = rows.where("size = 0").withColumns({"copies": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")})
    columns = ["row", "size", "source_size", "target", "copies", F.col("taken").cast("long").alias("taken")]
    return even.select(*columns).union(parted.select(*columns)).union(none.select(*columns))
