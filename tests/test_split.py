"""Exact splits, folds and samples against plain sorting."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linksift.operators import split as S


def digest(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def table(spark, n=3000, parts=8):
    label = F.when(F.col("id") % 7 < 2, 1).otherwise(0)
    return spark.range(0, n, numPartitions=parts).withColumn("label", label)


def by_class(n, seed):
    out = {0: [], 1: []}
    for i in range(n):
        out[1 if i % 7 < 2 else 0].append(i)
    return {k: sorted(v, key=lambda i: digest(seed, i)) for k, v in out.items()}


@pytest.mark.parametrize("sorted_rows", [1, 100_000])
def test_split_is_exact(spark, sorted_rows):
    n = 3003
    got = S.stratified_split(table(spark, n), sorted_rows=sorted_rows).collect()
    picked = {r["id"] for r in got if r["is_test"]}
    groups = by_class(n, 42)
    total = math.ceil(0.2 * n)
    assert len(got) == n and len(picked) == total
    sizes = S.held_out_sizes({k: len(v) for k, v in groups.items()}, 0.2)
    assert sum(sizes.values()) == total
    assert picked == {i for k, v in groups.items() for i in v[: sizes[k]]}


@pytest.mark.parametrize("sorted_rows", [1, 100_000])
def test_a_table_of_cuts_gives_the_same_rows(spark, monkeypatch, sorted_rows):
    df = table(spark, 2003).withColumn("label", F.col("id") % 23 % 9)
    few = S.stratified_split(df, sorted_rows=sorted_rows).orderBy("id").collect()
    monkeypatch.setattr(S, "FEW_CLASSES", 3)
    assert S.stratified_split(df, sorted_rows=sorted_rows).orderBy("id").collect() == few
    monkeypatch.setattr(S, "BROADCAST_CLASSES", 0)
    assert S.stratified_split(df, sorted_rows=sorted_rows).orderBy("id").collect() == few
    with pytest.raises(ValueError, match="1 rows have no label"):
        S.stratified_split(df.withColumn("label", F.when(F.col("id") > 0, F.col("label"))))


def test_split_of_thousands_of_classes(spark):
    df = spark.range(0, 20_000, numPartitions=6).withColumn("label", F.col("id") % 3001)
    got = S.stratified_split(df).collect()
    sizes = S.held_out_sizes(Counter(i % 3001 for i in range(20_000)), 0.2)
    picked = {r["id"] for r in got if r["is_test"]}
    want = set()
    for k, n in sizes.items():
        want |= set(sorted(range(k, 20_000, 3001), key=lambda i: digest(42, i))[:n])
    assert len(got) == 20_000 and picked == want


def test_sizes_of_the_parts():
    assert S.held_out_sizes({0: 5000, 1: 5000}, 0.2) == {0: 1000, 1: 1000}
    assert S.held_out_sizes({0: 7, 1: 4}, 0.2) == {0: 2, 1: 1}


def test_partitions_do_not_matter(spark):
    one = S.stratified_split(table(spark, 500, 1)).collect()
    many = S.stratified_split(table(spark, 500, 32)).collect()
    assert sorted(one) == sorted(many)


@pytest.mark.parametrize("n", [3000, 23, 6])
def test_folds(spark, n):
    got = S.stratified_folds(table(spark, n), 5).collect()
    groups = by_class(n, 42)
    ordered = sorted(k for k, v in groups.items() for _ in v)
    want = {k: Counter(f for i, c in enumerate(ordered) if c == k for f in [i % 5]) for k in groups}
    assert {k: Counter(r["fold"] for r in got if r["label"] == k) for k in groups} == want
    fold = {r["id"]: r["fold"] for r in got}
    for rows in groups.values():
        assert [fold[i] for i in rows] == sorted(fold[i] for i in rows)


def test_sample_takes_the_lowest_hashes(spark):
    got = S.sample_per_class(table(spark), 5).collect()
    groups = by_class(3000, 99)
    assert {r["id"] for r in got} == {i for v in groups.values() for i in v[:5]}
    few = S.sample_per_class(table(spark, 3), 5).collect()
    assert len(few) == 3


@pytest.mark.parametrize("sorted_rows", [2, 100_000])
def test_repeated_ids_share_their_part(spark, sorted_rows):
    twice = table(spark, 50).unionByName(table(spark, 50))
    copies = twice.withColumn("id", F.when(F.col("id") < 40, F.lit(7)).otherwise(F.col("id")))
    parts = S.stratified_split(copies, sorted_rows=sorted_rows).groupBy("id", "label")
    assert {r["n"] for r in parts.agg(F.count_distinct("is_test").alias("n")).collect()} == {1}
    with pytest.raises(ValueError, match="have no label"):
        S.stratified_split(table(spark, 9).withColumn("label", F.lit(None).cast("int")))


def test_assignment_needs_no_shuffle(spark, capsys):
    S.stratified_split(table(spark)).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_many_classes_are_ranked_in_one_shuffle(spark, capsys):
    """Neither a join with a table of cuts nor a key in the shuffle, and no row for each class."""
    df = spark.range(0, 5_000).withColumn("label", F.col("id") % 701)
    S.stratified_split(df).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("sorted_rows", [6, 100_000])
def test_classes_of_many_sizes_and_tied_shares(spark, sorted_rows):
    sizes = {f"k{i:03d}": 1 + i % 13 for i in range(150)}
    rows = [(f"{k}/{i}", k) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, label string").repartition(5)
    for fraction in (0.2, 0.5, 0.07):
        got = {r["id"] for r in S.stratified_split(df, fraction=fraction, sorted_rows=sorted_rows).where("is_test").collect()}
        wanted = S.held_out_sizes(sizes, fraction)
        want = set()
        for k, n in sizes.items():
            want |= set(sorted((f"{k}/{i}" for i in range(n)), key=lambda i: digest(42, i))[: wanted[k]])
        assert got == want
