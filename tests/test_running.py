"""Range-wise running totals against a plain loop, with ties, several keys and a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from linksift.operators.running import cut_points, running_totals, with_range
from linksift.session import settled


def rows(n=3000, seed=3):
    rng = random.Random(seed)
    table = {}
    for _ in range(n):
        key = rng.choice(["hot"] * 4 + ["a", "b"])
        value = round(rng.choice([rng.random(), rng.gauss(0, 1e-6), 0.5]), 9)
        table[key, value] = (rng.randint(0, 5), rng.randint(0, 3))
    return [(k, v, x, y) for (k, v), (x, y) in table.items()]


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("per_range", [50, 10**9])
def test_equals_plain_loop(spark, ascending, per_range):
    data = rows()
    df = settled(spark.createDataFrame(data, "k string, v double, x bigint, y bigint"))
    cuts = cut_points(df, "v", per_range)
    assert bool(cuts) == (per_range == 50)
    got = running_totals(df, ["k"], "v", ["x", "y"], cuts, ascending).collect()
    have = {(r["k"], r["v"]): r for r in got}
    assert len(have) == len(data)
    for key in {k for k, *_ in data}:
        own = sorted((r for r in data if r[0] == key), key=lambda r: r[1], reverse=not ascending)
        bx = by = 0
        for i, (_, v, x, y) in enumerate(own):
            r = have[key, v]
            assert (r["before_x"], r["before_y"]) == (bx, by)
            assert r["all_x"] == sum(o[2] for o in own)
            following = own[i + 1][2:] if i + 1 < len(own) else None
            assert (tuple(r["_next"]) if r["_next"] else None) == following
            bx, by = bx + x, by + y


def test_ranges_are_balanced_under_skew(spark):
    df = settled(spark.createDataFrame(rows(6000), "k string, v double, x bigint, y bigint"))
    cuts = cut_points(df, "v", 100)
    sizes = with_range(df, "v", cuts).groupBy("_range").count().agg(F.max("count")).first()[0]
    assert sizes <= 300


def test_no_single_task_window(spark, capsys):
    df = settled(spark.createDataFrame(rows(), "k string, v double, x bigint, y bigint"))
    running_totals(df, ["k"], "v", ["x"], cut_points(df, "v", 100)).explain()
    plan = capsys.readouterr().out
    assert "SinglePartition" not in plan and "SortAggregate" not in plan
