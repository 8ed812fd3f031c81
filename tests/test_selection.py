"""Exact values at ranks against a sort."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linksift.operators import selection
from linksift.operators.running import cut_points
from linksift.session import settled


def columns(n=4000, seed=1):
    rng = random.Random(seed)
    odd = [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308, None, float("nan")]
    return {
        "spread": [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-200), rng.gauss(0, 1e200)]) for _ in range(n)],
        "ties": [float(rng.choice([0, 0, 0, 1, 7])) for _ in range(n)],
        "odd": [rng.choice(odd) for _ in range(n)],
        "none": [None] * n,
        "close": [1.0 + rng.randrange(3000) * 2.0**-52 for _ in range(n)],
    }


def test_keys_keep_the_order():
    values = np.array(sorted([0.0, 1.0, -1.0, 5e-324, -5e-324, 1e300, -1e300, math.inf, -math.inf, 2.0**-52]))
    keys = selection.keys_of(values)
    assert (np.diff(keys) > 0).all() and (selection.values_of(keys) == values).all()
    assert selection.keys_of(np.array([-0.0]))[0] == selection.keys_of(np.array([0.0]))[0]


@pytest.mark.parametrize("last_rows", [0, 50, 10**6])
def test_values_at_ranks(spark, last_rows, monkeypatch):
    monkeypatch.setattr(selection, "HELD", 500)
    table = columns()
    df = settled(spark.createDataFrame(list(zip(*table.values())), ", ".join(f"{c} double" for c in table)).repartition(5))
    ranks = {c: [0, 1, 17, 999, 2000, 2001, 3999, 10**9] for c in table}
    got = selection.values_at(df, ranks, last_rows)
    for c, values in table.items():
        ordered = sorted(v for v in values if v is not None and not math.isnan(v))
        assert got[c] == {r: ordered[r] + 0.0 for r in ranks[c] if r < len(ordered)}
    assert selection.values_at(df, {"ties": []}) == {"ties": {}}


def test_more_ranges_than_a_sketch_would_cut(spark):
    """Over 10,000 ranges, all of the same size, from one narrowing."""
    df = settled(spark.range(0, 120_000, 1, 8).select((F.col("id") * F.col("id")).cast("double").alias("v")))
    cuts = cut_points(df, "v", 10)
    assert len(cuts) == 11_999
    assert cuts == [float((10 * i) ** 2) for i in range(1, 12_000)]
