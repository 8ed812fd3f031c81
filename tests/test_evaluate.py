"""Evaluation against recorded confusion matrices and against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linksift.operators import evaluate as E
from linksift.operators import report as R

# Recorded results: tn, fp, fn, tp and the four scores to 4 decimals.
RECORDED = {
    "Logistic Regression": (944, 56, 40, 960, 0.9520, 0.9449, 0.9600, 0.9524),
    "Random Forest": (984, 16, 17, 983, 0.9835, 0.9840, 0.9830, 0.9835),
    "SVM": (961, 39, 23, 977, 0.9690, 0.9616, 0.9770, 0.9692),
    "Boosted": (985, 15, 13, 987, 0.9860, 0.9850, 0.9870, 0.9860),
}


def replay(spark):
    rows = []
    for model, (tn, fp, fn, tp, *_) in RECORDED.items():
        rows += [(model, 0, 0)] * tn + [(model, 0, 1)] * fp + [(model, 1, 0)] * fn
        rows += [(model, 1, 1)] * tp
    return spark.createDataFrame(rows, "model string, label int, prediction int").withColumn(
        "score", F.col("prediction").cast("double")
    )


def test_recorded_matrices(spark):
    got = {r["model"]: r for r in E.scores(E.confusion(replay(spark))).collect()}
    for model, (tn, fp, fn, tp, *want) in RECORDED.items():
        r = got[model]
        assert [r[c] for c in E.CELLS] == [tn, fp, fn, tp]
        assert [r[s] for s in E.SCORES] == want
    best = E.best_model(E.scores(E.confusion(replay(spark))), list(RECORDED)).first()
    assert best["model"] == "Boosted"


def test_other_polarity_swaps_the_roles(spark):
    got = {r["model"]: r for r in E.scores(E.confusion(replay(spark)), 0, None).collect()}
    tn, fp, fn, tp = RECORDED["SVM"][:4]
    assert got["SVM"]["precision"] == tn / (tn + fn)
    assert got["SVM"]["recall"] == tn / (tn + fp)


def test_first_model_wins_ties(spark):
    df = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "model string, f1_score double")
    assert E.best_model(df, ["c", "b", "a"]).first()["model"] == "b"


def plain_roc(rows, thin, positive=1):
    counts = {}
    for y, s in rows:
        up, down = counts.get(s, (0, 0))
        counts[s] = (up + (y == positive), down + (y != positive))
    p, n = (sum(c[i] for c in counts.values()) for i in (0, 1))
    points, tp, fp = [], 0, 0
    for score in sorted(counts, reverse=True):
        tp, fp = tp + counts[score][0], fp + counts[score][1]
        points.append((score, fp, tp))
    kept = [
        (i + 1, *points[i])
        for i in range(len(points))
        if not thin
        or i in (0, len(points) - 1)
        or counts[points[i][0]] != counts[points[i + 1][0]]
    ]
    return [(0, math.inf, 0.0, 0.0)] + [(r, s, f / n, t / p) for r, s, f, t in kept]


def sample(seed, n=2000, levels=None):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        s = min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2)))
        rows.append((y, round(s * levels) / levels if levels else s))
    return rows


@pytest.mark.parametrize("thin", [True, False])
@pytest.mark.parametrize("per_range", [40, 10**9])
def test_roc_and_auc_equal_plain_loops(spark, thin, per_range):
    data = {"fine": sample(1), "ties": sample(2, levels=37), "two": sample(3, levels=1)}
    df = spark.createDataFrame(
        [(m, y, int(s >= 0.5), s) for m, rows in data.items() for y, s in rows],
        "model string, label int, prediction int, score double",
    ).repartition(7)
    got = E.roc_curve(df, thin=thin, rows_per_range=per_range).orderBy("model", "rank").collect()
    areas = {
        r["model"]: r["auc_roc"] for r in E.auc(df, digits=None, rows_per_range=per_range).collect()
    }
    for model, rows in data.items():
        curve = [tuple(r)[1:] for r in got if r["model"] == model]
        assert curve == plain_roc(rows, thin)
        ups, downs = [s for y, s in rows if y], [s for y, s in rows if not y]
        wins = sum((u > d) + 0.5 * (u == d) for u in ups for d in downs)
        assert areas[model] == pytest.approx(wins / (len(ups) * len(downs)), abs=1e-12)
    flipped = E.auc(df, positive_class=0, digits=None, rows_per_range=per_range).collect()
    assert {r["model"]: round(1 - r["auc_roc"], 9) for r in flipped} == {
        m: round(a, 9) for m, a in areas.items()
    }


def test_missing_class_and_missing_score(spark):
    only = spark.createDataFrame(
        [("m", 1, 1, 0.9), ("m", 1, 0, 0.2)], "model string, label int, prediction int, score double"
    )
    cells = E.confusion(only).first()
    assert [cells[c] for c in E.CELLS] == [0, 0, 1, 1]
    assert E.auc(only).first()["auc_roc"] is None
    assert {r["fpr"] for r in E.roc_curve(only).collect()} == {None}
    none = spark.createDataFrame([("m", 0, 0, 0.1)], only.schema)
    assert E.scores(E.confusion(none)).first()["precision"] == 0.0
    gap = spark.createDataFrame([("m", 1, 1, None)], only.schema)
    with pytest.raises(Exception, match="cannot be ranked"):
        E.auc(gap).collect()


def test_stack_equals_union(spark):
    df = spark.range(20).select(
        "id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 20).alias("s")
    )
    stacked = E.stack_models(df, {"a": (F.col("s") > 0.5, F.col("s")), "b": (F.col("s") < 2, F.col("s") / 2)}, ["label"])
    union = E.union_models(
        {
            "a": df.select("label", (F.col("s") > 0.5).cast("int").alias("prediction"), F.col("s").alias("score")),
            "b": df.select("label", F.lit(1).alias("prediction"), (F.col("s") / 2).alias("score")),
        }
    )
    cols = ["model", "label", "prediction", "score"]
    assert sorted(stacked.select(cols).collect()) == sorted(union.select(cols).collect())


def test_report_texts_round_like_printf(spark):
    values = [0.9835, 0.98250, 0.12345, 0.5, 1.0, 0.0, 0.00049]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(R.percent(F.col("v"))).collect()]
    assert got == [f"{v * 100:.1f}%" for v in values]
    fine = [r[0] for r in df.select(F.format_number("v", 4)).collect()]
    assert fine == [f"{v:.4f}" for v in values]
    bars = spark.createDataFrame([(v,) for v in (-0.2, 0.999, 0.125, 1.3)], "v double")
    assert [r[0] for r in bars.select(R.percent_bar(F.col("v"))).collect()] == [0, 99, 12, 100]


@pytest.mark.parametrize("label, prediction", [(2, 1), (None, 1), (1, None), (0, 3)])
def test_labels_and_predictions_are_zero_or_one(spark, label, prediction):
    rows = [("m", 1, 1, 0.5), ("m", label, prediction, 0.5)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int, score double")
    with pytest.raises(Exception, match="not 0 or 1"):
        E.confusion(df).collect()


def test_null_is_not_judged(spark):
    df = spark.createDataFrame([(None, None, None)], "prediction int, label int, score double")
    p, y, s = F.col("prediction"), F.col("label"), F.col("score")
    told = df.select(R.class_name(p), R.hit_mark(p, y), R.confidence(p, s), R.yes_no(p)).first()
    assert tuple(told) == (None,) * 4


@pytest.mark.parametrize("step", [0.3, 0.05, 0.004])
def test_bounded_curves_stay_within_their_error(spark, step):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 4000)
    scores = np.round(labels * 0.4 + rng.normal(size=4000), 4)
    rows = [("m", int(y), int(s > 0), float(s)) for y, s in zip(labels, scores)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int, score double")
    whole = [(r["fpr"], r["tpr"]) for r in E.roc_curve(df, thin=False).orderBy("rank").collect()]
    few = E.bounded_curve(E.roc_curve(df, thin=False), step)
    points = [(r["fpr"], r["tpr"]) for r in few.orderBy("rank").collect()]
    assert len(points) <= 4 / step + 4 and points[0] == (0, 0) and points[-1] == (1, 1) and set(points) <= set(whole)
    x, y = np.array(points).T
    for fpr, tpr in whole:
        assert np.hypot(x - fpr, y - tpr).min() <= np.sqrt(2) * step
        low, high = y[np.searchsorted(x, fpr, "left") - 1 if fpr > 0 else 0], y[min(len(y) - 1, np.searchsorted(x, fpr, "right"))]
        assert low - 1e-12 <= tpr <= high + 1e-12
    exact = E.auc(df, digits=None).first()["auc_roc"]
    assert abs(E.curve_area(few).first()["area"] - exact) <= step
