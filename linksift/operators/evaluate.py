"""Confusion counts, scores, ROC curves and AUC over a long table of predictions.

Input rows are (model, label, prediction, score); all models are evaluated in one pass (O3).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linksift.operators.running import (
    ROWS_PER_RANGE,
    cut_points,
    running_totals,
    with_range,
)
from linksift.session import settled

CELLS = ["c00", "c01", "c10", "c11"]
SCORES = ["accuracy", "precision", "recall", "f1_score"]


def stack_models(
    df: DataFrame, models: dict[str, tuple[Column, Column]], keep: list[str]
) -> DataFrame:
    """O3: one row per (row, model) from side-by-side (prediction, score) columns, in one scan."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("model"), p.cast("int").alias("prediction"),
                     s.cast("double").alias("score"))
            for name, (p, s) in models.items()
        ]
    )
    return df.select(*keep, F.inline(rows))


def union_models(tables: dict[str, DataFrame]) -> DataFrame:
    """O3 for predictions that live in separate tables."""
    tagged = [df.withColumn("model", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged)


def confusion(predictions: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """A4: counts c<actual><predicted>; cells stay 0 when a class is missing.

    A row whose label or prediction is neither 0 nor 1 fails the job instead of being left out.
    """
    told = F.concat_ws(" ", F.lit("a label or prediction is not 0 or 1:"), "label", "prediction")
    known = F.col("label").isin(0, 1) & F.col("prediction").isin(0, 1)
    cell = F.when(F.coalesce(known, F.lit(False)), F.col("label") * 2 + F.col("prediction"))
    cell = F.coalesce(cell.cast("int"), F.raise_error(told).cast("int"))
    hit = lambda y, p: F.count_if(F.col("_cell") == 2 * y + p)
    return predictions.withColumn("_cell", cell).groupBy(*keys).agg(
        *[hit(int(c[1]), int(c[2])).alias(c) for c in CELLS]
    )


def scores(cells: DataFrame, positive_class: int = 1, digits: int | None = 4) -> DataFrame:
    """A5-A8 from confusion counts; an undefined ratio is 0."""
    if positive_class not in (0, 1):
        raise ValueError("positive_class must be 0 or 1")
    tp, fp, fn = ("c11", "c01", "c10") if positive_class else ("c00", "c10", "c01")
    tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
    every = reduce(Column.__add__, [F.col(c) for c in CELLS])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    columns = {
        "accuracy": ratio(F.col("c00") + F.col("c11"), every),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
    }
    if digits is not None:
        columns = {name: F.round(c, digits) for name, c in columns.items()}
    return cells.withColumns(columns)


def score_counts(predictions: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """The confusion counts of each distinct score: the only scan and shuffle of all rows.

    Every measure below is a reduction of this table. Rows are summed before the shuffle, so
    a score that a third of all rows share costs no more than any other.
    """
    score = F.col("score").cast("double")
    checked = F.when(
        score.isNull() | F.isnan(score) | F.col("label").isNull(),
        F.raise_error(F.lit("a prediction without score or label cannot be ranked")).cast("double"),
    ).otherwise(score)
    return settled(
        confusion(
            predictions.select(*keys, checked.alias("score"), "label", "prediction"),
            (*keys, "score"),
        )
    )


def _classes(counts: DataFrame, positive_class: int) -> DataFrame:
    """Counts per score as positives ``tp`` and negatives ``fp`` at or above a threshold there."""
    sides = {1: F.col("c10") + F.col("c11"), 0: F.col("c00") + F.col("c01")}
    return counts.withColumns({"tp": sides[positive_class], "fp": sides[1 - positive_class]})


def roc_curve(
    predictions: DataFrame,
    keys: tuple[str, ...] = ("model",),
    positive_class: int = 1,
    thin: bool = True,
    rows_per_range: int = ROWS_PER_RANGE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(rank, threshold, fpr, tpr) per model, from (0, 0) at an infinite threshold.

    ``thin`` drops the inner points of straight runs: a point goes when its steps in both
    rates equal the steps of the point after it. ``rank`` numbers the distinct scores from the
    highest down, 0 being the start point. A rate without any such class is null.
    """
    names = list(keys)
    counts = score_counts(predictions, keys) if counts is None else counts
    cuts = cut_points(counts, "score", rows_per_range)
    steps = _classes(counts, positive_class).select(
        *names, "score", "tp", "fp", F.lit(1).cast("bigint").alias("n")
    )
    points = running_totals(steps, names, "score", ["tp", "fp", "n"], cuts, ascending=False)
    is_edge = (F.col("before_n") == 0) | F.col("_next").isNull()
    bends = (F.col("_next.tp") != F.col("tp")) | (F.col("_next.fp") != F.col("fp"))
    if thin:
        points = points.filter(is_edge | bends)
    point = F.struct(
        (F.col("before_n") + 1).alias("rank"),
        F.col("score").alias("threshold"),
        F.try_divide(F.col("before_fp") + F.col("fp"), F.col("all_fp")).alias("fpr"),
        F.try_divide(F.col("before_tp") + F.col("tp"), F.col("all_tp")).alias("tpr"),
    )
    start = F.struct(
        F.lit(0).cast("bigint").alias("rank"),
        F.lit(float("inf")).alias("threshold"),
        F.try_divide(F.lit(0.0), F.col("all_fp")).alias("fpr"),
        F.try_divide(F.lit(0.0), F.col("all_tp")).alias("tpr"),
    )
    # The first row of a model brings the start point along, so no second pass is needed.
    both = F.when(F.col("before_n") == 0, F.array(start, point)).otherwise(F.array(point))
    return points.select(*names, F.inline(both))


def bounded_curve(curve: DataFrame, step: float = 0.01, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """A curve of at most 4 / ``step`` + 4 points, whatever the number of scores.

    The rates are cut into squares of side ``step``; of the points in a square the first and the last
    stay. The curve rises, so it meets at most 2 / ``step`` + 1 squares, and between two points that stay
    it leaves their line by less than ``step`` in both rates; the area differs by at most ``step``,
    since half a square is lost at most in each. Points are summed up per square before the shuffle.
    A curve whose rates are null (no row of a class) keeps its first and last point.
    """
    names = list(keys)
    square = [F.floor(F.col(rate) / step).alias(f"_{rate}") for rate in ("fpr", "tpr")]
    point = F.struct("rank", "threshold", "fpr", "tpr")
    ends = curve.groupBy(*names, *square).agg(F.min(point).alias("first"), F.max(point).alias("last"))
    both = F.array_distinct(F.array("first", "last"))
    return ends.select(*names, F.inline(both))


def curve_area(curve: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """The area under a bounded curve, by trapezoids over its few points."""
    ahead = Window.partitionBy(*keys).orderBy("rank")
    strip = (F.col("fpr") - F.lag("fpr").over(ahead)) * (F.col("tpr") + F.lag("tpr").over(ahead)) / 2
    return curve.withColumn("_strip", strip).groupBy(*keys).agg(F.sum("_strip").alias("area"))


def auc(
    predictions: DataFrame,
    keys: tuple[str, ...] = ("model",),
    positive_class: int = 1,
    digits: int | None = 4,
    rows_per_range: int = ROWS_PER_RANGE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """A10: area under the full curve, by trapezoids, in exact whole-number arithmetic.

    Each score range is integrated as if it started at zero; what the ranges above it
    contribute is a rectangle, added from the range totals. No join and no global order.
    """
    names = list(keys)
    counts = score_counts(predictions, keys) if counts is None else counts
    cuts = cut_points(counts, "score", rows_per_range)
    steps = with_range(_classes(counts, positive_class), "score", cuts)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda c: F.col(c).cast("decimal(19,0)")

    in_range = Window.partitionBy(*names, "_range").orderBy(F.col("score").desc())
    local = steps.withColumn("above", F.coalesce(F.sum("tp").over(ahead(in_range)), F.lit(0)))
    ranges = local.groupBy(*names, "_range").agg(
        F.sum(whole("fp") * (2 * F.col("above") + F.col("tp")).cast("decimal(19,0)")).alias("area"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
    )
    by_model = Window.partitionBy(*names).orderBy(F.col("_range").desc())
    placed = ranges.withColumn("above", F.coalesce(F.sum("tp").over(ahead(by_model)), F.lit(0)))
    area = F.sum(F.col("area") + 2 * whole("fp") * whole("above")).cast("double")
    value = F.try_divide(area, 2.0 * F.sum("tp").cast("double") * F.sum("fp").cast("double"))
    value = value if digits is None else F.round(value, digits)
    return placed.groupBy(*names).agg(value.alias("auc_roc"))


def evaluate(
    predictions: DataFrame, positive_class: int = 1, counts: DataFrame | None = None
) -> DataFrame:
    """A4-A8 and A10 per model from one scan, as the metrics table without its CV columns."""
    counts = score_counts(predictions) if counts is None else counts
    cells = counts.groupBy("model").agg(*[F.sum(c).alias(c) for c in CELLS])
    matrix = F.array(F.array("c00", "c01"), F.array("c10", "c11")).alias("confusion_matrix")
    areas = auc(predictions, positive_class=positive_class, counts=counts)
    return scores(cells, positive_class).join(areas, "model").select(
        "model", *SCORES, "auc_roc", matrix
    )


def best_model(metrics: DataFrame, order: list[str]) -> DataFrame:
    """The row with the highest F1; on a tie the model listed first in ``order`` wins."""
    place = F.array_position(F.lit(order), F.col("model"))
    return metrics.orderBy(F.col("f1_score").desc(), place.asc(), "model").limit(1)


def cv_summary(folds: DataFrame, digits: int | None = 4) -> DataFrame:
    """Mean and population deviation of the fold accuracies of each model."""
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return folds.groupBy("model").agg(
        shown(F.avg("accuracy")).alias("cv_mean"),
        shown(F.stddev_pop("accuracy")).alias("cv_std"),
    )


def tally(predictions: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """How many predictions are right, out of how many, in percent."""
    right = F.count_if(F.col("prediction") == F.col("label"))
    return predictions.groupBy(*keys).agg(
        right.alias("correct"),
        F.count("*").alias("total"),
        F.round(right * 100.0 / F.count("*"), 0).alias("percent"),
    )
