"""Report and chart-ready tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linksift.functions.vocabulary import FEATURE_TITLES, RISK_LIMITS, RISK_MARKS
from linksift.operators.evaluate import best_model

# Shown metric names.
METRIC_TITLES = {
    "accuracy": "Accuracy",
    "precision": "Precision",
    "recall": "Recall",
    "f1_score": "F1-Score",
    "auc_roc": "AUC-ROC",
}


def yes_no(flag: Column) -> Column:
    return F.when(flag == 1, "Yes").when(flag.isNotNull(), "No")


def risk_flags(features: DataFrame, keys: list[str]) -> DataFrame:
    """P10: one row per (URL, judged feature) with the shown value and its class.

    A URL without features (a null one) has a null value and a null class.
    """
    items = {
        title: (
            F.col(name).cast("string"),
            F.when(F.col(name) > limit, "warn").when(F.col(name).isNotNull(), ""),
        )
        for title, name, limit in RISK_LIMITS
    }
    items |= {
        title: (yes_no(F.col(name)), F.when(F.col(name) == 1, yes).when(F.col(name).isNotNull(), no))
        for title, name, yes, no in RISK_MARKS
    }
    rows = F.array(
        *[
            F.struct(F.lit(title).alias("feature"), value.alias("value"), klass.alias("severity"))
            for title, (value, klass) in items.items()
        ]
    )
    return features.select(*keys, F.inline(rows))


def key_features(features: DataFrame, keys: list[str]) -> DataFrame:
    """The eight features shown beside a verdict."""
    return features.select(
        *keys,
        F.col("url_length"),
        yes_no(F.col("has_https")).alias("uses_https"),
        F.col("num_dots"),
        F.col("num_hyphens"),
        yes_no(F.col("suspicious_tld")).alias("suspicious_tld"),
        yes_no(F.col("has_ip")).alias("has_ip"),
        yes_no(F.col("has_login")).alias("has_login"),
        yes_no(F.col("has_secure")).alias("has_secure"),
    )


def class_name(
    column: Column, positive: str = "PHISHING", negative: str = "SAFE", positive_class: int = 1
) -> Column:
    """The name of a class, null for null; which class is the positive one is up to the caller."""
    return F.when(column == positive_class, positive).when(column.isNotNull(), negative)


def confidence(prediction: Column, score: Column) -> Column:
    """Probability of the predicted class, from the probability of class 1; null for null."""
    return F.when(prediction == 1, score).when(prediction.isNotNull(), 1.0 - score)


def top_confidence(score: Column) -> Column:
    """P8, second form: the larger of the two probabilities."""
    return F.greatest(score, 1.0 - score)


def percent_bar(confidence_value: Column) -> Column:
    """Whole percent, cut off and clamped to 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), (confidence_value * 100).cast("int")))


def hit_mark(prediction: Column, label: Column) -> Column:
    """P12; null where either side is null."""
    return F.when(prediction == label, "OK").when(prediction != label, "MISS")


def feature_title(feature: Column) -> Column:
    """The shown name of a feature, or the name itself."""
    pairs = [F.lit(text) for pair in FEATURE_TITLES.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), feature), feature)


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(value * 100, digits), F.lit("%"))


def metric_long(metrics: DataFrame) -> DataFrame:
    """One row per model and metric."""
    long = metrics.unpivot(["model"], list(METRIC_TITLES), "metric", "value")
    pairs = [F.lit(text) for pair in METRIC_TITLES.items() for text in pair]
    return long.withColumn("metric", F.create_map(*pairs)[F.col("metric")])


def confusion_long(
    cells: DataFrame, class_names: tuple[str, str] = ("Safe", "Phishing")
) -> DataFrame:
    """One row per model, actual and predicted class; names are given for 0 and 1."""
    rows = F.array(
        *[
            F.struct(
                F.lit(class_names[a]).alias("actual"),
                F.lit(class_names[p]).alias("predicted"),
                F.col(f"c{a}{p}").alias("n"),
            )
            for a in (0, 1)
            for p in (0, 1)
        ]
    )
    return cells.select("model", F.inline(rows))


def summary_table(metrics: DataFrame, order: list[str]) -> DataFrame:
    """Formatted rows with the best row (by shown F1) marked; one row per model."""
    shown = {m: F.format_number(F.coalesce(m, F.lit(0.0)), 4) for m in METRIC_TITLES}
    spread = F.concat(
        F.format_number("cv_mean", 4), F.lit(" ± "), F.format_number("cv_std", 4)
    ).alias("cv")
    place = F.array_position(F.lit(order), F.col("model"))
    first = Window.orderBy(F.col("f1_score").cast("double").desc(), place, "model")
    return metrics.select(
        "model", *[c.alias(m) for m, c in shown.items()], spread
    ).withColumn("is_best", F.row_number().over(first) == 1)


def performance_table(metrics: DataFrame) -> DataFrame:
    """Percentages with one digit, F1 with four; a missing AUC counts as 0."""
    return metrics.select(
        "model",
        percent(F.col("accuracy")).alias("accuracy"),
        percent(F.col("precision")).alias("precision"),
        percent(F.col("recall")).alias("recall"),
        F.format_number("f1_score", 4).alias("f1_score"),
        percent(F.coalesce("auc_roc", F.lit(0.0))).alias("auc_roc"),
    )


def metric_cards(metrics: DataFrame, order: list[str], links: DataFrame) -> DataFrame:
    """The best model, its accuracy and the counted size of the data set."""
    best = best_model(metrics, order).select(
        F.col("model").alias("best_model"), percent(F.col("accuracy")).alias("accuracy")
    )
    return best.withColumn("n_links", links.agg(F.count("*")).scalar())


def ranked_importance(importance: DataFrame, top: int | None = None) -> DataFrame:
    """L1, L2: largest first, ties by feature position; the first ``top`` if given."""
    ordered = importance.orderBy(F.col("importance").desc(), "position")
    return ordered if top is None else ordered.limit(top)


def importance_chart(importance: DataFrame) -> DataFrame:
    """L3 / C4: shown names, smallest first."""
    return importance.select(
        feature_title(F.col("feature")).alias("feature"), "importance", "position"
    ).orderBy("importance", F.col("position").desc())
