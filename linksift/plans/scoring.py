"""Score URLs with a trained model, in a batch or a stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linksift.functions.urls import BLANKS, split_rejects, typed_urls, with_url_features
from linksift.functions.vocabulary import FEATURES
from linksift.operators import learners as L
from linksift.operators import report as R


def score_rejects(df: DataFrame, strip: bool = True, url: str = "url") -> DataFrame:
    """The rows that ``score_links`` leaves out, with the reason; the same for a table and a stream."""
    return df.withColumn("reason", reject_reason(strip, url)).filter(F.col("reason").isNotNull())


def reject_reason(strip: bool = True, url: str = "url") -> Column:
    """Why a row cannot be scored; null if it can."""
    text = F.trim(F.col(url), F.lit(BLANKS)) if strip else F.col(url)
    return F.when(F.col(url).isNull(), "no url").when(F.length(text) == 0, "blank url")


def score_links(
    df: DataFrame,
    model: PipelineModel,
    name: str = L.FOREST,
    prefix: str = "https://",
    strip: bool = True,
    positive_class: int = 1,
    url: str = "url",
) -> DataFrame:
    """Normalise, extract, predict: url, features, verdict, confidence and whole percent.

    Null and blank URLs are never scored; ``score_rejects`` gives them. The plan is the same for a
    static table and a stream: map-only, no state.
    """
    good, _ = split_rejects(df, url)
    scored = model.transform(with_url_features(typed_urls(good, url, prefix, strip), url))
    prediction, score = L.prediction_of(name).cast("int"), L.score_of(name)
    sure = R.confidence(prediction, score)
    return scored.select(
        *df.columns,
        *[f for f in FEATURES if f not in df.columns],
        R.class_name(prediction, positive_class=positive_class).alias("prediction"),
        sure.alias("confidence"),
        R.percent_bar(sure).alias("confidence_percent"),
        score.alias("probability"),
    )
