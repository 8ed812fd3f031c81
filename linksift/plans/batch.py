"""The batch run from ids to saved results, stage by stage through tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linksift.functions.urls import split_rejects, with_url_features
from linksift.operators import learners as L
from linksift.operators.evaluate import score_counts
from linksift.plans import training
from linksift.session import numbered, settled
from linksift.sources import schemas, tables
from linksift.sources.links import balanced_links


def _reject(parts: dict[str, DataFrame], out: str) -> None:
    """Rows that a stage could not use, as (reason, row) at ``out``-rejects."""
    told = [
        df.select(F.lit(reason).alias("reason"), F.to_json(F.struct(*df.columns)).alias("row"))
        for reason, df in parts.items()
    ]
    tables.write_json(reduce(DataFrame.unionByName, told), f"{out}-rejects")


def build_links(ids: DataFrame, out: str, seed: int = 42) -> None:
    """Ids -> labelled links at ``out``."""
    tables.write_csv(balanced_links(ids, seed=seed), out)


def build_features(spark: SparkSession, links: str, out: str, has_ids: bool = True) -> None:
    """Labelled links -> features at ``out``, null URLs and unreadable rows at ``out``-rejects.

    A file of only ``url,label`` (``has_ids`` false) gets its row numbers as ids; it comes from
    elsewhere, so its back strokes are text.
    """
    schema = schemas.LINKS if has_ids else schemas.PLAIN_LINKS
    read = tables.read_csv(spark, links, schema, escaped=has_ids)
    rows, unreadable = tables.split_bad_rows(read)
    good, rejected = split_rejects(rows if has_ids else numbered(rows))
    columns = schemas.LINK_FEATURES.names
    tables.write_csv(with_url_features(good).select(*columns), out)
    _reject({"no url": rejected, "unreadable": unreadable}, out)


def train(
    spark: SparkSession,
    features: str,
    out: str,
    settings: L.Settings = L.URL_RUN,
    folds: int = 5,
    has_ids: bool = True,
) -> str:
    """Features -> metrics, curves, importances and the best model at ``out``.

    Rows that cannot be read go to ``out``-rejects. A file without ids (``has_ids`` false) gets its
    row numbers.
    """
    schema = schemas.LINK_FEATURES if has_ids else schemas.PLAIN_FEATURES
    return _train(spark, features, schema, "label", out, settings, folds, has_ids)


def train_pages(
    spark: SparkSession,
    pages: str,
    out: str,
    settings: L.Settings = L.PAGE_RUN,
    folds: int = 5,
) -> str:
    """The same over the 48-column page table, whose class 1 is the legitimate one."""
    return _train(spark, pages, schemas.PAGES, "CLASS_LABEL", out, settings, folds, True)


def _train(spark, path, schema, label, out, settings, folds, has_ids) -> str:
    rows, unreadable = tables.split_bad_rows(tables.read_csv(spark, path, schema))
    incomplete = F.greatest(*[F.col(c).isNull() for c in rows.columns])
    whole = rows.filter(~incomplete)
    _reject({"unreadable": unreadable, "incomplete": rows.filter(incomplete)}, out)
    run = training.compare(settled(whole) if has_ids else numbered(whole), settings, label=label)
    scores = training.cross_validate(run.train, settings, folds)
    counts = score_counts(run.predictions)
    metrics = training.metrics_table(run, scores, counts=counts)
    best = training.save_results(spark, run, metrics, out, counts)
    run.release()
    return best
