"""The registered queries: name -> function of (session, data folder)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linksift.functions import urls as U
from linksift.functions import vocabulary as V
from linksift.functions.draws import row_hash
from linksift.operators import evaluate as E
from linksift.operators import learners as L
from linksift.operators import profile as P
from linksift.operators import report as R
from linksift.operators import split as S
from linksift.operators.scale import fit_scaler, scaled_names
from linksift.plans import inputs as I
from linksift.plans import training
from linksift.plans.scoring import reject_reason, score_links, score_rejects
from linksift.session import numbered, scratch_path, settled
from linksift.sources import links as G
from linksift.sources import records, schemas, tables
from linksift.streaming.feed import GOOD, REJECTED, read_split, run_feed, run_split_feed, table_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Settings of the model queries: those of a full run, whose fits read all labelled rows.
RUN, PAGES, SCORER = L.URL_RUN, L.PAGE_RUN, L.APP_RUN
# What a model must reach on labels of which a tenth is wrong, to count as trained.
ACCURACY_FLOOR, AUC_FLOOR = 0.85, 0.8


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return U.with_url_features(I.links(spark, sf)).drop("url")


# --- URL splitting, features, normalising -------------------------------------------------


@query
def url_parts(spark, sf):
    return U.with_url_parts(I.odd_links(spark, sf)).select("id", *U.PARTS)


@query
def url_features(spark, sf):
    return _features(spark, sf)


@query
def url_features_odd_input(spark, sf):
    return U.with_url_features(I.odd_links(spark, sf)).drop("url", "label")


@query
def url_rejects(spark, sf):
    good, bad = U.split_rejects(I.odd_links(spark, sf))
    count = lambda df, kind: df.agg(
        F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count("url").alias("with_url")
    )
    return count(good, "scored").unionByName(count(bad, "rejected"))


@query
def url_normalise_web(spark, sf):
    return U.typed_urls(I.odd_links(spark, sf), prefix="https://", strip=False).select("id", "url")


@query
def url_normalise_console(spark, sf):
    return U.typed_urls(I.odd_links(spark, sf), prefix="http://", strip=True).select("id", "url")


@query
def url_risk_flags(spark, sf):
    return R.risk_flags(_features(spark, sf), ["id"])


@query
def url_key_features(spark, sf):
    return R.key_features(_features(spark, sf), ["id"])


def _odd_features(spark, sf):
    return U.with_url_features(I.odd_links(spark, sf))


@query
def url_risk_flags_odd_input(spark, sf):
    return R.risk_flags(_odd_features(spark, sf), ["id"])


@query
def url_key_features_odd_input(spark, sf):
    return R.key_features(_odd_features(spark, sf), ["id"])


# --- labelled link tables ------------------------------------------------------------------


@query
def legit_links_short(spark, sf):
    return G.legit_links(I.keys(spark, sf), style=G.SHORT)


@query
def legit_links_long(spark, sf):
    return G.legit_links(I.keys(spark, sf), style=G.LONG)


@query
def phishing_links_short(spark, sf):
    return G.phishing_links(I.keys(spark, sf), brands=V.SHORT_PHISHING_BRANDS)


@query
def phishing_links_long(spark, sf):
    return G.phishing_links(I.keys(spark, sf), brands=V.PHISHING_BRANDS)


@query
def balanced_links(spark, sf):
    return G.balanced_links(I.keys(spark, sf))


@query
def balanced_links_short(spark, sf):
    return G.balanced_links(I.keys(spark, sf), style=G.SHORT, brands=V.PHISHING_BRANDS)


@query
def shuffled_links(spark, sf):
    order = row_hash(42, F.col("id"))
    return S.shuffled(I.links(spark, sf)).withColumn("position_key", order)


# --- counts, statistics, small views ---------------------------------------------------------


@query
def table_shape(spark, sf):
    return P.shape(_features(spark, sf))


@query
def class_counts(spark, sf):
    return P.class_counts(I.links(spark, sf))


@query
def class_filter(spark, sf):
    return _features(spark, sf).filter(F.col("label") == 1)


@query
def feature_projection(spark, sf):
    df = _features(spark, sf)
    return df.select("id", *reversed(training.feature_columns(df)))


@query
def describe_features(spark, sf):
    return P.describe(_features(spark, sf), [*V.FEATURES, "label"])


@query
def describe_line_items(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return P.describe(I.table(spark, sf, "lineitem"), columns)


@query
def describe_with_empty_column(spark, sf):
    items = I.table(spark, sf, "lineitem").withColumn("nothing", F.lit(None).cast("double"))
    return P.describe(items, ["l_quantity", "nothing"])


@query
def noisy_class_counts(spark, sf):
    rows = I.train_links(spark, sf)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_wrong").alias("n_wrong"))


@query
def head_features(spark, sf):
    return U.with_url_features(P.head(I.links(spark, sf), 3)).drop("url")


@query
def first_examples(spark, sf):
    return P.first_examples(I.links(spark, sf))


# --- splits, folds, samples, scaling -----------------------------------------------------------


@query
def stratified_split(spark, sf):
    return S.stratified_split(I.links(spark, sf)).select("id", "label", "is_test")


@query
def stratified_split_of_many_classes(spark, sf):
    """Five rows in each of two classes per order line, some with six."""
    return S.stratified_split(I.many_classes(spark, sf))


@query
def stratified_folds(spark, sf):
    return S.stratified_folds(I.links(spark, sf)).select("id", "label", "fold")


@query
def sample_per_class(spark, sf):
    return S.sample_per_class(I.links(spark, sf))


@query
def scaled_features(spark, sf):
    parted = S.stratified_split(settled(_features(spark, sf)))
    scaler = fit_scaler(parted.filter(~F.col("is_test")), V.FEATURES)
    names = scaled_names(V.FEATURES)
    return scaler.transform(parted).select(
        "id", "is_test", *[F.round(c, 6).alias(c) for c in names]
    )


# --- evaluation over scored rows ------------------------------------------------------------


@query
def confusion_cells(spark, sf):
    return E.confusion(I.scored(spark, sf))


@query
def class_scores(spark, sf):
    return E.scores(E.confusion(I.scored(spark, sf)))


@query
def class_scores_other_polarity(spark, sf):
    return E.scores(E.confusion(I.scored(spark, sf)), positive_class=0)


@query
def roc_points(spark, sf):
    return E.roc_curve(I.scored(spark, sf))


@query
def roc_points_all(spark, sf):
    return E.roc_curve(I.scored(spark, sf), thin=False)


@query
def roc_points_bounded(spark, sf):
    """A curve of few points, and how far its area is from the whole one's."""
    scored = I.scored(spark, sf)
    few = settled(E.bounded_curve(E.roc_curve(scored, thin=False), 0.05))
    areas = E.curve_area(few).join(E.auc(scored, digits=None), "model")
    close = areas.select("model", (F.abs(F.col("area") - F.col("auc_roc")) <= 0.05).alias("area_ok"))
    return few.join(F.broadcast(close), "model")


@query
def roc_auc(spark, sf):
    return E.auc(I.scored(spark, sf), digits=None).withColumn("auc_roc", F.round("auc_roc", 9))


@query
def roc_auc_other_polarity(spark, sf):
    return E.auc(I.scored(spark, sf), positive_class=0)


def _metrics(spark, sf):
    """All measures from one scan: counts by model, fold and score, summed up as needed."""
    rows = I.scored(spark, sf)
    by_fold = E.score_counts(rows, ("model", "fold"))
    counts = by_fold.groupBy("model", "score").agg(*[F.sum(c).alias(c) for c in E.CELLS])
    right, every = F.sum(F.col("c00") + F.col("c11")), F.sum(sum(F.col(c) for c in E.CELLS))
    folds = by_fold.groupBy("model", "fold").agg((right / every).alias("accuracy"))
    return E.evaluate(rows, counts=settled(counts)).join(E.cv_summary(folds), "model")


def _fold_accuracy(rows: DataFrame) -> DataFrame:
    right = (F.col("prediction") == F.col("label")).cast("double")
    return rows.groupBy("model", "fold").agg(F.avg(right).alias("accuracy"))


@query
def metrics_table(spark, sf):
    matrix = F.col("confusion_matrix")
    return _metrics(spark, sf).select(
        "model", *E.SCORES, "auc_roc",
        *[matrix[a][p].alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)],
        "cv_mean", "cv_std",
    )


@query
def fold_scores(spark, sf):
    return E.cv_summary(_fold_accuracy(I.scored(spark, sf)))


@query
def best_model(spark, sf):
    return E.best_model(E.scores(E.confusion(I.scored(spark, sf))), I.SCORED_MODELS)


@query
def score_tally(spark, sf):
    return E.tally(I.scored(spark, sf))


@query
def hit_marks(spark, sf):
    mark = R.hit_mark(F.col("prediction"), F.col("label")).alias("mark")
    return I.scored(spark, sf).groupBy("model", mark).agg(F.count("*").alias("n"))


@query
def verdicts(spark, sf):
    rows = I.scored(spark, sf)
    p, s = F.col("prediction"), F.col("score")
    sure = R.confidence(p, s)
    return rows.select(
        "model", "label", "prediction", "score",
        R.class_name(p).alias("verdict"),
        R.class_name(p, "Legitimate", "Phishing").alias("page_class"),
        F.round(sure, 9).alias("confidence"),
        F.round(R.top_confidence(s), 9).alias("top_confidence"),
        R.percent_bar(F.round(sure, 9)).alias("confidence_percent"),
    )


@query
def metric_comparison(spark, sf):
    return R.metric_long(_metrics(spark, sf))


@query
def confusion_chart(spark, sf):
    return R.confusion_long(E.confusion(I.scored(spark, sf)))


@query
def summary_table(spark, sf):
    return R.summary_table(_metrics(spark, sf), I.SCORED_MODELS)


@query
def performance_table(spark, sf):
    return R.performance_table(E.evaluate(I.scored(spark, sf)))


@query
def metric_cards(spark, sf):
    metrics = E.scores(E.confusion(I.scored(spark, sf)))
    return R.metric_cards(metrics, I.SCORED_MODELS, I.links(spark, sf))


# --- rankings of features -------------------------------------------------------------------------


def _spread(spark, sf):
    """Each feature's share of the summed deviations: a ranking that SQL can check."""
    stats = P.describe(_features(spark, sf), V.FEATURES, digits=None)
    total = F.sum("std").over(Window.partitionBy())  # over 18 rows
    place = (F.array_position(F.lit(V.FEATURES), F.col("feature")) - 1).cast("int")
    return stats.select(
        "feature",
        F.round(F.col("std") / total, 6).alias("importance"),
        place.alias("position"),
    )


@query
def feature_ranking(spark, sf):
    return R.ranked_importance(_spread(spark, sf))


@query
def feature_ranking_top15(spark, sf):
    return R.ranked_importance(_spread(spark, sf), 15)


@query
def feature_ranking_chart(spark, sf):
    return R.importance_chart(_spread(spark, sf))


# --- files ------------------------------------------------------------------------------------------


@query
def csv_links(spark, sf):
    path = scratch_path(spark, "links")
    tables.write_csv(I.broken_links(spark, sf), path)
    rows = tables.read_csv(spark, path, schemas.LINKS)
    return rows.withColumn("is_bad", F.col(tables.BAD_ROW).isNotNull()).drop(tables.BAD_ROW)


@query
def csv_features(spark, sf):
    path = scratch_path(spark, "features")
    columns = [f.name for f in schemas.LINK_FEATURES]
    tables.write_csv(_features(spark, sf).select(*columns), path)
    rows = tables.read_csv(spark, path, schemas.LINK_FEATURES)
    return rows.withColumn("is_bad", F.col(tables.BAD_ROW).isNotNull()).drop(tables.BAD_ROW)


@query
def csv_features_without_ids(spark, sf):
    path = scratch_path(spark, "plain-features")
    tables.write_csv(_features(spark, sf).select(*schemas.PLAIN_FEATURES.names), path)
    good, bad = tables.split_bad_rows(tables.read_csv(spark, path, schemas.PLAIN_FEATURES))
    rows = numbered(good)
    return rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("n_ids"),
        *[F.sum(f).alias(f) for f in V.FEATURES],
    )


@query
def csv_of_another_tool(spark, sf):
    """Pages with their HTML as plain CSV: line breaks and quotes in quoted text, columns not declared."""
    path = scratch_path(spark, "foreign")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    own = pages.select("page_id", F.concat("url", F.lit('\n"x", y')).alias("link, as met"), "html", (F.col("page_id") / 4).alias("quarter"))
    own.write.options(header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    read = records.read_records(spark, path)
    return read.select(
        "page_id",
        F.md5(F.col("link, as met")).alias("link_md5"),
        F.md5("html").alias("html_md5"),
        "quarter",
        F.col(tables.BAD_ROW).isNotNull().alias("is_bad"),
    )


@query
def json_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    tables.write_json(_metrics(spark, sf), path)
    back = tables.read_json(spark, path, schemas.METRICS)
    matrix = F.col("confusion_matrix")
    return back.select(
        "model", *E.SCORES, "auc_roc",
        *[matrix[a][p].alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)],
        "cv_mean", "cv_std",
    )


@query
def json_roc(spark, sf):
    path = scratch_path(spark, "roc")
    tables.write_json(E.roc_curve(I.scored(spark, sf)), path)
    back = tables.read_json(spark, path, schemas.ROC)
    return back.groupBy("model").agg(
        F.count("*").alias("n"),
        F.max("rank").alias("last_rank"),
        F.round(F.sum("fpr"), 4).alias("sum_fpr"),
        F.round(F.sum("tpr"), 4).alias("sum_tpr"),
    )


# --- streams ---------------------------------------------------------------------------------------

PAGE_ROWS = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())]
)


def _feed(spark, sf, job):
    out, state = scratch_path(spark, "feed"), scratch_path(spark, "feed-state")
    stream = table_stream(spark, f"{sf.rstrip('/')}/pages.parquet", PAGE_ROWS)
    run = run_feed(stream, job, out, state)
    run.awaitTermination()
    return spark.read.schema(job(spark.createDataFrame([], PAGE_ROWS)).schema).parquet(out)


@query
def stream_url_features(spark, sf):
    return _feed(spark, sf, lambda df: U.with_url_features(U.typed_urls(df)).drop("url"))


# --- learned models -------------------------------------------------------------------------------


def _train_features(spark, sf):
    return settled(U.with_url_features(I.train_links(spark, sf).drop("is_wrong")).drop("url"))


def _only(*names: str) -> L.Settings:
    return replace(RUN, models=list(names))


def _kept(run: training.Comparison, result: DataFrame) -> DataFrame:
    """The small result on its own, so that the run's cached tables can be dropped."""
    result = settled(result)
    run.release()
    return result


def _within(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.coalesce(value.between(low, high), F.lit(False))


def _run_summary(run: training.Comparison, floor=ACCURACY_FLOOR, auc_floor=AUC_FLOOR) -> DataFrame:
    """Sizes of a run per model, and whether what was learned keeps its bounds and floors."""
    counts = E.score_counts(run.predictions)
    metrics = training.metrics_table(run, counts=counts)
    cell = lambda a, p: F.col("confusion_matrix")[a][p]
    scores = counts.groupBy("model").agg(
        F.min("score").alias("lowest"), F.max("score").alias("highest")
    )
    return metrics.join(scores, "model").select(
        "model",
        F.lit(run.n_train).cast("long").alias("n_train"),
        (cell(0, 0) + cell(0, 1)).alias("n_test_0"),
        (cell(1, 0) + cell(1, 1)).alias("n_test_1"),
        (_within(F.col("lowest")) & _within(F.col("highest"))).alias("scores_ok"),
        (F.col("accuracy") >= floor).alias("accuracy_ok"),
        (F.col("auc_roc") >= auc_floor).alias("auc_ok"),
        F.least(*[_within(F.col(c)) for c in E.SCORES]).alias("measures_ok"),
    )


def _model_metrics(spark, sf, *names):
    run = training.compare(_train_features(spark, sf), _only(*names))
    return _kept(run, _run_summary(run))


@query
def logistic_regression_metrics(spark, sf):
    return _model_metrics(spark, sf, L.LOGREG)


@query
def random_forest_metrics(spark, sf):
    return _model_metrics(spark, sf, L.FOREST)


@query
def kernel_svm_metrics(spark, sf):
    return _model_metrics(spark, sf, L.SVM)


@query
def boosted_trees_metrics(spark, sf):
    return _model_metrics(spark, sf, L.BOOSTED)


@query
def model_comparison(spark, sf):
    return _model_metrics(spark, sf, *L.MODEL_ORDER)


@query
def cross_validation(spark, sf):
    run = training.compare(_train_features(spark, sf), _only(L.LOGREG))
    folds = training.cross_validate(run.train, RUN)
    return _kept(
        run,
        folds.select(
            "model",
            F.col("fold").cast("int").alias("fold"),
            "n",
            (F.col("accuracy") >= ACCURACY_FLOOR).alias("accuracy_ok"),
        ),
    )


@query
def forest_importance(spark, sf):
    df = _train_features(spark, sf)
    run = training.compare(df, _only(L.FOREST))
    run.release()
    several = df.agg(*[(F.min(f) != F.max(f)).alias(f) for f in V.FEATURES])
    several = several.unpivot([], V.FEATURES, "feature", "varies")
    every = R.ranked_importance(training.importance_table(spark, run)).join(several, "feature")
    whole = Window.partitionBy()  # over 18 rows
    by_size = Window.orderBy(F.col("importance").desc(), "position")
    return every.select(
        "model",
        "feature",
        "position",
        "varies",
        (_within(F.col("importance")) & (F.col("varies") | (F.col("importance") == 0))).alias("importance_ok"),
        _within(F.sum("importance").over(whole), 1 - 1e-9, 1 + 1e-9).alias("total_ok"),
        (F.row_number().over(by_size) == F.col("rank")).alias("rank_ok"),
    )


@query
def wide_table_comparison(spark, sf):
    run = training.compare(I.wide_table(spark, sf), PAGES, label="CLASS_LABEL")
    # The labels of this table are noise, so only the bounds can be held.
    return _kept(run, _run_summary(run, 0.0, 0.0))


def _scorer(spark, sf):
    """The URL model of the scorers: the app's forest over the links, whose labels are right."""
    df = settled(_features(spark, sf))
    preparation = training.fit_preparation(df, V.FEATURES)
    table = settled(preparation.transform(df).select("id", "label", "features"))
    rows, _ = training.fit_rows(table, df.count(), SCORER)
    return training.whole_model(preparation, L.fit(L.FOREST, rows, SCORER))


def _scored_summary(scored: DataFrame, *keys: str) -> DataFrame:
    """Keys and features of scored links, and whether verdict and confidence agree."""
    sure, score = F.col("confidence"), F.col("probability")
    named = F.when(F.col("prediction") == "PHISHING", score).when(F.col("prediction") == "SAFE", 1 - score)
    return scored.select(
        *keys,
        *V.FEATURES,
        F.coalesce(named == sure, F.lit(False)).alias("verdict_ok"),
        _within(sure, 0.5, 1.0).alias("confidence_ok"),
        (F.col("confidence_percent") == F.floor(sure * 100)).alias("percent_ok"),
    )


@query
def scored_links(spark, sf):
    return _scored_summary(score_links(I.odd_links(spark, sf), _scorer(spark, sf)), "id")


@query
def scored_rejects(spark, sf):
    return score_rejects(I.odd_links(spark, sf))


@query
def stream_scored_links(spark, sf):
    model = _scorer(spark, sf)
    return _scored_summary(_feed(spark, sf, lambda df: score_links(df, model)), "page_id")


@query
def stream_scores_and_rejects(spark, sf):
    """Both results of one run over a feed in which every fourth link is blank or missing."""
    model, out, state = _scorer(spark, sf), scratch_path(spark, "split-feed"), scratch_path(spark, "split-state")
    gap = F.when(F.col("page_id") % 4 == 0, F.when(F.col("page_id") % 8 == 0, " ")).otherwise(F.col("url"))
    stream = table_stream(spark, f"{sf.rstrip('/')}/pages.parquet", PAGE_ROWS).withColumn("url", gap)
    judge = lambda df: score_links(df, model)
    run_split_feed(stream, judge, lambda df: reject_reason(), out, state).awaitTermination()
    scored = read_split(spark, out, GOOD, judge(spark.createDataFrame([], PAGE_ROWS)).schema)
    rejected = read_split(spark, out, REJECTED, T.StructType([*PAGE_ROWS.fields, T.StructField("reason", T.StringType())]))
    verdict = F.col("prediction").isin("PHISHING", "SAFE") & F.col("confidence").between(0.5, 1.0)
    good = scored.select("page_id", "url", F.lit(None).cast("string").alias("reason"), verdict.alias("verdict_ok"))
    return good.union(rejected.select("page_id", "url", "reason", F.lit(True)))


@query
def stream_rejects(spark, sf):
    """Rejects of a feed in which every fourth link is blank or missing."""
    gap = F.when(F.col("page_id") % 4 == 0, F.when(F.col("page_id") % 8 == 0, " ")).otherwise(F.col("url"))
    return _feed(spark, sf, lambda df: score_rejects(df.withColumn("url", gap)))


@query
def saved_model_retest(spark, sf):
    df = _train_features(spark, sf)
    run = training.compare(df, RUN)
    path = scratch_path(spark, "results")
    counts = E.score_counts(run.predictions)
    best = training.save_results(spark, run, training.metrics_table(run, counts=counts), path, counts)
    run.release()
    model = training.load_model(f"{path}/model")
    names = ("Legitimate", "Phishing")
    again = training.retest(model, best, df, class_names=names)
    mark = F.when(F.col("actual") == F.col("predicted"), "OK").otherwise("MISS")
    return again.select(
        "id",
        "label",
        "actual",
        (F.col("predicted") == F.when(F.col("prediction") == 1, names[1]).otherwise(names[0])).alias("predicted_ok"),
        _within(F.col("confidence"), 0.5, 1.0).alias("confidence_ok"),
        (F.col("mark") == mark).alias("mark_ok"),
    )
