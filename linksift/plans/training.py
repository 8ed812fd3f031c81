"""Train, compare, save and re-test the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linksift.operators import evaluate as E
from linksift.operators import learners as L
from linksift.operators import report as R
from linksift.operators.blocks import NO_FOLD
from linksift.operators.scale import fit_scaler, scaled_names
from linksift.operators.split import sample_per_class, stratified_folds, stratified_split
from linksift.session import settled, shared_dir
from linksift.sources import tables
from linksift.sources.publish import current, publish


#: Rows of a cut table in one piece.
TASK_ROWS = 2_048


def feature_columns(df: DataFrame, label: str = "label", id_col: str = "id") -> list[str]:
    """Every column but the id and the label, in table order."""
    return [c for c in df.columns if c not in (label, id_col)]


def _run(spark: SparkSession, jobs: Iterable[Callable], parallel: int) -> list:
    """Run fits side by side: each is a chain of small jobs that leaves cores idle."""
    jobs = [inheritable_thread_target(spark)(job) for job in jobs]
    with ThreadPool(max(1, min(parallel, len(jobs)))) as pool:
        return pool.map(lambda job: job(), jobs)


def fit_rows(df: DataFrame, rows: int, settings: L.Settings) -> tuple[DataFrame, int]:
    """The rows that one fit reads, and their number: all, or as many as the settings allow."""
    if settings.fit_rows is None or rows <= settings.fit_rows:
        return df, rows
    part = stratified_split(df, fraction=settings.fit_rows / rows, seed=settings.seed, out="_fit")
    return _few(part.filter("_fit").drop("_fit"), settings.fit_rows), settings.fit_rows


def _few(df: DataFrame, rows: int) -> DataFrame:
    """The rows chosen for a fit, written once in a few pieces: a pass reads neither the table that they
    come from nor as many pieces as that has."""
    return settled(df.repartition(-(-rows // TASK_ROWS), "id"))


def fit_preparation(train: DataFrame, features: list[str]) -> PipelineModel:
    """T2 + P2: scaling and assembling, in the fixed order of the feature names."""
    assembler = VectorAssembler(
        inputCols=scaled_names(features), outputCol="features", handleInvalid="error"
    )
    return PipelineModel([fit_scaler(train, features), assembler])


def whole_model(preparation: PipelineModel, model: Transformer) -> PipelineModel:
    """Scaler, assembler and classifier as one saveable model."""
    return PipelineModel([*preparation.stages, model])


def predict_all(df: DataFrame, models: dict[str, Transformer], keep: list[str]) -> DataFrame:
    """All models over one scan; predictions stay on the row they belong to."""
    wide = df
    for model in models.values():
        wide = model.transform(wide)
    pairs = {name: (L.prediction_of(name), L.score_of(name)) for name in models}
    return E.stack_models(wide, pairs, keep)


@dataclass
class Comparison:
    """What a training run leaves behind."""

    features: list[str]
    preparation: PipelineModel
    models: dict[str, Transformer]
    train: DataFrame
    test: DataFrame
    predictions: DataFrame
    n_train: int
    cached: list[DataFrame]

    def scorer(self, name: str) -> PipelineModel:
        return whole_model(self.preparation, self.models[name])

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def compare(
    df: DataFrame,
    settings: L.Settings = L.URL_RUN,
    label: str = "label",
    id_col: str = "id",
    parallel: int = 4,
) -> Comparison:
    """Split, scale, fit the chosen models on one cached train table, predict the test rows."""
    spark = df.sparkSession
    shared_dir(spark)
    features = feature_columns(df, label, id_col)
    table = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), *features)
    parted = stratified_split(table, seed=settings.seed)
    preparation = fit_preparation(parted.filter(~F.col("is_test")), features)
    # Cached once; train and test are filters of it.
    ready = preparation.transform(parted).select("id", "label", "is_test", "features").persist()
    train = ready.filter(~F.col("is_test")).drop("is_test")
    test = ready.filter("is_test").drop("is_test")
    n = train.count()
    data = L.Prepared(fit_rows(train, n, settings)[0], settings)
    jobs = [lambda name=name: L.fit_folds(name, data, [NO_FOLD])[NO_FOLD] for name in settings.models]
    models = dict(zip(settings.models, _run(spark, jobs, parallel)))
    data.release()
    predictions = predict_all(test, models, ["id", "label"]).persist()
    return Comparison(
        features, preparation, models, train, test, predictions, n, [ready, predictions]
    )


def cross_validate(
    train: DataFrame, settings: L.Settings, folds: int = 5, parallel: int = 4
) -> DataFrame:
    """Fold accuracies (model, fold, accuracy, n) on the scaled train rows.

    The fits of a family, one per left-out fold, advance in the same passes over one table of rows,
    and the families side by side. Cuts of bins, landmarks and kernel width are those of all rows.
    With ``fit_rows`` that table is cut so that each fit reads about so many; every row is scored.
    """
    parted = stratified_folds(train, folds, seed=settings.seed).persist()
    sizes = {r["fold"]: r["count"] for r in parted.groupBy("fold").count().collect()}
    every = sorted(sizes)
    few, total = parted, sum(sizes.values())
    if settings.fit_rows is not None and total > (most := settings.fit_rows * folds // (folds - 1)):
        # Another seed than that of the folds, which are runs of the hash order.
        few = stratified_split(parted, fraction=most / total, seed=settings.seed + 1, out="_fit").filter("_fit").drop("_fit")
        few = _few(few, most)
    data = L.Prepared(few, settings, fold=F.col("fold"))
    jobs = [lambda name=name: L.fit_folds(name, data, every) for name in settings.models]
    fitted = dict(zip(settings.models, _run(train.sparkSession, jobs, parallel)))
    data.release()
    held_out = [
        predict_all(
            parted.filter(F.col("fold") == fold),
            {name: fitted[name][fold] for name in settings.models},
            ["label", "fold"],
        )
        for fold in every
    ]
    together = held_out[0]
    for part in held_out[1:]:
        together = together.unionByName(part)
    right = (F.col("prediction") == F.col("label")).cast("double")
    scored = together.groupBy("model", "fold")
    accuracy = settled(scored.agg(F.avg(right).alias("accuracy"), F.count("*").alias("n")))
    parted.unpersist()
    return accuracy


def importance_table(spark: SparkSession, comparison: Comparison) -> DataFrame:
    """(model, feature, importance, position, rank) of the fitted forest."""
    ranked = L.importances(comparison.models[L.FOREST], comparison.features)
    place = {name: i for i, name in enumerate(comparison.features)}
    rows = [(L.FOREST, f, v, place[f], i + 1) for i, (f, v) in enumerate(ranked)]
    return spark.createDataFrame(
        rows, "model string, feature string, importance double, position int, rank int"
    )


def metrics_table(
    comparison: Comparison,
    fold_scores: DataFrame | None = None,
    positive_class: int = 1,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per model, with CV columns where fold scores are given."""
    metrics = E.evaluate(comparison.predictions, positive_class, counts)
    if fold_scores is None:
        return metrics
    return metrics.join(E.cv_summary(fold_scores), "model", "left")


def save_results(
    spark: SparkSession,
    comparison: Comparison,
    metrics: DataFrame,
    path: str,
    counts: DataFrame | None = None,
) -> str:
    """Results as JSON lines and the best model as one folder; returns the best name.

    ``counts`` (of ``E.score_counts``) spares a second pass over the predictions.
    """
    metrics = settled(metrics)
    curve = E.roc_curve(comparison.predictions, counts=counts)
    tables.write_json(metrics, f"{path}/metrics")
    # One row per model at most: the area goes with every point of its curve.
    areas = F.broadcast(metrics.select("model", "auc_roc"))
    tables.write_json(curve.join(areas, "model"), f"{path}/roc")
    if L.FOREST in comparison.models:
        ranked = importance_table(spark, comparison).drop("position")
        tables.write_json(ranked, f"{path}/importance")
    names = spark.createDataFrame(
        list(enumerate(comparison.features)), "position int, feature string"
    )
    tables.write_json(names, f"{path}/feature_names")
    best = E.best_model(metrics, L.MODEL_ORDER).first()["model"]
    publish(spark, f"{path}/model", lambda folder: comparison.scorer(best).write().save(folder))
    return best


def load_model(path: str) -> PipelineModel:
    """The saved model, or a clear error if there is none; other faults come through.

    A load during a save gets the model before it or the new one.
    """
    spark = SparkSession.active()
    path = current(spark, path) or path
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        raise FileNotFoundError(f"no trained model at {path}; train and save one first")
    return PipelineModel.load(path)


def model_features(model: PipelineModel) -> list[str]:
    """The feature names a saved model was fitted with, in order."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    skip = len(scaled_names([""])[0])
    return [c[skip:] for c in assembler.getInputCols()]


def retest(
    model: PipelineModel,
    name: str,
    df: DataFrame,
    label: str = "label",
    id_col: str = "id",
    per_class: int = 5,
    seed: int = 99,
    class_names: tuple[str, str] = ("Phishing", "Legitimate"),
) -> DataFrame:
    """Score a small sample per class; ``class_names`` are the names of class 0 and 1."""
    sample = sample_per_class(df, per_class, id_col, label, seed)
    scored = model.transform(sample.select(id_col, label, *model_features(model)))
    prediction, score = L.prediction_of(name).cast("int"), L.score_of(name)
    zero, one = class_names
    return scored.select(
        F.col(id_col).alias("id"),
        F.col(label).alias("label"),
        prediction.alias("prediction"),
        R.class_name(F.col(label), one, zero).alias("actual"),
        R.class_name(prediction, one, zero).alias("predicted"),
        R.top_confidence(score).alias("confidence"),
        R.hit_mark(prediction, F.col(label)).alias("mark"),
    )
