"""The whole run through files, and the feed scored with its saved model."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from linksift.functions.vocabulary import FEATURES, PAGE_FEATURES
from linksift.operators import learners as L
from linksift.plans import batch, training
from linksift.plans.scoring import score_links
from linksift.sources import schemas, tables
from linksift.streaming.feed import link_stream, run_feed

QUICK = L.Settings(trees=10, tree_depth=6, models=[L.LOGREG, L.FOREST])


def test_from_ids_to_a_scored_feed(spark, tmp_path, data):
    links, features, results = (str(tmp_path / n) for n in ("links", "features", "results"))
    batch.build_links(spark.range(150), links)
    batch.build_features(spark, links, features)
    best = batch.train(spark, features, results, QUICK, folds=3)
    metrics = tables.read_json(spark, f"{results}/metrics", schemas.METRICS).collect()
    assert len(metrics) == 2
    assert all(r["accuracy"] >= 0.9 and 0.9 <= r["cv_mean"] <= 1.0 for r in metrics)
    assert spark.read.json(f"{results}/importance").count() == 18

    model = training.load_model(f"{results}/model")
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = link_stream(spark, data, pages.schema, "pages.parquet")
    run_feed(stream, lambda df: score_links(df, model, best), out, state).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(score_links(pages, model, best).collect())


def test_plain_links_get_ids_and_rejects(spark, tmp_path):
    file = tmp_path / "urls.csv"
    file.write_text("url,label\nhttp://a.tk/,1\nhttp://a.tk/,1\n\\N,0\nhttps://b.com/,oops\n")
    out = str(tmp_path / "features")
    batch.build_features(spark, str(file), out, has_ids=False)
    rows, _ = tables.split_bad_rows(tables.read_csv(spark, out, schemas.LINK_FEATURES))
    rows = rows.collect()
    assert len(rows) == 2 and len({r["id"] for r in rows}) == 2
    assert rows[0].asDict().keys() == {"id", *FEATURES, "label"}
    reasons = spark.read.json(f"{out}-rejects").collect()
    assert sorted(r["reason"] for r in reasons) == ["no url", "unreadable"]


def test_page_table_run(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(240, 48))
    labels = (values[:, 3] + values[:, 20] > 0).astype(int)
    rows = [(i, *map(float, v), int(y)) for i, (v, y) in enumerate(zip(values, labels))]
    pages, results = str(tmp_path / "pages"), str(tmp_path / "results")
    tables.write_csv(spark.createDataFrame(rows, schemas.PAGES), pages)
    settings = replace(L.PAGE_RUN, trees=10, models=[L.LOGREG, L.FOREST])
    assert batch.train_pages(spark, pages, results, settings, folds=2) in settings.models
    model = training.load_model(f"{results}/model")
    assert training.model_features(model) == PAGE_FEATURES
    top = spark.read.json(f"{results}/importance").orderBy("rank").limit(2)
    assert {r["feature"] for r in top.collect()} == {"UrlLength", "HostnameLength"}


def test_rows_that_cannot_train_are_kept_apart(spark, tmp_path):
    links, features, results = (str(tmp_path / n) for n in ("links", "features", "results"))
    batch.build_links(spark.range(60), links)
    batch.build_features(spark, links, features)
    lines = [r["value"] for r in spark.read.text(features).collect()]
    head = next(x for x in lines if x.startswith("id,"))
    rows = [x for x in lines if x != head]
    broken = ["x" + rows[0], rows[1].rsplit(",", 1)[0] + ",\\N"]
    file = tmp_path / "features.csv"
    file.write_text("\n".join([head, *rows[2:], *broken]) + "\n")
    batch.train(spark, str(file), results, QUICK, folds=2)
    told = spark.read.json(f"{results}-rejects").collect()
    assert sorted(r["reason"] for r in told) == ["incomplete", "unreadable"]
    curve = tables.read_json(spark, f"{results}/roc", schemas.ROC)
    assert curve.filter("auc_roc is null").count() == 0 < curve.count()


def test_features_without_ids_can_train(spark, tmp_path):
    links, features, results = (str(tmp_path / n) for n in ("links", "features", "results"))
    batch.build_links(spark.range(60), links)
    batch.build_features(spark, links, features)
    plain = str(tmp_path / "plain")
    rows, _ = tables.split_bad_rows(tables.read_csv(spark, features, schemas.LINK_FEATURES))
    tables.write_csv(rows.drop("id"), plain)
    assert batch.train(spark, plain, results, QUICK, folds=2, has_ids=False) in QUICK.models


def test_a_fit_does_not_depend_on_the_splits_of_its_input(spark):
    rows = spark.range(400).selectExpr("id", "cast(id % 7 as double) as a", "cast(id % 5 as double) as b", "cast((id % 7 + id % 3) % 2 as int) as label")
    settings = replace(QUICK, models=[L.FOREST])
    found = set()
    for splits in (1, 3, 8):
        run = training.compare(rows.repartition(splits), settings)
        found.add(tuple(run.models[L.FOREST].getOrDefault("featureImportances")))
        run.release()
    assert len(found) == 1


def test_a_fit_reads_at_most_fit_rows(spark):
    rows = spark.range(300).selectExpr("id", "cast(id % 3 = 0 as int) as label")
    part, n = training.fit_rows(rows, 300, replace(QUICK, fit_rows=90))
    assert n == part.count() == 90 and part.filter("label = 1").count() == 30
