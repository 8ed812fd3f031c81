"""The feed gives what the batch gives, and goes on where it stopped."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linksift.functions.urls import typed_urls, with_url_features
from linksift.streaming import feed
from linksift.streaming.feed import link_stream, run_feed

ROWS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())])


def job(df):
    return with_url_features(typed_urls(df))


def test_stream_equals_batch_and_restarts(spark, data, tmp_path):
    inbox, out, state = (str(tmp_path / name) for name in ("inbox", "out", "state"))
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    pages.filter("page_id < 20").repartition(3).write.parquet(inbox)
    for _ in range(2):
        run_feed(link_stream(spark, inbox, ROWS, files_per_trigger=1), job, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 20
    pages.filter("page_id >= 20").write.mode("append").parquet(inbox)
    run_feed(link_stream(spark, inbox, ROWS), job, out, state).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(job(pages).collect())


def test_two_results_of_one_run_and_of_a_restart_in_mid_batch(spark, data, tmp_path):
    inbox, out, state = (str(tmp_path / name) for name in ("inbox", "out", "state"))
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("url"))
    pages.repartition(4).write.parquet(inbox)
    seen = []

    def broken(df):
        """Fails for the second batch, after the first is written."""
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return job(df)

    why = lambda df: F.when(F.col("url").isNull(), "no url")
    with pytest.raises(Exception, match="lost"):
        feed.run_split_feed(link_stream(spark, inbox, ROWS, files_per_trigger=1), broken, why, out, state).awaitTermination()
    # What a try that did not get to its commit left behind is replaced.
    spark.read.parquet(inbox).limit(2).withColumns({"reason": F.lit("stale"), "kind": F.lit("rejected"), "batch": F.lit(1)}).write.mode("append").partitionBy("kind", "batch").parquet(out)
    for _ in range(2):
        feed.run_split_feed(link_stream(spark, inbox, ROWS, files_per_trigger=1), job, why, out, state).awaitTermination()
    good = feed.read_split(spark, out, feed.GOOD, job(pages).schema).drop("batch")
    bad = feed.read_split(spark, out, feed.REJECTED, T.StructType([*ROWS.fields, T.StructField("reason", T.StringType())]))
    assert sorted(good.collect()) == sorted(job(pages.where("url is not null")).collect())
    assert sorted((r["page_id"], r["reason"]) for r in bad.collect()) == sorted((r["page_id"], "no url") for r in pages.where("url is null").collect())
    assert {r["batch"] for r in bad.collect()} == {0, 1, 2, 3}


def test_a_table_of_part_files_is_read_like_one_file(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    why = lambda df: F.when(F.col("page_id") % 4 == 0, "fourth")
    for name, table in (("file", f"{data}/pages.parquet"), ("folder", str(tmp_path / "pages.parquet"))):
        out, state = str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}")
        feed.run_split_feed(feed.table_stream(spark, table, ROWS), job, why, out, state).awaitTermination()
        good = feed.read_split(spark, out, feed.GOOD, job(pages).schema)
        bad = feed.read_split(spark, out, feed.REJECTED, ROWS)
        assert good.count() + bad.count() == pages.count() and bad.count() == pages.where("page_id % 4 = 0").count()


def test_a_feed_without_a_batch_has_no_rows(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    out = str(tmp_path / "out")
    feed.run_split_feed(link_stream(spark, str(tmp_path / "inbox"), ROWS), job, lambda df: F.lit(None), out, str(tmp_path / "state")).awaitTermination()
    assert feed.read_split(spark, out, feed.GOOD, ROWS).count() == 0
