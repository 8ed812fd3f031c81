"""An unbounded URL feed through the same expressions as the batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def link_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    glob: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Files that land in a folder as a stream of URL rows."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def table_stream(spark: SparkSession, table: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its rows, whether it is one file or a folder of part files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    if status.isDirectory():
        return link_stream(spark, table, schema, "*", files_per_trigger)
    return link_stream(spark, path.getParent().toString(), schema, path.getName(), files_per_trigger)


def run_feed(
    stream: DataFrame,
    job: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Write ``job(stream)`` to parquet files; stateless append, restartable from its checkpoint."""
    writer = (
        job(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


GOOD, REJECTED = "scored", "rejected"


def run_split_feed(
    stream: DataFrame,
    job: Callable[[DataFrame], DataFrame],
    reason: Callable[[DataFrame], Column],
    out: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """One pass over a feed with two results: ``job`` of its good rows, and the rejects with a reason.

    ``reason`` gives a column that is null for good rows. A micro-batch is tagged once, kept while both
    results are made from it, and written in one job below ``kind=<result>/batch=<id>``, replacing what
    an earlier try of the same batch left there. So after a restart in mid-batch no row is lost or
    written twice. ``read_split`` reads the results.
    """

    def both(batch: DataFrame, number: int) -> None:
        tagged = batch.withColumn("reason", reason(batch)).persist()
        try:
            good = job(tagged.where("reason is null").drop("reason"))
            bad = tagged.where("reason is not null")
            kind = lambda df, name: df.withColumns({"kind": F.lit(name), "batch": F.lit(number).cast("long")})
            rows = kind(good, GOOD).unionByName(kind(bad, REJECTED), allowMissingColumns=True)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(out)
        finally:
            tagged.unpersist()

    writer = stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def read_split(spark: SparkSession, out: str, kind: str, columns: T.StructType) -> DataFrame:
    """The rows of one result of ``run_split_feed``, with the batch that each came in; none if no batch has run."""
    partitions = [T.StructField("kind", T.StringType()), T.StructField("batch", T.LongType())]
    schema = T.StructType([*columns.fields, *partitions])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    written = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(schema).parquet(out) if written else spark.createDataFrame([], schema)
    return rows.where(F.col("kind") == kind).drop("kind")
