"""Tables that an operator writes once to the shared folder and reads again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from linksift.session import shared_dir

_WRITTEN: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the folder that all executors reach; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table once as Parquet and return it as read from there.

    Later passes neither repeat the work nor depend on the executor that did it. What the write
    has shuffled is garbage then; collecting it on the driver lets Spark free the executors' disks.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a settled table that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
