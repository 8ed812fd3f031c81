"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# HotSpot leaves methods above this many bytes interpreted. Long projections (18 features over a
# built URL) pass that size; with this limit Spark splits them, measured at twice the speed.
JIT_LIMIT = 8000


def local_session(cpus: int | str = "*", app: str = "linksift", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config(METHOD_LIMIT, str(JIT_LIMIT))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made only for a local master; anywhere
    else a machine-local folder would lose data with its executor, so that is an error.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get(CHECKPOINT_DIR, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors reach")
        named = os.path.join(tempfile.gettempdir(), f"linksift-{os.getpid()}")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """The table written once to the shared checkpoint folder, for the passes that follow."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Give a table without a unique key one, fixed by writing the table once.

    The numbers follow splits and row order, so without the write a re-read could differ.
    """
    return settled(df.withColumn(id_col, F.monotonically_increasing_id()))


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/linksift/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


@atexit.register
def _remove_scratch() -> None:
    for spark, path in _SCRATCH:
        context = spark.sparkContext
        if context._jsc is not None:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
