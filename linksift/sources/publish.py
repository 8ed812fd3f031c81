"""Folders that are replaced as one: a version is written beside the old one, then a pointer moves.

``<root>/CURRENT`` names the folder below ``root`` that readers take. It is replaced by a rename, so a
reader gets the old version or the new one, never a part of either; the version before the current one
stays for readers that have just looked it up, older ones are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "CURRENT"
VERSION = "version-"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that is published at ``root``, if any is."""
    pointer, files = _files(spark, f"{root}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{root}/{name}"


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Write a version with ``write(folder)`` and make it the current one; returns its folder."""
    jvm = spark.sparkContext._jvm
    before, name = current(spark, root), VERSION + uuid.uuid4().hex
    write(f"{root}/{name}")
    fresh, files = _files(spark, f"{root}/.{name}")
    stream = files.create(fresh)
    stream.write(bytearray(name.encode()))
    stream.close()
    pointer, _ = _files(spark, f"{root}/{POINTER}")
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    replace = spark.sparkContext._gateway.new_array(option, 1)
    replace[0] = option.valueOf("OVERWRITE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(pointer), replace)
    kept = {name, (before or "").rsplit("/", 1)[-1]}
    folder, _ = _files(spark, root)
    for status in files.listStatus(folder):
        old = status.getPath()
        if old.getName().startswith(VERSION) and old.getName() not in kept:
            files.delete(old, True)
    return f"{root}/{name}"
