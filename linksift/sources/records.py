"""CSV files of other tools: records with line breaks in quotes, split in parallel, schema from the file.

A line break ends a record unless it stands between quotes, which only the quotes before it tell. So a
first pass counts the quotes of every byte range; their parity, added up over the ranges of a file,
tells how each range begins. In a second pass every range cuts its own records at true line ends.
What a range leaves open, and what the next ones need to close it, are joined by range order.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linksift.session import settled
from linksift.sources.tables import BAD_ROW

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE = '"'
# A piece of a file: a whole record, the end of one begun earlier, a part of one, the begin of one.
RECORD, END, PART, BEGIN = 0, 1, 2, 3
PIECES = "file string, block long, kind int, at long, text string"
OPTIONS = {"escape": QUOTE, "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line) in file order within a byte range; a task may read several ranges."""
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return spark.read.option("lineSep", "\n").text(path).select(*where, F.col("value").alias("line"))


def _quotes(lines: DataFrame) -> DataFrame:
    """(file, block, odd): the parity of the quotes before each range."""
    count = F.length("line") - F.length(F.replace("line", F.lit(QUOTE), F.lit("")))
    sums = lines.groupBy("file", "block").agg(F.sum(count).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines of each range, which come in order, into records and open ends."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("text", pa.string())])
    key, inside, begun, held, at = None, False, False, [], 0  # begun: what is held began in an earlier range

    def piece(ended: bool) -> tuple:
        kind = (END if ended else PART) if begun else (RECORD if ended else BEGIN)
        return (*key, kind, at, "\n".join(held))

    for batch in batches:
        out = []
        lines = batch.column("line")
        odd = np.asarray(pc.bit_wise_and(pc.count_substring(lines, QUOTE), 1)) == 1
        for file, block, line, starts_inside, flips in zip(*(batch.column(c).to_pylist() for c in ("file", "block")), lines.to_pylist(), batch.column("inside").to_pylist(), odd.tolist()):
            if (file, block) != key:
                if held:
                    out.append(piece(False))
                key, inside, begun, held, at = (file, block), starts_inside, starts_inside, [], 0
            held.append(line)
            inside ^= flips
            if not inside:
                out.append(piece(True))
                begun, held, at = False, [], at + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[piece(False)]), schema)], schema=schema)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, record): the records of CSV files, without blank ones; order by the first three.

    Quotes inside quoted text are doubled. Carriage returns before a line end are dropped. A file that
    ends inside quotes gives its open end as the last record.
    """
    lines = _lines(spark, path)
    # One row per byte range.
    starts = F.broadcast(settled(_quotes(lines)).where("inside"))
    told = lines.join(starts, ["file", "block"], "left").select("file", "block", "line", F.coalesce("inside", F.lit(False)).alias("inside"))
    pieces = settled(told.mapInArrow(_pieces, PIECES))
    whole = pieces.where(F.col("kind") == RECORD).select("file", "block", "at", "text")
    # At most two open ends per range; a record is a begin and all up to the next begin.
    order = Window.partitionBy("file").orderBy("block", "at")
    parts = pieces.where(F.col("kind") != RECORD)
    parts = parts.withColumn("number", F.sum((F.col("kind") == BEGIN).cast("int")).over(order))
    part = F.struct("block", "at", "text")
    joined = parts.groupBy("file", "number").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    joined = joined.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"), text.alias("text"))
    trimmed = F.regexp_replace("text", "\r$", "")
    return whole.union(joined).withColumn("record", trimmed).where("record != ''").drop("text")


def _names(cut: DataFrame) -> tuple[list[str], DataFrame]:
    """The column names of the header, and the records without the header of each file."""
    heads = cut.groupBy("file").agg(F.min(F.struct("block", "at", "record")).alias("head")).select("file", "head.*")
    heads = settled(heads)
    row = heads.orderBy("file").first()
    names = next(csv.reader([row["record"]])) if row else []
    marks = heads.select("file", "block", "at")
    return names, cut.join(F.broadcast(marks), ["file", "block", "at"], "left_anti")


def _parsed(cut: DataFrame, schema: T.StructType, null: str) -> DataFrame:
    checked = T.StructType([*schema.fields, T.StructField(BAD_ROW, T.StringType())])
    options = {**OPTIONS, "nullValue": null, "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW}
    return cut.select(F.from_csv("record", _ddl(checked), options).alias("row")).select("row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def column_types(table: DataFrame) -> list[str]:
    """For each text column the narrowest of bigint, double and string that holds all its values.

    One pass: a column is as wide as its widest value, and sides of the aggregate join as they meet.
    A column without a value is a string.
    """
    table = table.toDF(*[f"c{i}" for i in range(len(table.columns))])
    fails = lambda c, kind: F.max((F.col(c).isNotNull() & F.expr(f"try_cast({c} AS {kind})").isNull()).cast("int"))
    told = table.agg(*[x for c in table.columns for x in (F.count(c), fails(c, "bigint"), fails(c, "double"))]).first()
    out = []
    for values, no_long, no_double in zip(told[0::3], told[1::3], told[2::3]):
        out.append("string" if not values or no_double else "double" if no_long else "bigint")
    return out


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None, null: str = "") -> DataFrame:
    """A CSV of another tool: quoted line breaks, several tasks on one file, its own column names.

    Without ``schema`` columns are named by the header and typed by their values (``column_types``).
    A text equal to ``null`` is null. Records that do not fit keep their text in ``_bad_row``.
    """
    names, cut = _names(settled(records(spark, path)))
    if schema is None:
        texts = T.StructType([T.StructField(name, T.StringType()) for name in names])
        kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
        found = column_types(_parsed(cut, texts, null).drop(BAD_ROW))
        schema = T.StructType([T.StructField(name, kinds[kind]) for name, kind in zip(names, found)])
    return _parsed(cut, schema, null)
