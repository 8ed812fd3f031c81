"""Readers and writers for the pipeline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD_ROW = "_bad_row"
# A token that stands for null in CSV, so that an empty URL stays an empty string.
NULL_TOKEN = "\\N"


# Characters that a line of CSV cannot hold, and the stroke that marks them. The code of the stroke
# is a letter of its own, so that taking the codes back in this order cannot meet a false one.
ESCAPES = [("\n", "\\n"), ("\r", "\\r"), ("\\", "\\b")]
ESCAPES_BACK = [(code, text) for text, code in ESCAPES]


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != BAD_ROW]


def _replaced(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    def swap(name: str):
        column = F.col(name)
        for old, new in pairs:
            column = F.replace(column, F.lit(old), F.lit(new))
        return column

    return df.withColumns({name: swap(name) for name in _strings(df)})


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, escaped: bool = True, **options
) -> DataFrame:
    """One scan with a declared schema; rows that do not fit keep their text in ``_bad_row``.

    ``escaped`` tells that the file was written by ``write_csv``, whose codes for line breaks and
    strokes are taken back; strokes of other files are text.
    """
    checked = T.StructType(schema.fields + [T.StructField(BAD_ROW, T.StringType())])
    rows = spark.read.schema(checked).options(
        header=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=BAD_ROW,
        nullValue=NULL_TOKEN,
        emptyValue="",
        escape='"',
        # Every column is checked, so that a row is bad whichever columns a query asks for.
        columnPruning=False,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        **options,
    ).csv(path)
    return _replaced(rows, ESCAPES_BACK) if escaped else rows


def split_bad_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and those that did not, with their text in ``_bad_row``.

    The second table keeps all columns, since Spark does not allow a query on the text alone.
    """
    bad = F.col(BAD_ROW).isNotNull()
    return df.filter(~bad).drop(BAD_ROW), df.filter(bad)


def write_csv(df: DataFrame, path: str) -> None:
    """Header row, no index column, one file per task; every row is one line."""
    _replaced(df, ESCAPES[::-1]).write.mode("overwrite").options(
        header=True,
        nullValue=NULL_TOKEN,
        emptyValue='""',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


def read_named(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """S9 for results kept as one object: (name, the fields) for each key of a JSON object."""
    kind = f"map<string, struct<{fields}>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("name", "of")).select("name", "of.*")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Results come back with the schema they were written with."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
