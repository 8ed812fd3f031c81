"""Documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept. The first four return the columns of
``documents``; a changed text comes with its new ``n_chars``. The last returns one row per piece of
a sequence. Nulls, empty texts and repeated rows are treated as each operator states; extra columns
pass through the first four stages whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linksift.llm import decontaminate, line_dedup, near_dedup, packing, quality
from linksift.llm.tables import settle

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def _wrapped(docs: DataFrame) -> DataFrame:
    """All columns in ``_row`` beside the two that operators read, so that no names clash."""
    return docs.select("doc_id", "text", F.struct("*").alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_wrapped(docs), ["_row"]).where("kept").select("row._row.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_wrapped(docs), ["_row"]).select("row._row", "text", "n_removed")
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        size = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("_row.n_chars"))
        row = row.withField("n_chars", size)
    return cleaned.select(row.alias("_row")).select("_row.*")


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs, docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_wrapped(docs), benchmark, ["_row"])
    return found.where("not contaminated").select("row._row.*")


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs, TOKENIZER, END_ID, added_tokens=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_duplicate_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing_sequences),
]

#: SQL has no tokenizer, so the pipeline is tested against plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
