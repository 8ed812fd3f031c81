"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linksift.llm import (
    binary_ids,
    decontaminate,
    hard_negatives,
    line_dedup,
    manifest,
    mixing,
    near_dedup,
    packing,
    quality,
    sharding,
    suffix_dedup,
    toxicity,
    url_templates,
)

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_quality_rules(spark, sf):
    judged = quality.quality_verdicts(table(spark, sf, "documents"), ["doc_id"], quality.MEASURES)
    return judged.select("row.doc_id", *quality.MEASURES, "base_failed", "kept")


@query
def op2_token_files(spark, sf):
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf, "documents")
    return binary_ids.read_documents(binary_ids.write_ids(docs, BYTE_TOKENIZER, END_ID, 50_257, files, added_tokens=True))


@query
def op3_byte_shards(spark, sf):
    return sharding.shard_documents(table(spark, sf, "documents"), ["doc_id"], 8).select(
        "row.doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_packed_sequences(spark, sf):
    packed = packing.pack_documents(table(spark, sf, "documents"), WORD_TOKENIZER, END_ID, added_tokens=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op5_decontaminated(spark, sf):
    found = decontaminate.contamination(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"), ["doc_id"]
    )
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


@query
def op6_url_templates(spark, sf):
    rules = spark.createDataFrame(url_templates.RULES, "host string, path string, verdict string")
    return url_templates.judge_urls(table(spark, sf, "pages"), rules)


@query
def op7_near_duplicates(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"), shingle=4).drop("class")


@query
def op8_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit_model(docs, table(spark, sf, "labels").where(~held_out))
    scored = toxicity.score_documents(docs, model, ["doc_id"])
    return scored.select("row.doc_id", "score").select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
    )


@query
def op9_similar_lines(spark, sf):
    kept = line_dedup.dedup_lines(table(spark, sf, "documents"), ["doc_id"])
    return kept.select("row.doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op10_repeated_spans(spark, sf):
    found = suffix_dedup.without_repeats(table(spark, sf, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_merkle_manifest(spark, sf):
    docs = table(spark, sf, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    changed = F.when(F.col("text").isNotNull(), F.translate("text", upper, lower))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.leaf_of(*map(F.col, fields[:-1]), changed))
    leaf = manifest.leaf_of(*map(F.col, fields))
    proven = manifest.manifest(docs, leaf, "lang", "doc_id", [F.col("doc_id"), tampered.alias("tampered")])
    folded = manifest.fold(F.coalesce("row.tampered", "leaf"), F.col("path"))
    return proven.select(
        "row.doc_id",
        "leaf",
        "subroot",
        "root",
        manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_hard_negatives(spark, sf):
    vectors = hard_negatives.usable(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("vector", lambda x: F.floor(F.lit(256) * x))
    vectors = vectors.select("id", label.cast("long").alias("label"), scaled.alias("vector"))
    mined = hard_negatives.mine(vectors, F.col("id") % 100 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query
def op13_source_mix(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"), [F.col("doc_id")])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", "copies")
