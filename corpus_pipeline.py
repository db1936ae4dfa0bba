"""Cleaning a corpus: each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.decontamination import without_leaks
from millrace.llm.minhash_dedup import near_duplicates
from millrace.llm.sentencepiece_lattice import encode_documents
from millrace.llm.stage import written
from millrace.llm.suffix_dedup import remove_repeated_bytes
from millrace.llm.toxicity import without_toxic

ROW = "_pipeline_row"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by a similarity of 0.8 on sequences of five words, or repeating id and text.

    Rows are chosen by number first, so whole rows move once. ``docs`` reads a table: its rows keep their numbers.
    """
    keys = ["no_id", "id", "th", "no_text"]
    id_keys = [F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    numbered = docs.select("*", F.monotonically_increasing_id().alias(ROW))
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = numbered.select(*id_keys, th.alias("th"), F.isnull("text").alias("no_text"), ROW).groupBy(*keys).agg(F.min(ROW).alias(ROW))
    no_text = F.when(F.col("th") == F.xxhash64(F.lit("")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    kept = near_duplicates(docs, size=5, percent=80, bands=30).where("kept").select(*id_keys, "th", F.explode(no_text).alias("no_text"))
    return numbered.join(rows.join(kept, keys, "left_semi").select(ROW), ROW, "left_semi").drop(ROW)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes that occur more than once out of the texts; all documents stay."""
    out = remove_repeated_bytes(docs, whole_characters=True, rest=docs.columns)
    text = F.when(F.col("rest.text").isNotNull(), F.col("kept").cast("string"))
    fresh = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return out.select(*[fresh.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None  # SQL cannot express the stages; tests compare them with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
