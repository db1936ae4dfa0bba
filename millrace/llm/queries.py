"""The registered queries of the operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import oracles
from millrace.llm.decontamination import leaks
from millrace.llm.hmm import language_scores
from millrace.llm.jaccard_join import jaccard_components
from millrace.llm.merkle import folded, lower_ascii, manifest, proof_hash
from millrace.llm.minhash_dedup import near_duplicates
from millrace.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_heads
from millrace.llm.quality import quality
from millrace.llm.sentencepiece_lattice import encode_documents
from millrace.llm.substring_dedup import remove_repeated_words
from millrace.llm.suffix_dedup import remove_repeated_bytes
from millrace.llm.token_files import read_token_files, write_token_files
from millrace.llm.topk import top_k
from millrace.llm.toxicity import toxicity
from millrace.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark, sf_dir):
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_minhash_dedup(spark, sf_dir):
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", kept)


@query
def op8_substring_dedup(spark, sf_dir):
    out = remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_token_files(spark, sf_dir):
    folder = work_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_token_files(spark, folder)


@query
def op9_sentencepiece(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_hmm_scores(spark, sf_dir):
    return language_scores(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(*with_shared_heads(numbered_turns(table(spark, sf_dir, "conversations"))))


@query
def op12_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proofs = manifest(table(spark, sf_dir, "documents"), claims={"text": text})
    back = proofs.withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return back.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


@query
def op13_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op5_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
ORACLES["op11_prefix_trie"] = oracles.prefix_trie()
ORACLES["op12_merkle_manifest"] = oracles.merkle_manifest()
ORACLES["op13_jaccard_join"] = oracles.jaccard_components()
