"""The corpus operators' queries over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chosen_path, exact_dedup, kneser_ney, line_dedup, mixing, order_minhash, packing, periodic_runs, pii, recompression, sharding, token_counts
from .common import read


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).drop("text_hash")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"))


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.passage_dedup(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = kneser_ney.classify(docs, read(spark, sf_dir, "labels"), columns=("doc_id", "lang"))
    return rows.select("doc_id", "lang", F.col("_perplexity").alias("perplexity"), F.col("_score").alias("score"), F.col("_threshold").alias("threshold"), F.col("_trusted_texts").alias("trusted_texts"), F.col("_keep").alias("kept"))


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings"))


def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recompression.substring_dedup(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), change=periodic_runs.planted)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_packing, op4_personal_data, op5_jaccard_join, op6_exact_dedup, op7_line_dedup, op7_passage_dedup, op8_quality, op9_mixing, op10_order_minhash, op11_exponion, op12_recompression, op13_periodic_runs)}

ORACLES = {
    "op6_exact_dedup": """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_line_dedup": line_dedup.oracle(),
    "op7_passage_dedup": line_dedup.passage_oracle(),
    "op11_exponion": centroids.oracle(),
    "op12_recompression": recompression.oracle(),
}
