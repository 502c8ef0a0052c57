"""The registered query of each operator, with production parameters over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, lines, mixing, neighbours, pseudo_lm, quality, substrings, topk, toxicity
from tidemark.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file as every executor finds it: it belongs to an installed package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op3_pseudo_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), texts=False)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    predicted = F.when(F.col("quality_score") >= quality.CUT, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"), predicted)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lines, op2_toxicity, op3_pseudo_lm, op4_substrings, op5_jaccard, op6_mixing, op7_neighbours, op8_bpe, op9_quality, op10_topk)}


def oracle_sql() -> dict[str, str]:
    return {"op1_lines": lines.ORACLE, "op4_substrings": substrings.ORACLE, "op5_jaccard": jaccard.ORACLE, "op6_mixing": mixing.ORACLE, "op7_neighbours": neighbours.ORACLE, "op10_topk": topk.ORACLE}
